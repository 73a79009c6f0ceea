"""Queries of the single-value rules with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions import rules as R
from framewright.session import load

DIRECTIONS = ["up", "down", "left", "right", "up_right", "up_left", "down_right", "down_left"]
VIEWS = ["side", "front", "back", "three_quarter", "top_down", "isometric"]
# What is typed in a direction or view field, to be drawn by row number.
TYPED_DIRECTIONS = ["North", "up_left", "facing SE", "sideways", None, "left!"]
TYPED_VIEWS = ["profile", "Top-Down", "iso view", None]
# Prompt phrases of verbs.
PHRASES = {
    "idle": "in an idle neutral stance", "run": "running", "walk": "walking", "jump": "jumping", "land": "landing", "hurt": "recoiling from a hit",
    "turn": "turning around", "victory": "in a victory pose", "defeat": "in a defeated pose", "crouch": "crouching", "recover": "recovering balance",
}
TERMS = ["loop", "one_shot", "ping_pong"]


def _drawn(words: list[str | None], number) -> F.Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))).cast("int"))


def motion_conditions(spark: SparkSession, root: str) -> DataFrame:
    """Distinct raw verbs with direction and view as typed: normalized action, family, least confidence and how each part was found."""
    number = F.length("verb")
    verbs = load(spark, root, "latent_motion_training_rows").where("verb is not null").select("verb").distinct().select(
        "verb", _drawn(TYPED_DIRECTIONS, number).alias("direction"), _drawn(TYPED_VIEWS, number).alias("view"))
    vocabulary = load(spark, root, "action_vocabulary")
    names = vocabulary.select(F.col("canonical_action").alias("canonical"), F.explode(F.array_append("other_names", F.col("canonical_action"))).alias("name"))
    families = vocabulary.select(L.slug(F.col("canonical_action")).alias("label"), "action_family")
    found = L.normalized_label(verbs, "verb", names).join(F.broadcast(families), "label", "left")  # one row per entry of the reference list
    (way, how), (look, seen) = R.fixed_label(F.col("direction"), DIRECTIONS, R.DIRECTION_NAMES), R.fixed_label(F.col("view"), VIEWS, R.VIEW_NAMES)
    sure = lambda raw, m: F.when(F.coalesce(raw, F.lit("")) != "", R.confidence_of(m)).otherwise(1.0)
    return found.select(
        "verb", F.coalesce("label", F.lit("unknown")).alias("action"), F.coalesce("action_family", F.lit("other")).alias("family"),
        way.alias("direction"), look.alias("view"),
        F.least("confidence", sure(F.col("direction"), how), sure(F.col("view"), seen)).alias("confidence"),
        F.concat_ws("/", "method", how, seen).alias("method"))


def state_actions(spark: SparkSession, root: str) -> DataFrame:
    """Distinct property values with the action their words tell."""
    values = load(spark, root, "raw_properties").select(F.explode("property_values").alias("value")).where("value is not null").distinct()
    return values.select("value", F.coalesce(R.state_action(F.col("value")), F.lit("")).alias("action"))


def action_phrases(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the vocabulary with their prompt phrase; the ones without are named as unsupported."""
    phrase = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("canonical_action")]
    return load(spark, root, "action_vocabulary").select("vocab_id", F.coalesce(phrase, F.concat(F.lit("unsupported: "), "canonical_action")).alias("phrase"))


def strict_replies(spark: SparkSession, root: str) -> DataFrame:
    """Replies per split: how many hold exactly the asked fields with allowed values, how many don't."""
    rows = load(spark, root, "latent_motion_training_rows")
    body = F.to_json(F.struct("loop_mode", "split"))
    reply = F.when(F.col("action_index") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("action_index") % 3 == 1, body).otherwise(F.concat(body, F.lit("}")))
    held = R.strict_choices(reply, {"loop_mode": TERMS, "split": ["train", "test"]})
    return rows.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(
        F.count(held).alias("n_valid"), F.count_if(held.isNull()).alias("n_invalid"), F.count_if(held["loop_mode"] == "loop").alias("n_loops"))


def caption_text(spark: SparkSession, root: str) -> DataFrame:
    """Descriptions without marks, their sentences that speak of the subject, and in lines of 24 letters."""
    items = load(spark, root, "corpus_items").where("description is not null").select("id", "description").distinct()
    marked = F.concat(F.lit("<s> "), "description", F.lit(". Plain  background<pad>. Done </s>"))
    return items.select("id", "description", R.sanitized_caption(marked).alias("plain"), R.appearance_caption(marked).alias("appearance"),
                        F.array_join(R.wrapped(F.col("description"), 24), "\n").alias("lines"))


def encoded_conditions(spark: SparkSession, root: str) -> DataFrame:
    """Loop modes and splits as places in their lists, with the rows whose label isn't in them."""
    rows = load(spark, root, "latent_motion_training_rows")
    coded = R.encoded_labels(rows, {"loop_mode": TERMS, "split": ["train", "validation", "test"]})
    return coded.groupBy(F.coalesce("loop_mode_id", F.lit(-1)).alias("loop_mode_id"), F.coalesce("split_id", F.lit(-1)).alias("split_id")).agg(F.count("*").alias("n_rows"))


def rounded_values(spark: SparkSession, root: str) -> DataFrame:
    part = load(spark, root, "part").select(((F.col("p_size") - 25) / 2.0).alias("v")).groupBy("v").agg(F.count("*").alias("n_parts"))
    return part.select("v", R.half_away(F.col("v")).cast("bigint").alias("rounded"), "n_parts")


def duration_literals(spark: SparkSession, root: str) -> DataFrame:
    """Every property value as a duration in each of the written forms; -1 where it is none."""
    values = load(spark, root, "raw_properties").select(F.explode("property_values").alias("value")).where("value is not null")
    number = F.regexp_extract("value", r"([0-9]+)", 1)
    texts = values.where(number != "").select(number.alias("n")).distinct().select("n", F.explode(F.array(F.lit(""), F.lit("ms"), F.lit("s"), F.lit(" s"), F.lit(".5"), F.lit(".123"))).alias("unit"))
    text = F.concat("n", "unit")
    return texts.select(text.alias("literal"), F.coalesce(R.literal_milliseconds(text), F.lit(-1).cast("bigint")).alias("unit_ms"),
                        F.coalesce(R.decisecond_milliseconds(text), F.lit(-1).cast("bigint")).alias("decisecond_ms"),
                        F.coalesce(R.frame_milliseconds(F.col("n").cast("double"), F.lit(60)), F.lit(-1).cast("bigint")).alias("frame_ms"))


def archive_times(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("p_partkey")
    made = R.archive_time(1980 + n % 60, n % 14, n % 33, n % 25, n % 61, n % 60)
    return load(spark, root, "part").select("p_partkey", F.coalesce(made, F.lit("")).alias("modified_at"))


def sprite_names(spark: SparkSession, root: str) -> DataFrame:
    """Lump names made from parts: family and frames, or no valid name."""
    n = F.col("p_partkey")
    token = lambda k: F.char(65 + F.pmod(n * k, F.lit(34)))
    one, two = F.concat(token(1), F.pmod(n, F.lit(10)).cast("string")), F.concat(token(7), F.pmod(n * 3, F.lit(9)).cast("string"))
    name = F.concat(F.lit("sprites/"), F.substring(F.regexp_replace("p_name", " ", ""), 1, 4), one, F.when(n % 2 == 0, two).otherwise(""), F.when(n % 5 == 0, ".PNG").when(n % 7 == 0, ".gif").otherwise(".png"))
    found = R.sprite_name(name)
    text = F.array_join(F.transform(found["frames"], lambda f: F.concat(f["frame"], f["frame_index"].cast("string"), F.lit(":"), f["rotation"].cast("string"), F.when(f["mirrored"], "m").otherwise(""))), " ")
    return load(spark, root, "part").select("p_partkey", F.coalesce(found["family"], F.lit("")).alias("family"), F.coalesce(text, F.lit("")).alias("frames"))


def _sheet_paths(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "latent_motion_training_rows").where("verb is not null and source_id is not null").select("source_id", "verb", F.col("action_index")).distinct()
    n = F.coalesce(F.col("action_index"), F.lit(7))
    top = F.when(n % 7 == 0, "sheet_definitions").when(n % 11 == 0, "tools").otherwise("spritesheets")
    end = F.when(n % 7 == 0, "/meta_a.json").when(n % 5 == 0, "/fg/base.png").when(n % 3 == 0, ".txt").otherwise("/red.png")
    return rows.select(F.concat(top, F.lit("/"), "source_id", F.lit("/"), "verb", end).alias("path")).distinct()


def sheet_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of a sprite repository by kind, category, action and plane."""
    actions = sorted(r[0] for r in load(spark, root, "action_vocabulary").select("canonical_action").collect())  # a reference list
    return _sheet_paths(spark, root).select("path", R.sheet_path(F.col("path"), actions).alias("p")).select(
        "path", F.col("p.kind").alias("kind"), *[F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("category", "action", "plane", "identity")])


def credit_keys(spark: SparkSession, root: str) -> DataFrame:
    """The keys under which a credit list may hold each path."""
    actions = sorted(r[0] for r in load(spark, root, "action_vocabulary").select("canonical_action").collect())
    return _sheet_paths(spark, root).select("path", F.explode(R.credit_candidates(F.col("path"), actions, {"run": ["dash", "sprint"]})).alias("credit_key"))


QUERIES = {f.__name__: f for f in (
    motion_conditions, state_actions, action_phrases, strict_replies, caption_text, encoded_conditions, rounded_values, duration_literals,
    archive_times, sprite_names, sheet_paths, credit_keys,
)}


def _names(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words: list[str | None], number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(words)} = {i} THEN " + ("NULL" if w is None else f"'{w}'") for i, w in enumerate(words)) + " END"


_PATHS = """
    r AS (SELECT DISTINCT source_id, verb, coalesce(action_index, 7) AS n FROM latent_motion_training_rows WHERE verb IS NOT NULL AND source_id IS NOT NULL),
    t AS (SELECT DISTINCT CASE WHEN n % 7 = 0 THEN 'sheet_definitions' WHEN n % 11 = 0 THEN 'tools' ELSE 'spritesheets' END || '/' || source_id || '/' || verb
        || CASE WHEN n % 7 = 0 THEN '/meta_a.json' WHEN n % 5 = 0 THEN '/fg/base.png' WHEN n % 3 = 0 THEN '.txt' ELSE '/red.png' END AS path FROM r)"""


def _fixed(column: str, canonical: list[str], aliases: dict[str, str]) -> tuple[str, str]:
    """SQL of (value, method) of a raw label against a short list, tried from the longest name to the shortest."""
    key = f"regexp_replace(regexp_replace(lower({column}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    names = {**{c: c for c in canonical}, **aliases}
    order = sorted(names, key=lambda n: (-len(n), n))
    whole = " ".join(f"WHEN {key} = '{n}' THEN " + "'{}'" for n in order)
    inside = " ".join(f"WHEN contains('_' || {key} || '_', '_{n}_') THEN " + "'{}'" for n in order)
    start = f"CASE WHEN coalesce({column}, '') = '' THEN "
    value = start + "'unknown' " + whole.format(*[names[n] for n in order]) + " " + inside.format(*[names[n] for n in order]) + " ELSE 'unknown' END"
    method = start + "'missing' " + whole.format(*["exact" if n in canonical else "alias" for n in order]) + " " + inside.format(*["embedded_token"] * len(order)) + " ELSE 'unmapped' END"
    return value, method


_SURE = "CASE {m} WHEN 'exact' THEN 1.0 WHEN 'alias' THEN 0.98 WHEN 'embedded_token' THEN 0.85 WHEN 'missing' THEN {none} ELSE 0.0 END::DOUBLE"
_WAY, _LOOK = _fixed("direction", DIRECTIONS, R.DIRECTION_NAMES), _fixed("view", VIEWS, R.VIEW_NAMES)
ORACLES = {
    "motion_conditions": rf"""
        WITH v AS (SELECT DISTINCT verb, length(verb) AS n, regexp_replace(regexp_replace(lower(regexp_replace(translate(verb,
                (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)) || chr(12288) || chr(160),
                (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)) || '  '),
                '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM latent_motion_training_rows WHERE verb IS NOT NULL),
        t AS (SELECT *, {_pick(TYPED_DIRECTIONS, 'n')} AS direction, {_pick(TYPED_VIEWS, 'n')} AS view FROM v),
        n AS (SELECT replace(name, ' ', '_') AS name, min(replace(canonical_action, ' ', '_')) AS c FROM (SELECT canonical_action, unnest(list_append(other_names, canonical_action)) AS name FROM action_vocabulary) GROUP BY 1),
        h AS (SELECT k, n.name, n.c, row_number() OVER (PARTITION BY k ORDER BY length(n.name) DESC, n.name) AS r FROM (SELECT DISTINCT k FROM v) d JOIN n ON contains('_' || k || '_', '_' || n.name || '_') WHERE k <> ''),
        m AS (SELECT t.verb, h.c AS label, CASE WHEN t.verb = '' THEN 'missing' WHEN h.name IS NULL THEN 'unmapped' WHEN h.name = t.k AND h.name = h.c THEN 'exact' WHEN h.name = t.k THEN 'alias' ELSE 'embedded_token' END AS how,
            {_WAY[0]} AS direction, {_WAY[1]} AS dm, {_LOOK[0]} AS view, {_LOOK[1]} AS vm FROM t LEFT JOIN h ON h.k = t.k AND h.r = 1)
        SELECT verb, coalesce(label, 'unknown') AS action, coalesce(action_family, 'other') AS family, direction, view,
            least({_SURE.format(m='how', none='0.0')}, {_SURE.format(m='dm', none='1.0')}, {_SURE.format(m='vm', none='1.0')}) AS confidence, how || '/' || dm || '/' || vm AS method
        FROM m LEFT JOIN action_vocabulary a ON replace(a.canonical_action, ' ', '_') = m.label
    """,
    "state_actions": "WITH v AS (SELECT DISTINCT value FROM (SELECT unnest(property_values) AS value FROM raw_properties) WHERE value IS NOT NULL), "
    "w AS (SELECT value, regexp_extract_all(lower(value), '[a-z0-9]+') AS t FROM v) SELECT value, CASE "
    + " ".join(
        f"WHEN list_has_any(t, {_names(words.split())})" + (" OR len(list_filter(t, lambda x: x LIKE 'dead%')) > 0" if action == "death" else "") + f" THEN '{action}'"
        for action, words in R.STATE_WORDS
    ) + " ELSE '' END AS action FROM w",
    "action_phrases": "SELECT vocab_id, CASE canonical_action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHRASES.items())
    + " ELSE 'unsupported: ' || canonical_action END AS phrase FROM action_vocabulary",
    "strict_replies": """
        WITH r AS (SELECT split, loop_mode, action_index % 3 IN (0, 1) AND loop_mode IN ('loop', 'one_shot', 'ping_pong') AND split IN ('train', 'test') AS ok FROM latent_motion_training_rows)
        SELECT coalesce(split, 'none') AS split, count(*) FILTER (coalesce(ok, false)) AS n_valid, count(*) FILTER (NOT coalesce(ok, false)) AS n_invalid,
            count(*) FILTER (coalesce(ok, false) AND loop_mode = 'loop') AS n_loops FROM r GROUP BY 1
    """,
    "caption_text": r"""
        WITH i AS (SELECT DISTINCT id, description FROM corpus_items WHERE description IS NOT NULL),
        p AS (SELECT *, trim(regexp_replace(replace(replace(replace('<s> ' || description || '. Plain  background<pad>. Done </s>', '<pad>', ' '), '</s>', ' '), '<s>', ' '), '\s+', ' ', 'g')) AS plain FROM i),
        s AS (SELECT *, list_filter(list_transform(string_split(plain, '.'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(lower(x), 'background|pixelated appearance')) AS kept,
            list_filter(string_split(trim(regexp_replace(description, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM p)
        SELECT id, description, plain, array_to_string(kept, '. ') || CASE WHEN len(kept) > 0 THEN '.' ELSE '' END AS appearance,
            CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: CASE WHEN length(regexp_extract(a, '([^\n]*)$', 1)) + 1 + length(x) > 24 THEN a || chr(10) || x ELSE a || ' ' || x END) END AS lines FROM s
    """,
    "encoded_conditions": f"""
        SELECT CAST(coalesce(list_position({_names(TERMS)}, loop_mode), 0) - 1 AS INTEGER) AS loop_mode_id,
            CAST(coalesce(list_position(['train', 'validation', 'test'], split), 0) - 1 AS INTEGER) AS split_id, count(*) AS n_rows FROM latent_motion_training_rows GROUP BY 1, 2
    """,
    "rounded_values": "SELECT (p_size - 25) / 2.0::DOUBLE AS v, CAST(sign(p_size - 25) * floor(abs(p_size - 25) / 2.0 + 0.5) AS BIGINT) AS rounded, count(*) AS n_parts FROM part GROUP BY 1, 2",
    "duration_literals": r"""
        WITH v AS (SELECT DISTINCT regexp_extract(value, '([0-9]+)', 1) AS n FROM (SELECT unnest(property_values) AS value FROM raw_properties) WHERE regexp_matches(value, '[0-9]')),
        t AS (SELECT n, n || u AS literal, u FROM v, unnest(['', 'ms', 's', ' s', '.5', '.123']) x(u))
        SELECT literal, CASE WHEN u IN ('', 'ms') THEN CAST(n AS BIGINT) WHEN u = 's' THEN CAST(n AS BIGINT) * 1000 ELSE -1 END AS unit_ms,
            CASE WHEN u = '' AND CAST(n AS BIGINT) > 0 THEN CAST(n AS BIGINT) * 100 WHEN u = '.5' THEN CAST(n AS BIGINT) * 100 + 50 ELSE -1 END AS decisecond_ms,
            CAST(floor(CAST(n AS BIGINT) * 1000.0 / 60 + 0.5) AS BIGINT) AS frame_ms FROM t
    """,
    "archive_times": """
        SELECT p_partkey, coalesce(strftime(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', 1980 + p_partkey % 60, p_partkey % 14, p_partkey % 33,
            p_partkey % 25, p_partkey % 61, p_partkey % 60) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S'), '') AS modified_at FROM part
    """,
    "sprite_names": r"""
        WITH c AS (SELECT p_partkey, substr(replace(p_name, ' ', ''), 1, 4) AS fam, chr(CAST(65 + p_partkey % 34 AS INTEGER)) AS a, p_partkey % 10 AS ra, p_partkey % 2 = 0 AS pair,
            chr(CAST(65 + (p_partkey * 7) % 34 AS INTEGER)) AS b, (p_partkey * 3) % 9 AS rb, p_partkey % 5 <> 0 AND p_partkey % 7 = 0 AS gif FROM part),
        k AS (SELECT *, NOT gif AND regexp_full_match(fam, '[A-Za-z0-9]{4}') AND ra <= 8 AND regexp_full_match(upper(a), '[A-Z\[\]\\^_]') AND (NOT pair OR regexp_full_match(upper(b), '[A-Z\[\]\\^_]')) AS ok FROM c)
        SELECT p_partkey, CASE WHEN ok THEN upper(fam) ELSE '' END AS family, CASE WHEN NOT ok THEN '' ELSE upper(a) || (ascii(upper(a)) - 65) || ':' || ra
            || CASE WHEN pair THEN ' ' || upper(b) || (ascii(upper(b)) - 65) || ':' || rb || 'm' ELSE '' END END AS frames FROM k
    """,
    "sheet_paths": rf"""
        WITH {_PATHS},
        w AS (SELECT path, (SELECT list(canonical_action) FROM action_vocabulary) AS voc, string_split(path, '/') AS q, list_transform(string_split(path, '/')[2:], lambda x: regexp_replace(x, '\.[A-Za-z0-9]+$', '')) AS d FROM t),
        k AS (SELECT *, CASE WHEN q[1] = 'spritesheets' THEN CASE WHEN path LIKE '%.png' THEN 'sheet' WHEN regexp_matches(lower(q[-1]), '\.[a-z0-9]+$') THEN 'sheet_auxiliary' ELSE 'sheet_directory' END
            WHEN q[1] = 'sheet_definitions' THEN 'definition_meta' WHEN path LIKE '%.txt' THEN 'documentation' ELSE 'other' END AS kind,
            list_filter(d, lambda x: list_contains(voc, x))[-1] AS act, list_filter(d, lambda x: x IN ('fg', 'bg', 'front', 'behind'))[-1] AS pl FROM w)
        SELECT path, kind, CASE WHEN kind = 'sheet' THEN coalesce(d[1], '') ELSE '' END AS category, CASE WHEN kind = 'sheet' THEN coalesce(act, '') ELSE '' END AS action,
            CASE WHEN kind = 'sheet' THEN coalesce(pl, '') ELSE '' END AS plane,
            CASE WHEN kind = 'sheet' THEN array_to_string(list_filter(d, lambda x: x NOT IN ('fg', 'bg', 'front', 'behind') AND (act IS NULL OR x <> act)), '/') ELSE '' END AS identity FROM k
    """,
    "credit_keys": rf"""
        WITH {_PATHS},
        w AS (SELECT path, (SELECT list(canonical_action) FROM action_vocabulary) AS voc, string_split(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/') AS d FROM t),
        a AS (SELECT *, list_max(list_filter(range(1, len(d) + 1), lambda i: list_contains(voc, d[i]))) AS pos FROM w),
        s AS (SELECT *, array_to_string(list_concat(d[1:(pos - 1)], list_filter(d[(pos + 1):], lambda x: x IN ('fg', 'bg', 'front', 'behind'))), '/') AS stem FROM a WHERE pos IS NOT NULL),
        n AS (SELECT path, stem, unnest(CASE WHEN d[pos] = 'run' THEN ['run', 'dash', 'sprint'] ELSE [d[pos]] END) AS name FROM s)
        SELECT path, path AS credit_key FROM t UNION SELECT path, CASE WHEN stem <> '' THEN stem || '/' ELSE '' END || name || '.png' FROM n
    """,
}
