"""Snapshot selection, merges, closure checks and admission queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import merge as M
from framewright.operators import selection as S
from framewright.operators.skew import lookup_join
from framewright.session import load

FILTERS = S.Filters(minimum_frames=4, actions=("sprint", "Crawl", "defeat "), include_sources=("source_tarnhold", "source_mossgate"), exclude_sources=("source_brindle",))


def snapshot_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Sequences with enough frames whose effective action is wanted."""
    frames = load(spark, root, "prepared_broad_rows").dropDuplicates(["sequence_id"])
    n = F.size(F.coalesce("frame_phases", F.array().cast("array<double>")))
    action = S.effective_action(F.col("action"))
    return frames.where((n >= FILTERS.minimum_frames) & action.isin(list(FILTERS.actions))).select("sequence_id", action.alias("action"), n.cast("bigint").alias("n_frames"))


def _associations(spark: SparkSession, root: str) -> DataFrame:
    """(sequence_id, source_id) through the sequence itself and through its identity's other sequences."""
    frames = load(spark, root, "prepared_broad_rows").select("sequence_id", "source_id")
    motions = load(spark, root, "latent_motion_training_rows").select("sequence_id", "source_id")
    return frames.unionByName(motions).where("source_id is not null").distinct()


def source_filters(spark: SparkSession, root: str) -> DataFrame:
    """Sequences of an included source and of no excluded one."""
    frames = load(spark, root, "prepared_broad_rows").select("sequence_id").distinct()
    return S.by_sources(frames, "sequence_id", _associations(spark, root), FILTERS)


def source_exclude(spark: SparkSession, root: str) -> DataFrame:
    """With exclusions alone, a sequence without any source stays."""
    frames = load(spark, root, "prepared_broad_rows").select("sequence_id").distinct()
    return S.by_sources(frames, "sequence_id", _associations(spark, root), S.Filters(exclude_sources=("source_brindle", "source_tarnhold")))


def temporal_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Per order: lines, summed quantity, and whether its line numbers run 0..n-1 with positive quantities."""
    lines = load(spark, root, "lineitem").withColumn("ordinal", F.col("l_linenumber") - 1)
    return S.timing_evidence(lines, "l_orderkey", "ordinal", "l_quantity")


def model_ready(spark: SparkSession, root: str) -> DataFrame:
    """Frame phases that fit a loop, per sequence."""
    frames = load(spark, root, "prepared_broad_rows").dropDuplicates(["sequence_id"])
    return frames.select("sequence_id", S.phases_ready(F.col("frame_phases"), F.lit("loop")).alias("ready"))


def json_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Per source: metadata documents that parse, that don't, and frames they claim; broken ones are counted, not fatal."""
    items = load(spark, root, "corpus_items").dropDuplicates(["id"])
    parsed = F.try_parse_json("metadata_json")
    return items.groupBy("source_id").agg(
        F.count_if(parsed.isNotNull()).alias("n_valid"),
        F.count_if(F.col("metadata_json").isNotNull() & parsed.isNull()).alias("n_broken"),
        F.coalesce(F.sum(F.try_variant_get(parsed, "$.frames", "bigint")), F.lit(0)).alias("claimed_frames"),
        F.count_if(F.size(S.negative_claims(F.col("metadata_json"), ["timing_known", "exact_timing"])) > 0).alias("n_negative_claims"),
    )


def sample_documents(spark: SparkSession, root: str) -> DataFrame:
    """Orders as nested documents: their lines in order as one array, the first line as primary."""
    orders = load(spark, root, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    lines = load(spark, root, "lineitem").withColumnRenamed("l_orderkey", "k")
    doc = S.nested(orders, "k", {"lines": (lines, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])})
    return doc.select(
        F.col("k").alias("o_orderkey"), "o_orderpriority", F.size("lines").cast("bigint").alias("n_lines"),
        F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), "|").alias("lines"),
        F.coalesce(F.get("lines", F.lit(0))["l_partkey"], F.lit(-1)).alias("first_part"),
    )


def primary_subject(spark: SparkSession, root: str) -> DataFrame:
    """Per part the supplier line of greatest quantity, ties to the smaller supplier and order."""
    lines = load(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")
    return S.primary(lines, "l_partkey", [-F.col("l_quantity"), "l_suppkey", "l_orderkey"])


def priority_join(spark: SparkSession, root: str) -> DataFrame:
    """Distinct typed verbs resolved by falling back from the exact name to its trimmed lower-case form to its first word."""
    verbs = load(spark, root, "latent_motion_training_rows").where("verb is not null").select("verb").distinct()
    lookup = load(spark, root, "action_vocabulary").select(F.col("canonical_action").alias("name"), "vocab_id")
    lower = F.lower(F.trim("verb"))
    return S.priority_join(verbs, "verb", [(F.col("verb"), 1.0, "exact"), (lower, 0.97, "lowered"), (F.regexp_extract(lower, r"^([a-z]+)", 1), 0.85, "first_word")], lookup, "name").select("verb", F.coalesce("vocab_id", F.lit(0)).alias("vocab_id"), "confidence", "method")


def longest_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Script paths with the longest directory prefix that is registered."""
    scripts = load(spark, root, "raw_properties").select("script_path").distinct()
    prefixes = scripts.where(F.col("script_path").rlike(r"/elk_")).select(F.col("script_path").alias("prefix")).unionByName(
        scripts.limit(1).select(F.lit("scripts").alias("prefix"))
    )
    return S.longest_prefix(scripts, "script_path", "script_path", prefixes, "prefix")


def _item_reasons() -> list:
    return [
        (F.col("title").isNull() | (F.trim("title") == ""), "no_title"),
        (F.col("creator_name").isNull() | (F.trim("creator_name") == ""), "no_creator"),
        (F.col("tombstoned_at").isNotNull(), "tombstoned"),
        (F.col("metadata_json").isNull() | F.try_parse_json("metadata_json").isNull(), "broken_metadata"),
        (F.col("registered").isNull(), "unregistered_source"),
    ]


def _admission(spark: SparkSession, root: str) -> DataFrame:
    items = load(spark, root, "corpus_items").dropDuplicates(["id"])
    sources = load(spark, root, "sources").select(F.col("id").alias("source_id"), F.lit(True).alias("registered"))
    return S.admitted(lookup_join(items, sources, "source_id", "left"), _item_reasons())


def admit_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Every item admitted, or quarantined with its ordered reasons."""
    return _admission(spark, root).select("id", "admitted", F.array_join("exclusion_reasons", "|").alias("reasons"))


def exclusion_histogram(spark: SparkSession, root: str) -> DataFrame:
    """How often each reason excludes an item; an admitted item counts under "admitted"."""
    kept = F.when(F.col("admitted"), F.array(F.lit("admitted"))).otherwise(F.col("exclusion_reasons"))
    return _admission(spark, root).select(F.explode(kept).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_items"))


def tier_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Quality tiers of motion rows: dense without any reason, broad if only the timing is at fault, else rejected."""
    rows = load(spark, root, "latent_motion_training_rows").dropDuplicates(["sequence_id"])
    d = F.col("duration_ms")
    bad = F.coalesce(F.exists(d, lambda x: x.isNull() | (x <= 0)), F.lit(True))
    tagged = S.admitted(rows, [
        (F.col("identity_id").isNull(), "no_identity"), (F.col("verb").isNull() | (F.trim("verb") == ""), "no_verb"),
        (F.coalesce(F.size(d), F.lit(0)) != 8, "wrong_length"), (bad, "bad_duration"),
        (F.col("loop_mode").isNull() | (F.col("loop_mode") == "unknown"), "no_loop_mode"),
    ])
    timing = F.array(F.lit("bad_duration"), F.lit("no_loop_mode"))
    tier = F.when(F.col("admitted"), "dense").when(F.size(F.array_except("exclusion_reasons", timing)) == 0, "broad").otherwise("rejected")
    return tagged.groupBy(tier.alias("tier"), F.array_join("exclusion_reasons", "|").alias("reasons")).agg(F.count("*").alias("n_rows"))


def merge_coalesce(spark: SparkSession, root: str) -> DataFrame:
    """Items merged over their observations: first seen kept, last seen overwritten, facts filled."""
    items = load(spark, root, "corpus_items")
    return M.coalesce_merge(items, ["id"], ["ingested_at", "last_seen_at"], ["first_seen_at"], ["last_seen_at"], ["title", "creator_name", "published_at"])


def latest_observation(spark: SparkSession, root: str) -> DataFrame:
    events = load(spark, root, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return M.latest_per_key(events, ["user_id"], ["ts", "event_id"])


def upsert_suppliers(spark: SparkSession, root: str) -> DataFrame:
    """A table with a batch of updates applied: balances filled, names overwritten, nations kept."""
    current = load(spark, root, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    updates = current.where("s_suppkey % 3 = 0").select(
        (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 1_000_000).otherwise(0)).alias("s_suppkey"),
        F.concat(F.lit("renamed "), "s_name").alias("s_name"), F.lit(0).alias("s_nationkey"),
        F.when(F.col("s_suppkey") % 9 == 0, F.lit(None).cast("double")).otherwise(F.lit(1.5)).alias("s_acctbal"),
    )
    return M.upsert(current, updates, ["s_suppkey"], {"s_nationkey": "keep", "s_acctbal": "fill"})


def insert_or_ignore(spark: SparkSession, root: str) -> DataFrame:
    nation = load(spark, root, "nation")
    rows = nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("new").alias("n_name"), "n_regionkey")
    return M.insert_or_ignore(nation, rows, ["n_nationkey"])


def readiness_diff(spark: SparkSession, root: str) -> DataFrame:
    """Two versions of a table compared in full: missing, unregistered, mismatched or equal."""
    part = load(spark, root, "part").select("p_partkey", "p_name", "p_size")
    indexed = part.where("p_partkey % 7 <> 0").select(
        F.when(F.col("p_partkey") % 11 == 0, F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey")).alias("p_partkey"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
    )
    return M.readiness_diff(part, indexed, ["p_partkey"], ["p_name", "p_size"])


def closure_checks(spark: SparkSession, root: str) -> DataFrame:
    documents = load(spark, root, "documents").select(F.col("item_id").alias("id"))
    return M.closure(documents, load(spark, root, "corpus_items").select("id"), "id")


def key_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """External keys of a source that stand for more than one item."""
    items = load(spark, root, "corpus_items").select(F.concat_ws(chr(0), "source_id", "external_id").alias("k"), "creator_name")
    return M.key_conflicts(items, "k", "creator_name")


def merged_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The union of two manifests by key: equal repeats collapse, conflicting ones are counted apart."""
    sources = load(spark, root, "sources").select("id", "kind", "adapter_version")
    other = sources.withColumn("adapter_version", F.when(F.col("kind") == "forum", F.lit("0")).otherwise(F.col("adapter_version")))
    rows, conflicts = M.merged_union([sources, other], "id")
    return rows.select("id", F.lit("merged").alias("state")).unionByName(conflicts.select("id", F.lit("conflict").alias("state")))


QUERIES = {f.__name__: f for f in (
    snapshot_candidates, source_filters, source_exclude, temporal_evidence, model_ready, json_evidence, sample_documents,
    primary_subject, priority_join, longest_prefix, admit_quarantine, exclusion_histogram, tier_reasons, merge_coalesce,
    latest_observation, upsert_suppliers, insert_or_ignore, readiness_diff, closure_checks, key_conflicts, merged_manifests,
)}

_FRAMES = "(SELECT DISTINCT ON (sequence_id) * FROM prepared_broad_rows ORDER BY sequence_id)"
_ITEMS = "(SELECT DISTINCT ON (id) * FROM corpus_items ORDER BY id)"
_ASSOC = "SELECT sequence_id, source_id FROM prepared_broad_rows UNION SELECT sequence_id, source_id FROM latent_motion_training_rows"
_ADMISSION = f"""
    SELECT i.id, array_to_string(list_filter([
        CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' END, CASE WHEN creator_name IS NULL OR trim(creator_name) = '' THEN 'no_creator' END,
        CASE WHEN tombstoned_at IS NOT NULL THEN 'tombstoned' END, CASE WHEN metadata_json IS NULL OR NOT json_valid(metadata_json) THEN 'broken_metadata' END,
        CASE WHEN s.id IS NULL THEN 'unregistered_source' END], lambda x: x IS NOT NULL), '|') AS reasons
    FROM {_ITEMS} i LEFT JOIN sources s ON s.id = i.source_id"""

ORACLES = {
    "snapshot_candidates": f"""
        SELECT sequence_id, lower(coalesce(nullif(trim(action), ''), 'unknown')) AS action, len(frame_phases) AS n_frames FROM {_FRAMES}
        WHERE coalesce(len(frame_phases), 0) >= 4 AND lower(trim(action)) IN ('sprint', 'crawl', 'defeat')
    """,
    "source_filters": f"""
        WITH a AS ({_ASSOC}) SELECT DISTINCT sequence_id FROM prepared_broad_rows
        WHERE sequence_id IN (SELECT sequence_id FROM a WHERE source_id IN ('source_tarnhold', 'source_mossgate'))
        AND sequence_id NOT IN (SELECT sequence_id FROM a WHERE source_id = 'source_brindle')
    """,
    "source_exclude": f"""
        WITH a AS ({_ASSOC}) SELECT DISTINCT sequence_id FROM prepared_broad_rows
        WHERE sequence_id NOT IN (SELECT sequence_id FROM a WHERE source_id IN ('source_brindle', 'source_tarnhold'))
    """,
    "temporal_evidence": """
        SELECT l_orderkey, count(*) AS n_frames, sum(l_quantity) AS total_duration,
            min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AND bool_and(l_quantity > 0) AS complete_timing
        FROM lineitem GROUP BY 1
    """,
    "model_ready": f"""
        SELECT sequence_id, coalesce(len(frame_phases) > 0 AND
            len(list_filter(frame_phases, lambda p: p >= 0 AND p < 1)) = len(frame_phases) AND
            len(list_filter(range(1, len(frame_phases)), lambda i: frame_phases[i] < frame_phases[i + 1])) = len(frame_phases) - 1, false) AS ready
        FROM {_FRAMES}
    """,
    "json_evidence": f"""
        SELECT source_id, count(*) FILTER (json_valid(metadata_json)) AS n_valid,
            count(*) FILTER (metadata_json IS NOT NULL AND NOT json_valid(metadata_json)) AS n_broken,
            coalesce(CAST(sum(CASE WHEN json_valid(metadata_json) THEN CAST(json_extract(metadata_json, '$.frames') AS BIGINT) END) AS BIGINT), 0) AS claimed_frames,
            count(*) FILTER (CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.timing_known') = 'false' END) AS n_negative_claims
        FROM {_ITEMS} GROUP BY 1
    """,
    "sample_documents": """
        SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n_lines,
            coalesce(string_agg(l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), '') AS lines,
            coalesce(first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), -1) AS first_part
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
    """,
    "primary_subject": """
        SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey, l_orderkey) = 1
    """,
    "priority_join": """
        WITH v AS (SELECT DISTINCT verb FROM latent_motion_training_rows WHERE verb IS NOT NULL),
        m AS (SELECT verb, a.vocab_id AS x, b.vocab_id AS y, c.vocab_id AS z FROM v LEFT JOIN action_vocabulary a ON a.canonical_action = verb
            LEFT JOIN action_vocabulary b ON b.canonical_action = lower(trim(verb))
            LEFT JOIN action_vocabulary c ON c.canonical_action = regexp_extract(lower(trim(verb)), '^([a-z]+)', 1))
        SELECT verb, coalesce(x, y, z, 0) AS vocab_id, CASE WHEN x IS NOT NULL THEN 1.0 WHEN y IS NOT NULL THEN 0.97 WHEN z IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence,
            CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'lowered' WHEN z IS NOT NULL THEN 'first_word' ELSE 'unresolved' END AS method FROM m
    """,
    "longest_prefix": """
        SELECT DISTINCT script_path, CASE WHEN script_path LIKE '%/elk!_%' ESCAPE '!' THEN script_path
            WHEN script_path LIKE 'scripts/%' THEN 'scripts' END AS prefix FROM raw_properties
    """,
    "admit_quarantine": f"SELECT id, reasons = '' AS admitted, reasons FROM ({_ADMISSION})",
    "exclusion_histogram": f"""
        SELECT unnest(string_split(CASE WHEN reasons = '' THEN 'admitted' ELSE reasons END, '|')) AS reason, count(*) AS n_items FROM ({_ADMISSION}) GROUP BY 1
    """,
    "tier_reasons": """
        WITH r AS (SELECT DISTINCT ON (sequence_id) * FROM latent_motion_training_rows ORDER BY sequence_id),
        t AS (SELECT list_filter([CASE WHEN identity_id IS NULL THEN 'no_identity' END, CASE WHEN verb IS NULL OR trim(verb) = '' THEN 'no_verb' END,
            CASE WHEN coalesce(len(duration_ms), 0) <> 8 THEN 'wrong_length' END,
            CASE WHEN coalesce(len(list_filter(duration_ms, lambda x: x IS NULL OR x <= 0)), 1) > 0 THEN 'bad_duration' END,
            CASE WHEN loop_mode IS NULL OR loop_mode = 'unknown' THEN 'no_loop_mode' END], lambda x: x IS NOT NULL) AS q FROM r)
        SELECT CASE WHEN len(q) = 0 THEN 'dense' WHEN len(list_filter(q, lambda x: x NOT IN ('bad_duration', 'no_loop_mode'))) = 0 THEN 'broad' ELSE 'rejected' END AS tier,
            array_to_string(q, '|') AS reasons, count(*) AS n_rows FROM t GROUP BY 1, 2
    """,
    "merge_coalesce": """
        SELECT id, first(first_seen_at ORDER BY ingested_at, last_seen_at) AS first_seen_at, last(last_seen_at ORDER BY ingested_at, last_seen_at) AS last_seen_at,
            last(title ORDER BY ingested_at, last_seen_at) FILTER (title IS NOT NULL) AS title,
            last(creator_name ORDER BY ingested_at, last_seen_at) FILTER (creator_name IS NOT NULL) AS creator_name,
            last(published_at ORDER BY ingested_at, last_seen_at) FILTER (published_at IS NOT NULL) AS published_at, count(*) AS n_observations
        FROM corpus_items GROUP BY id
    """,
    "latest_observation": """
        SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
    "upsert_suppliers": """
        WITH u AS (SELECT s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 1000000 ELSE 0 END AS k, 'renamed ' || s_name AS n,
            CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 1.5 END AS b FROM supplier WHERE s_suppkey % 3 = 0)
        SELECT coalesce(k, s_suppkey) AS s_suppkey, coalesce(n, s_name) AS s_name, coalesce(s_nationkey, 0) AS s_nationkey, CAST(coalesce(b, s_acctbal) AS DOUBLE) AS s_acctbal,
            CASE WHEN k IS NOT NULL AND s_suppkey IS NOT NULL THEN 'updated' WHEN k IS NOT NULL THEN 'created' ELSE 'kept' END AS merge_state
        FROM supplier FULL JOIN u ON k = s_suppkey
    """,
    "insert_or_ignore": """
        SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
        SELECT n_nationkey + 20, 'new', n_regionkey FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)
    """,
    "readiness_diff": """
        WITH i AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 10000000 ELSE p_partkey END AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS n,
            CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 7 <> 0),
        j AS (SELECT coalesce(p_partkey, k) AS p_partkey, CASE WHEN k IS NULL THEN 'missing' WHEN p.p_partkey IS NULL THEN 'unregistered'
            WHEN p_name IS DISTINCT FROM n OR p_size IS DISTINCT FROM s THEN 'mismatched' ELSE 'match' END AS status,
            p_name IS DISTINCT FROM n AS a, p_size IS DISTINCT FROM s AS b FROM part p FULL JOIN i ON k = p.p_partkey)
        SELECT p_partkey, status, CASE WHEN status <> 'mismatched' THEN '' WHEN a AND b THEN 'p_name|p_size' WHEN a THEN 'p_name' ELSE 'p_size' END AS differing FROM j
    """,
    "closure_checks": """
        WITH a AS (SELECT item_id AS id, count(*) n FROM documents WHERE item_id IS NOT NULL GROUP BY 1), b AS (SELECT id, count(*) m FROM corpus_items GROUP BY 1)
        SELECT count(*) FILTER (m IS NULL) AS n_left_only, count(*) FILTER (n IS NULL) AS n_right_only, count(*) FILTER (m IS NOT NULL AND n IS NOT NULL) AS n_both,
            count(*) FILTER (n > 1) AS n_left_repeated, count(*) FILTER (m > 1) AS n_right_repeated FROM a FULL JOIN b USING (id)
    """,
    "key_conflicts": """
        SELECT concat_ws(chr(0), source_id, external_id) AS k, count(DISTINCT creator_name) AS n_values FROM corpus_items GROUP BY 1 HAVING count(DISTINCT creator_name) > 1
    """,
    "merged_manifests": "SELECT id, CASE WHEN kind = 'forum' AND adapter_version <> '0' THEN 'conflict' ELSE 'merged' END AS state FROM sources",
}
