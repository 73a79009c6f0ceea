"""Sampling, timeline, label, vector, pixel and stream queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import labels as L
from framewright.functions.keys import compatible
from framewright.operators import kernels as K
from framewright.operators import sampling as P
from framewright.operators import timeline as T
from framewright.operators import vectors as V
from framewright.operators.skew import lookup_join
from framewright.plans.sequences import ONCE, PIXELS
from framewright.session import load
from framewright.streaming import events as E

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def evaluation_probe(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    return P.probe(docs, "lang", "doc_id", 5)


def stratified_round_robin(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", "doc_kind", F.coalesce("lang", F.lit("none")).alias("lang"))
    turn = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return P.round_robin(docs, "lang", turn, "doc_kind", "doc_id", 12)


def identity_diverse(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "latent_motion_training_rows").where("identity_id is not null").select("sequence_id", "identity_id").distinct()
    return P.diverse(rows, "identity_id", "sequence_id", 200)


def _user_days(spark: SparkSession, root: str) -> DataFrame:
    events = load(spark, root, "events")
    return events.select("event_id", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("identity"), "event_type", "value")


def complete_rectangle(spark: SparkSession, root: str) -> DataFrame:
    """Per user and day with every event type, the event of greatest value of each type."""
    return P.rectangle(_user_days(spark, root), "identity", "event_type", EVENT_TYPES, [-F.col("value"), "event_id"])


def verb_pareto(spark: SparkSession, root: str) -> DataFrame:
    return P.label_pareto(_user_days(spark, root), "identity", "event_type", EVENT_TYPES)


def contrast_groups(spark: SparkSession, root: str) -> DataFrame:
    return P.contrast_groups(load(spark, root, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus")


def cyclic_permutation(spark: SparkSession, root: str) -> DataFrame:
    return P.cyclic_next(load(spark, root, "nation"), "n_regionkey", ["n_nationkey"], "n_name")


def sampler_weights(spark: SparkSession, root: str) -> DataFrame:
    events = load(spark, root, "events").select("event_id", "user_id", "event_type")
    return P.sampler_weights(events, "user_id", "event_type").select("event_id", F.round("weight", 12).alias("weight"))


def balanced_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Forty (customer, priority, priority) pairs with every customer and priority used evenly, chosen from all customers."""
    orders = load(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("identity"), "o_orderpriority")
    found = P.pair_candidates(orders, "identity", "o_orderpriority", 40).collect()  # at most 40 for each pair of priorities
    chosen = P.greedy_pairs([tuple(r)[:3] for r in found], 40, {(r["first_action"], r["second_action"]): r["n_identities"] for r in found})
    return spark.createDataFrame(chosen, "identity string, first_action string, second_action string")


def adjacent_transitions(spark: SparkSession, root: str) -> DataFrame:
    return T.transitions(load(spark, root, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("from_value", "to_value").agg(F.count("*").alias("n"))


def seam_transitions(spark: SparkSession, root: str) -> DataFrame:
    return T.transitions(load(spark, root, "nation"), "n_regionkey", ["n_nationkey"], "n_name", seam=True)


def canonical_phases(spark: SparkSession, root: str) -> DataFrame:
    """Even phases for the frame count of every sequence, as a loop and as a one-shot."""
    frames = load(spark, root, "prepared_broad_rows").where("frame_phases is not null").dropDuplicates(["sequence_id"])
    n = F.size("frame_phases")
    text = lambda a: F.array_join(F.transform(a, lambda p: F.round(p * 1_000_000).cast("bigint").cast("string")), "|")
    return frames.select("sequence_id", text(T.frame_phases(n, F.lit("loop"))).alias("loop"), text(T.frame_phases(n, F.lit("one_shot"))).alias("one_shot"))


def temporal_select(spark: SparkSession, root: str) -> DataFrame:
    """Eight evenly spaced targets of a loop, each with the nearest authored frame."""
    frames = load(spark, root, "prepared_broad_rows").where("size(frame_phases) > 0").dropDuplicates(["sequence_id"])
    targets = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i / 8.0)
    picked = T.nearest_frames(F.col("frame_phases"), targets, F.lit("loop"))
    return frames.select("sequence_id", F.array_join(F.transform(picked, lambda i: i.cast("string")), "|").alias("ordinals"))


def retimed_durations(spark: SparkSession, root: str) -> DataFrame:
    """Durations of clean clips brought to one second in all."""
    rows = load(spark, root, "latent_motion_training_rows").dropDuplicates(["sequence_id"])
    clean = rows.where(F.forall("duration_ms", lambda d: d.isNotNull() & (d > 0)) & (F.size("duration_ms") > 0))
    text = F.array_join(F.transform(T.retimed(F.col("duration_ms"), F.lit(1000.0)), lambda d: F.round(d * 1000).cast("bigint").cast("string")), "|")
    return clean.select("sequence_id", text.alias("durations"))


def cumulative_phase(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    phased = T.cumulative_phase(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], "l_quantity", F.col("l_orderkey") % 2 == 0)
    return phased.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("phase"), 6).alias("phase_sum"), F.round(F.max("phase"), 6).alias("last_phase"))


def timeline_fold(spark: SparkSession, root: str) -> DataFrame:
    """The lines of an order as lanes per return flag, brought to one timeline."""
    lines = load(spark, root, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("ms"))
    return T.folded(lines, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "ms")


def grid_cells(spark: SparkSession, root: str) -> DataFrame:
    """Sheets cut into 16 by 24 cells: how many per status and where the last cell lies."""
    sheets = load(spark, root, "prepared_broad_rows").where("size(source_size) = 2").dropDuplicates(["sequence_id"]).select(
        "sequence_id", F.col("source_size")[0].alias("w"), F.col("source_size")[1].alias("h"))
    return T.grid_cells(sheets, "w", "h", (16, 24)).groupBy("status").agg(
        F.count_distinct("sequence_id").alias("n_sheets"), F.count("cell").alias("n_cells"),
        F.coalesce(F.max("left"), F.lit(-1)).alias("most_left"), F.coalesce(F.max("top"), F.lit(-1)).alias("most_top"))


def spaced_cells(spark: SparkSession, root: str) -> DataFrame:
    """Sheets cut into cells of 14 by 10 from (2, 4), 2 and 6 apart: their status, number of cells and last corner."""
    sheets = load(spark, root, "prepared_broad_rows").where("size(source_size) = 2").select(F.col("source_size")[0].alias("w"), F.col("source_size")[1].alias("h")).distinct()
    return T.grid_cells(sheets, "w", "h", (14, 10), (2, 4), (2, 6)).groupBy("w", "h", "status").agg(
        F.count("cell").alias("n_cells"), F.coalesce(F.max("left"), F.lit(-1)).alias("most_left"), F.coalesce(F.max("top"), F.lit(-1)).alias("most_top"))


def normalize_labels(spark: SparkSession, root: str) -> DataFrame:
    """Distinct raw verbs against the vocabulary: missing, exact, alias, embedded_token or unmapped."""
    verbs = load(spark, root, "latent_motion_training_rows").select("verb").distinct()
    names = load(spark, root, "action_vocabulary").select(
        F.col("canonical_action").alias("canonical"), F.explode(F.array_append("other_names", F.col("canonical_action"))).alias("name"))
    return L.normalized_label(verbs, "verb", names).select(F.coalesce("verb", F.lit("(null)")).alias("verb"), F.coalesce("label", F.lit("")).alias("label"), "confidence", "method")


def range_classify(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size.between(1, 9), "core").when(size.between(10, 24), "attack").when(size.between(25, 39), "special").otherwise("other")
    return load(spark, root, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), "|").alias("sizes"))


def evidence_merge(spark: SparkSession, root: str) -> DataFrame:
    """Per item the claims of its observations: a field has a value only where all known claims agree."""
    items = load(spark, root, "corpus_items")
    settled = lambda c: F.coalesce(F.when(F.count_distinct(c) == 1, F.max(c)), F.lit(""))
    return items.groupBy("source_id", F.col("external_id")).agg(
        settled("title").alias("title"), settled("creator_name").alias("creator_name"), F.count_distinct("creator_name").alias("n_creators"))


def prompt_render(spark: SparkSession, root: str) -> DataFrame:
    part = load(spark, root, "part")
    text = L.clauses(("a ", F.col("p_name")), ("of type ", F.lower("p_type")), ("by ", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("Unknown"))))
    budget = L.budgeted_words(F.array(F.col("p_name"), F.lower("p_type"), F.lit(None).cast("string"), F.col("p_name"), F.col("p_brand")), 3)
    return part.select("p_partkey", text.alias("prompt"), budget.alias("short_prompt"))


def caption_leak(spark: SparkSession, root: str) -> DataFrame:
    """Items whose description gives away a word of their title."""
    items = load(spark, root, "corpus_items").dropDuplicates(["id"])
    word = F.regexp_extract(F.lower("title"), r"([a-z]+)", 1)
    return items.select("id", L.leaks_label(word, F.col("description")).alias("leaks"))


def url_references(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", F.explode(L.url_references(F.col("text"))).alias("url"))
    return docs.select("doc_id", "url", L.url_host(F.col("url")).alias("host"))


def license_status(spark: SparkSession, root: str) -> DataFrame:
    label = L.license_label(F.regexp_extract("text", r"(CC-[A-Z0-9-]+)", 1), F.regexp_extract("text", r"(?i)(public domain|all rights reserved)", 1))
    docs = load(spark, root, "documents").select(L.rights_status(label).alias("status"), F.coalesce(label, F.lit("")).alias("label"))
    return docs.groupBy("status", "label").agg(F.count("*").alias("n_docs"))


def humanized_identities(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "latent_motion_training_rows").where("identity_id is not null").select("identity_id").distinct()
    return rows.select("identity_id", L.humanized(compatible(F.col("identity_id"))).alias("label"))


def byte_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Descriptions as byte token ids: up to 96 bytes between the marks of start and end."""
    rows = load(spark, root, "semantic_embedding_rows").where("description is not null").select("row_index", "description").distinct()
    rows = rows.withColumn("ids", L.token_ids(F.col("description"), 98)).where("ids is not null")
    ids = F.col("ids")
    return rows.select("row_index", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("tokens"))


def channel_statistics(spark: SparkSession, root: str) -> DataFrame:
    return V.channel_statistics(load(spark, root, "embeddings"), "embedding").select("channel", "n_values", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def pairwise_separation(spark: SparkSession, root: str) -> DataFrame:
    return V.group_separation(load(spark, root, "embeddings"), "label", "embedding").select("label", "n_rows", F.round("mean_cosine", 6).alias("mean_cosine"))


def nearest_match(spark: SparkSession, root: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the three nearest of all."""
    return V.nearest_match(load(spark, root, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 3).select("query_id", "id", F.round("cosine", 5).alias("cosine"), "rank")


def retrieval_rank(spark: SparkSession, root: str) -> DataFrame:
    return V.retrieval_rank(load(spark, root, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)


def frame_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of every frame; of repeated rows of a key the least bytes stand."""
    once = load(spark, root, "prepared_broad_rows").where("sequence_id is not null").groupBy("sequence_id").agg(F.min("rgba").alias("rgba"))
    found = K.frame_statistics(once, "sequence_id", "rgba")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_alpha", "centre_x", "centre_y")})


def reference_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Each frame against the idle frame of its identity; the pixels of a crowded identity's reference are broadcast, its frames stay where they are."""
    frames = load(spark, root, "prepared_broad_rows").where("identity_id is not null and rgba is not null")
    idle = frames.where("action = 'idle'").groupBy("identity_id").agg(F.min_by(F.struct("sequence_id", "rgba"), "sequence_id").alias("r")).select(
        "identity_id", F.col("r.sequence_id").alias("reference_id"), F.col("r.rgba").alias("reference"))
    found = K.compare_frames(lookup_join(frames.select("identity_id", "sequence_id", "rgba"), idle, "identity_id"), "sequence_id", "rgba", "reference_id", "reference").distinct()
    return found.select("frame_id", "reference_id", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


def stream_event_windows(spark: SparkSession, root: str) -> DataFrame:
    """Daily event counts per type through a stream; a day is open until an event of a later day has come."""
    counts = E.windowed_counts(E.event_stream(spark, f"{root}/events.parquet"), "1 day", None, "event_type")
    return E.closed_windows(spark, counts, "event_type").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total_value")


def stream_insert_or_ignore(spark: SparkSession, root: str) -> DataFrame:
    """Events of a stream kept once per identifier, counted per type."""
    fresh = E.inserted_once(spark, E.event_stream(spark, f"{root}/events.parquet").select("event_id", "event_type"), "event_id")
    return fresh.groupBy("event_type").agg(F.count("*").alias("n_events"))


QUERIES = {f.__name__: f for f in (
    evaluation_probe, stratified_round_robin, identity_diverse, complete_rectangle, verb_pareto, contrast_groups, cyclic_permutation,
    sampler_weights, balanced_pairs, adjacent_transitions, seam_transitions, canonical_phases, temporal_select, retimed_durations,
    cumulative_phase, timeline_fold, grid_cells, spaced_cells, normalize_labels, range_classify, evidence_merge, prompt_render, caption_leak,
    url_references, license_status, humanized_identities, byte_tokens, channel_statistics, pairwise_separation, nearest_match,
    retrieval_rank, frame_statistics, reference_comparison, stream_event_windows, stream_insert_or_ignore,
)}

_H = "sha256('{d}' || chr(0) || {k})"
_DAYS = "SELECT event_id, user_id || ':' || strftime(ts, '%Y-%m-%d') AS identity, event_type, value FROM events"
_PHASED = "(SELECT DISTINCT ON (sequence_id) * FROM prepared_broad_rows ORDER BY sequence_id)"

ORACLES = {
    "evaluation_probe": f"""
        WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents)
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(d='probe', k='doc_id')}, doc_id) AS probe_rank FROM d QUALIFY probe_rank <= 5
    """,
    "stratified_round_robin": f"""
        WITH d AS (SELECT doc_id, doc_kind, coalesce(lang, 'none') AS lang, {_H.format(d='robin', k='doc_id')} AS h FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind, lang ORDER BY h, doc_id) AS n, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS t FROM d)
        SELECT doc_id, doc_kind, lang, row_number() OVER (PARTITION BY doc_kind ORDER BY n, t, lang, h, doc_id) AS pick FROM r QUALIFY pick <= 12
    """,
    "identity_diverse": f"""
        WITH d AS (SELECT DISTINCT sequence_id, identity_id FROM latent_motion_training_rows WHERE identity_id IS NOT NULL),
        r AS (SELECT *, {_H.format(d='diverse', k='sequence_id')} AS h FROM d)
        SELECT sequence_id, identity_id, row_number() OVER (PARTITION BY identity_id ORDER BY h, sequence_id) AS depth FROM r ORDER BY depth, h, sequence_id LIMIT 200
    """,
    "complete_rectangle": f"""
        WITH d AS ({_DAYS}), c AS (SELECT identity FROM d GROUP BY 1 HAVING count(DISTINCT event_type) = 5)
        SELECT identity, event_type, event_id, value FROM d WHERE identity IN (SELECT identity FROM c)
        QUALIFY row_number() OVER (PARTITION BY identity, event_type ORDER BY value DESC, event_id) = 1
    """,
    "verb_pareto": f"""
        WITH RECURSIVE d AS ({_DAYS}), m AS (SELECT identity, list_sort(list_distinct(list(event_type))) AS have FROM d GROUP BY 1),
        s AS (SELECT [v] AS labels FROM (SELECT unnest({EVENT_TYPES}) AS v) UNION ALL
            SELECT list_append(labels, v) FROM s, (SELECT unnest({EVENT_TYPES}) AS v) WHERE v > labels[len(labels)]),
        n AS (SELECT len(labels) AS k, array_to_string(labels, '|') AS labels, count(*) AS n_identities FROM s, m WHERE list_has_all(have, labels) GROUP BY 1, 2)
        SELECT CAST(k AS INTEGER) AS k, labels, n_identities FROM n QUALIFY rank() OVER (PARTITION BY k ORDER BY n_identities DESC) = 1
    """,
    "contrast_groups": """
        WITH a AS (SELECT o_custkey, o_orderpriority p, count(DISTINCT o_orderstatus) n, min(o_orderstatus) t FROM orders GROUP BY 1, 2),
        t AS (SELECT o_custkey, CASE WHEN n = 1 THEN t END AS t, min(p) f, count(*) m FROM a GROUP BY 1, 2),
        g AS (SELECT o_custkey, CAST(sum(m) AS BIGINT) AS n_actions, coalesce(CAST(sum(m) FILTER (t IS NULL) AS BIGINT), 0) AS n_conflicting,
            coalesce(CAST(sum(m - 1) FILTER (t IS NOT NULL) AS BIGINT), 0) AS n_aliases, count(t) AS n_contrasts,
            coalesce(string_agg(f, '|' ORDER BY f) FILTER (t IS NOT NULL), '') AS actions FROM t GROUP BY 1)
        SELECT *, CASE WHEN n_contrasts >= 2 THEN 'selected' WHEN n_conflicting > 0 THEN 'conflicting_targets' WHEN n_aliases > 0 THEN 'aliases_only' ELSE 'single_action' END AS status FROM g
    """,
    "cyclic_permutation": """
        SELECT n_nationkey, n_name, n_regionkey, coalesce(lead(n_name) OVER w, first(n_name) OVER w) AS next_value FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)
    """,
    "sampler_weights": """
        WITH r AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1, 2), a AS (SELECT user_id, count(*) k FROM r GROUP BY 1)
        SELECT event_id, round(1.0::DOUBLE / ((SELECT count(*) FROM a) * k * n), 12) AS weight FROM events JOIN r USING (user_id, event_type) JOIN a USING (user_id)
    """,
    "adjacent_transitions": """
        WITH t AS (SELECT event_type AS from_value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_value FROM events)
        SELECT from_value, to_value, count(*) AS n FROM t WHERE to_value IS NOT NULL GROUP BY 1, 2
    """,
    "seam_transitions": """
        SELECT n_regionkey, n_name AS from_value, coalesce(lead(n_name) OVER w, first(n_name) OVER w) AS to_value FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)
    """,
    "canonical_phases": f"""
        SELECT sequence_id, coalesce(array_to_string(list_transform(range(len(frame_phases)), lambda i: CAST(round(i * 1000000 / len(frame_phases)) AS BIGINT)), '|'), '') AS loop,
            coalesce(array_to_string(list_transform(range(len(frame_phases)), lambda i: CAST(round(i * 1000000 / greatest(len(frame_phases) - 1, 1)) AS BIGINT)), '|'), '') AS one_shot
        FROM {_PHASED} WHERE frame_phases IS NOT NULL
    """,
    "temporal_select": f"""
        WITH p AS (SELECT sequence_id, unnest(frame_phases) AS p, unnest(range(len(frame_phases))) AS i FROM {_PHASED} WHERE len(frame_phases) > 0),
        t AS (SELECT sequence_id, k, i, row_number() OVER (PARTITION BY sequence_id, k ORDER BY round(least(abs(p - k / 8), 1 - abs(p - k / 8)), 9), i) AS r FROM p, range(8) x(k))
        SELECT sequence_id, string_agg(i, '|' ORDER BY k) AS ordinals FROM t WHERE r = 1 GROUP BY 1
    """,
    "retimed_durations": """
        WITH r AS (SELECT DISTINCT ON (sequence_id) sequence_id, duration_ms AS d FROM latent_motion_training_rows ORDER BY sequence_id),
        c AS (SELECT sequence_id, list_transform(d, lambda x: round(x * 1000.0 / list_sum(d), 3)) AS s FROM r
            WHERE len(d) > 0 AND len(list_filter(d, lambda x: x IS NULL OR x <= 0)) = 0)
        SELECT sequence_id, array_to_string(list_transform(list_append(s[1:len(s) - 1], round(1000.0 - list_sum(s[1:len(s) - 1]), 3)), lambda x: CAST(round(x * 1000) AS BIGINT)), '|') AS durations FROM c
    """,
    "cumulative_phase": """
        WITH a AS (SELECT l_orderkey, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lineitem),
        e AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN sum(l_quantity) OVER (PARTITION BY l_orderkey) ELSE max(s) OVER (PARTITION BY l_orderkey) END AS t FROM a)
        SELECT l_orderkey, count(*) AS n_lines, round(sum(CASE WHEN t > 0 THEN s / t ELSE 0 END), 6) AS phase_sum, round(max(CASE WHEN t > 0 THEN s / t ELSE 0 END), 6) AS last_phase FROM e GROUP BY 1
    """,
    "timeline_fold": """
        WITH l AS (SELECT l_orderkey, l_returnflag, row_number() OVER w - 1 AS frame_index, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
            CAST(l_quantity AS BIGINT) AS ms FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        m AS (SELECT DISTINCT l_orderkey, start_ms FROM l), e AS (SELECT l_orderkey, max(start_ms + ms) AS t FROM l GROUP BY 1),
        s AS (SELECT m.l_orderkey, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY m.l_orderkey ORDER BY start_ms), t) - start_ms AS span_ms FROM m JOIN e USING (l_orderkey))
        SELECT s.l_orderkey, s.start_ms, span_ms, l.l_returnflag, CAST(max(frame_index) AS INTEGER) AS frame_index FROM s JOIN l ON l.l_orderkey = s.l_orderkey AND l.start_ms <= s.start_ms
        WHERE span_ms > 0 GROUP BY ALL
    """,
    "grid_cells": f"""
        WITH s AS (SELECT source_size[1] AS w, source_size[2] AS h FROM {_PHASED} WHERE len(source_size) = 2)
        SELECT CASE WHEN w < 16 OR h < 24 THEN 'oversize' WHEN w % 16 <> 0 OR h % 24 <> 0 THEN 'noncanonical' ELSE 'canonical' END AS status, count(*) AS n_sheets,
            CAST(sum((w // 16) * (h // 24)) AS BIGINT) AS n_cells, coalesce(max(CASE WHEN w >= 16 AND h >= 24 THEN (w // 16 - 1) * 16 END), -1) AS most_left,
            coalesce(max(CASE WHEN w >= 16 AND h >= 24 THEN (h // 24 - 1) * 24 END), -1) AS most_top FROM s GROUP BY 1
    """,
    "spaced_cells": """
        WITH s AS (SELECT DISTINCT source_size[1] AS w, source_size[2] AS h FROM prepared_broad_rows WHERE len(source_size) = 2),
        g AS (SELECT *, greatest((w - 2 + 2) // 16, 0) AS c, greatest((h - 4 + 6) // 16, 0) AS r FROM s)
        SELECT w, h, CASE WHEN c < 1 OR r < 1 THEN 'oversize' WHEN w - 2 - (c * 16 - 2) > 0 OR h - 4 - (r * 16 - 6) > 0 THEN 'noncanonical' ELSE 'canonical' END AS status,
            CASE WHEN c < 1 OR r < 1 THEN 0 ELSE c * r END::BIGINT AS n_cells, CASE WHEN c < 1 OR r < 1 THEN -1 ELSE (c - 1) * 16 + 2 END AS most_left, CASE WHEN c < 1 OR r < 1 THEN -1 ELSE (r - 1) * 16 + 4 END AS most_top FROM g
    """,
    "normalize_labels": r"""
        WITH v AS (SELECT DISTINCT verb, regexp_replace(regexp_replace(lower(regexp_replace(translate(verb,
                (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)) || chr(12288) || chr(160),
                (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)) || '  '),
                '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM latent_motion_training_rows),
        n AS (SELECT replace(name, ' ', '_') AS name, min(replace(canonical_action, ' ', '_')) AS c FROM (SELECT canonical_action, unnest(list_append(other_names, canonical_action)) AS name FROM action_vocabulary) GROUP BY 1),
        h AS (SELECT v.verb, k, n.name, n.c, row_number() OVER (PARTITION BY k ORDER BY length(n.name) DESC, n.name) AS r FROM v JOIN n ON contains('_' || k || '_', '_' || n.name || '_') WHERE k <> '')
        SELECT coalesce(v.verb, '(null)') AS verb, coalesce(h.c, '') AS label,
            CASE WHEN coalesce(v.verb, '') = '' THEN 0.0 WHEN h.name IS NULL THEN 0.0 WHEN h.name = v.k AND h.name = h.c THEN 1.0 WHEN h.name = v.k THEN 0.98 ELSE 0.85 END::DOUBLE AS confidence,
            CASE WHEN coalesce(v.verb, '') = '' THEN 'missing' WHEN h.name IS NULL THEN 'unmapped' WHEN h.name = v.k AND h.name = h.c THEN 'exact' WHEN h.name = v.k THEN 'alias' ELSE 'embedded_token' END AS method
        FROM v LEFT JOIN (SELECT DISTINCT k, name, c FROM h WHERE r = 1) h ON h.k = v.k
    """,
    "range_classify": """
        SELECT CASE WHEN p_size BETWEEN 1 AND 9 THEN 'core' WHEN p_size BETWEEN 10 AND 24 THEN 'attack' WHEN p_size BETWEEN 25 AND 39 THEN 'special' ELSE 'other' END AS kind,
            count(*) AS n_parts, array_to_string(list_sort(list_distinct(list(p_size))), '|') AS sizes FROM part GROUP BY 1
    """,
    "evidence_merge": """
        SELECT source_id, external_id, CASE WHEN count(DISTINCT title) = 1 THEN max(title) ELSE '' END AS title,
            CASE WHEN count(DISTINCT creator_name) = 1 THEN max(creator_name) ELSE '' END AS creator_name, count(DISTINCT creator_name) AS n_creators FROM corpus_items GROUP BY 1, 2
    """,
    "prompt_render": r"""
        WITH p AS (SELECT *, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS a, lower(trim(regexp_replace(p_type, '\s+', ' ', 'g'))) AS b, trim(regexp_replace(p_brand, '\s+', ' ', 'g')) AS c FROM part),
        n AS (SELECT *, len(string_split(a, ' ')) AS la, len(string_split(b, ' ')) AS lb, len(string_split(c, ' ')) AS lc FROM p),
        k AS (SELECT *, CASE WHEN la <= 3 THEN la ELSE 0 END AS u1 FROM n),
        t AS (SELECT *, u1 + lb <= 3 AND NOT (u1 > 0 AND contains(lower(a), b)) AS two FROM k),
        v AS (SELECT *, u1 + CASE WHEN two THEN lb ELSE 0 END AS u2 FROM t)
        SELECT p_partkey, concat_ws(', ', 'a ' || trim(p_name), 'of type ' || lower(trim(p_type)), CASE WHEN p_size % 2 = 0 THEN 'by ' || trim(p_brand) END) AS prompt,
            concat_ws('; ', CASE WHEN u1 > 0 THEN a END, CASE WHEN two THEN b END,
                CASE WHEN u2 + lc <= 3 AND NOT (u1 > 0 AND contains(lower(a), lower(c))) AND NOT (two AND contains(b, lower(c))) THEN c END) AS short_prompt FROM v
    """,
    "caption_leak": """
        WITH i AS (SELECT DISTINCT ON (id) * FROM corpus_items ORDER BY id)
        SELECT id, coalesce(length(regexp_extract(lower(title), '([a-z]+)', 1)) >= 4 AND contains(lower(description), regexp_extract(lower(title), '([a-z]+)', 1)), false) AS leaks FROM i
    """,
    "url_references": r"""
        WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s<>"'']+)', 1)) AS u FROM documents),
        c AS (SELECT DISTINCT doc_id, regexp_replace(u, '[.,;:!?)\]}]+$', '') AS url FROM u)
        SELECT doc_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM c
    """,
    "license_status": """
        WITH d AS (SELECT coalesce(nullif(regexp_extract(text, '(CC-[A-Z0-9-]+)', 1), ''), nullif(regexp_extract(text, '(?i)(public domain|all rights reserved)', 1), '')) AS label FROM documents)
        SELECT CASE WHEN label IS NULL THEN 'unknown' WHEN regexp_matches(lower(label), '(^|[^a-z])nc([^a-z]|$)|non-?commercial') THEN 'restricted'
            WHEN regexp_matches(lower(label), 'cc0|public domain|unlicense') THEN 'public_domain' WHEN regexp_matches(lower(label), 'cc-?by|apache|(^|[^a-z])mit([^a-z]|$)|gpl|bsd|ofl') THEN 'open' ELSE 'other' END AS status,
            coalesce(label, '') AS label, count(*) AS n_docs FROM d GROUP BY 1, 2
    """,
    "byte_tokens": r"""
        WITH t AS (SELECT DISTINCT row_index, nfc_normalize(regexp_replace(description, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) AS d
            FROM semantic_embedding_rows WHERE description IS NOT NULL),
        r AS (SELECT row_index, list_transform(range(octet_length(encode(d))), lambda i: CAST(('0x' || substr(hex(encode(d)), 2 * i + 1, 2)) AS INTEGER)) AS b FROM t WHERE d <> ''),
        c AS (SELECT row_index, b, CASE WHEN len(b) <= 96 THEN len(b) WHEN b[97] & 192 <> 128 THEN 96 WHEN b[96] & 192 <> 128 THEN 95 WHEN b[95] & 192 <> 128 THEN 94 ELSE 93 END AS n FROM r)
        SELECT row_index, array_to_string(list_concat(list_concat([1], list_transform(b[1:n], lambda x: x + 3)), list_concat([2], list_transform(range(96 - n), lambda x: 0))), ' ') AS tokens FROM c
    """,
    "humanized_identities": r"""
        WITH i AS (SELECT DISTINCT identity_id, translate(identity_id,
                (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
                (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i))) AS v FROM latent_motion_training_rows WHERE identity_id IS NOT NULL),
        l AS (SELECT identity_id, regexp_extract(v, '([^:/\\]*)$', 1) AS v FROM i),
        o AS (SELECT identity_id, regexp_replace(regexp_replace(regexp_replace(v, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '\.(png|gif|webp|apng|jpg|jpeg)$', '', 'i') AS v FROM l)
        SELECT identity_id, coalesce(nullif(lower(trim(regexp_replace(v, '[^0-9A-Za-z]+', ' ', 'g'))), ''), 'unknown subject') AS label FROM o
    """,
    "channel_statistics": """
        WITH v AS (SELECT unnest(range(len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        SELECT CAST(channel AS INTEGER) AS channel, count(*) AS n_values, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM v GROUP BY 1
    """,
    "pairwise_separation": """
        SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n_rows,
            round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_cosine
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1
    """,
    "nearest_match": """
        WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS c
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, id, round(c, 5) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s QUALIFY rank <= 3
    """,
    "retrieval_rank": """
        WITH v AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM embeddings),
        m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
        s AS (SELECT vec_id, e.label AS own, c.label AS other, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS s FROM embeddings e, c WHERE vec_id % 50 = 0),
        o AS (SELECT vec_id, own, max(s) FILTER (own = other) AS a, max(s) FILTER (own <> other) AS b FROM s GROUP BY 1, 2),
        r AS (SELECT o.*, 1 + count(*) FILTER (s.s > a AND s.other <> s.own) AS rank FROM o JOIN s USING (vec_id, own) GROUP BY ALL)
        SELECT vec_id AS query_id, own AS identity, rank, 1.0::DOUBLE / rank AS reciprocal_rank, round(a - b, 6) AS margin FROM r
    """,
    "reference_comparison": """
        WITH f AS (SELECT DISTINCT identity_id, sequence_id, rgba FROM prepared_broad_rows WHERE identity_id IS NOT NULL AND rgba IS NOT NULL),
        t AS (SELECT identity_id, min(sequence_id) AS rid, arg_min(rgba, sequence_id) AS ref FROM prepared_broad_rows WHERE identity_id IS NOT NULL AND rgba IS NOT NULL AND action = 'idle' GROUP BY 1),
        m AS (SELECT row_number() OVER () AS n, sequence_id, rid, rgba, ref FROM f JOIN t USING (identity_id) WHERE octet_length(rgba) = 256 AND octet_length(ref) = 256),
        e AS (SELECT n, hex(rgba) AS h, hex(ref) AS k, unnest(range(64)) AS i FROM m),
        p AS (SELECT n, i, {x}, {y} FROM e),
        b1 AS (SELECT n, (r // 16) * 256 + (g // 16) * 16 + b // 16 AS bin, count(*) / sum(count(*)) OVER (PARTITION BY n) AS w FROM p WHERE a > 0 GROUP BY 1, 2),
        b2 AS (SELECT n, (r2 // 16) * 256 + (g2 // 16) * 16 + b2 // 16 AS bin, count(*) / sum(count(*)) OVER (PARTITION BY n) AS w FROM p WHERE a2 > 0 GROUP BY 1, 2),
        o AS (SELECT b1.n, sum(least(b1.w, b2.w)) AS overlap FROM b1 JOIN b2 ON b1.n = b2.n AND b1.bin = b2.bin GROUP BY 1),
        s AS (SELECT n, sum(abs(r * a / 255.0 - r2 * a2 / 255.0) + abs(g * a / 255.0 - g2 * a2 / 255.0) + abs(b * a / 255.0 - b2 * a2 / 255.0) + abs(a - a2)) / 256 / 255 AS mae, sum(abs(a - a2)) / 64 / 255 AS ma,
            count(*) FILTER (a > 127 AND a2 > 127) AS both_n, count(*) FILTER (a > 127 OR a2 > 127) AS either_n, count(*) FILTER (a > 127) AS na, count(*) FILTER (a2 > 127) AS nb, sum(a) AS wa, sum(a2) AS wb,
            sum(a * (i % 8 + 0.5)) AS x1, sum(a * (i // 8 + 0.5)) AS y1, sum(a2 * (i % 8 + 0.5)) AS x2, sum(a2 * (i // 8 + 0.5)) AS y2 FROM p GROUP BY 1)
        SELECT DISTINCT sequence_id AS frame_id, rid AS reference_id, round(mae, 6) AS mae, round(ma, 6) AS alpha_mae, round(CASE WHEN either_n = 0 THEN 1.0 ELSE both_n / either_n END, 6) AS alpha_iou,
            round(CASE WHEN either_n = 0 THEN 1.0 WHEN na = 0 THEN 0.0 ELSE both_n / na END, 6) AS alpha_precision, round(CASE WHEN either_n = 0 THEN 1.0 WHEN nb = 0 THEN 0.0 ELSE both_n / nb END, 6) AS alpha_recall,
            round(CASE WHEN wa > 0 AND wb > 0 THEN sqrt((x1 / wa - x2 / wb) ** 2 + (y1 / wa - y2 / wb) ** 2) ELSE 0.0 END, 6) AS centre_shift,
            round(CASE WHEN either_n = 0 THEN 1.0 ELSE coalesce(overlap, 0.0) END, 6) AS histogram_overlap FROM s JOIN m USING (n) LEFT JOIN o USING (n)
    """.format(
        x=", ".join(f"CAST(('0x' || substr(h, 8 * i + {1 + 2 * j}, 2)) AS INTEGER) AS {c}" for j, c in enumerate("rgba")),
        y=", ".join(f"CAST(('0x' || substr(k, 8 * i + {1 + 2 * j}, 2)) AS INTEGER) AS {c}2" for j, c in enumerate("rgba")),
    ),
    "frame_statistics": f"""
        WITH {ONCE}, {PIXELS}
        SELECT sequence_id AS frame_id, CAST(count(*) FILTER (a > 0) AS INTEGER) AS n_visible, CAST(coalesce(min(i % 8) FILTER (a > 0), -1) AS INTEGER) AS "left", CAST(coalesce(min(i // 8) FILTER (a > 0), -1) AS INTEGER) AS top,
            CAST(coalesce(max(i % 8) FILTER (a > 0), -1) AS INTEGER) AS "right", CAST(coalesce(max(i // 8) FILTER (a > 0), -1) AS INTEGER) AS bottom,
            CAST(count(*) FILTER (a > 0 AND (i % 8 IN (0, 7) OR i // 8 IN (0, 7))) AS INTEGER) AS n_border, CAST(count(DISTINCT (r, g, b)) FILTER (a > 0) AS INTEGER) AS n_colours, round(avg(a), 6) AS mean_alpha,
            CAST(count(*) FILTER (a > 0 AND r = 255 AND g = 0 AND b = 255) AS INTEGER) AS n_sentinel, round(sum(a * (i % 8 + 0.5)) / greatest(sum(a), 1), 6) AS centre_x, round(sum(a * (i // 8 + 0.5)) / greatest(sum(a), 1), 6) AS centre_y
        FROM p GROUP BY 1
    """,
    "stream_event_windows": """
        WITH c AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total_value FROM events GROUP BY 1, 2)
        SELECT CAST(window_start AS TIMESTAMP) AS window_start, event_type, n_events, total_value FROM c WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)
    """,
    "stream_insert_or_ignore": "SELECT event_type, count(DISTINCT event_id) AS n_events FROM events GROUP BY 1",
}
