"""Corpus plan queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import corpora as C
from framewright.operators.skew import union_all
from framewright.session import load

BUCKETS = [(16, 16), (32, 32), (48, 32), (64, 64)]
SLOTS = {"idle": [3, 0, 5], "walk": [9, 8], "attack": [2, 1, 4]}
ANCHORS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (220, 20, 20), "green": (20, 200, 20), "blue": (20, 20, 220)}


def densified_grid(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("index"), (F.col("l_suppkey") % 8).cast("int").alias("lane"), "l_partkey")
    return C.densified(lines, "l_orderkey", "index", "lane", 8, "l_partkey", "l_partkey").groupBy("l_orderkey", "cell_state").agg(
        F.count("*").alias("n_cells"), F.coalesce(F.sum("l_partkey"), F.lit(0)).alias("part_sum"))


def overlay_layers(spark: SparkSession, root: str) -> DataFrame:
    layers = load(spark, root, "raw_properties").where("line_number is not null").select("script_path", "property_id", "line_number").distinct()
    return C.overlaid(layers, "script_path", "property_id", F.col("line_number") % 3 != 0).select("script_path", "property_id")


def inherited_attributes(spark: SparkSession, root: str) -> DataFrame:
    nodes = load(spark, root, "customer").select(
        "c_custkey", F.expr("nullif(c_custkey div 3, 0)").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).alias("segment"))
    return C.inherited(nodes, "c_custkey", "parent", "segment").select("c_custkey", F.coalesce("segment", F.lit("")).alias("segment"), F.coalesce("depth", F.lit(-1)).alias("depth"))


def include_closure(spark: SparkSession, root: str) -> DataFrame:
    n = load(spark, root, "nation").select(F.col("n_nationkey").alias("a"))
    edges = union_all([n.select("a", (F.col("a") + d).alias("b"), F.lit(o).alias("at")) for d, o in ((3, 0), (1, 1))]).where("b < 25")
    return C.included(spark, edges, "a", "b", "at").select("root", "document", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


def effective_definitions(spark: SparkSession, root: str) -> DataFrame:
    """Names by region digit over all included nations: the first declaration wins, and the last."""
    n = load(spark, root, "nation").select(F.col("n_nationkey").alias("a"))
    edges = union_all([n.select("a", (F.col("a") + d).alias("b"), F.lit(o).alias("at")) for d, o in ((3, 0), (1, 1))]).where("b < 25")
    facts = load(spark, root, "nation").select(F.col("n_nationkey").alias("doc"), F.col("n_regionkey").alias("k"), "n_name", F.lit(0).alias("line"))
    found = C.included(spark, edges, "a", "b", "at")
    one = C.effective(found, facts, "doc", "k", "n_name", "line", True).withColumnRenamed("n_name", "first_name")
    two = C.effective(found, facts, "doc", "k", "n_name", "line", False).withColumnRenamed("n_name", "last_name")
    return one.join(two, ["root", "k"])


def unique_match(spark: SparkSession, root: str) -> DataFrame:
    names = load(spark, root, "documents").where("source is not null").select("source").distinct()
    targets = load(spark, root, "mixture_targets").select("doc_source").distinct()
    index = targets.unionByName(targets.where("doc_source like 'k%'").select(F.upper("doc_source").alias("doc_source")))
    return C.unique_match(names, "source", "source", index, "doc_source").select("source", F.coalesce("matched_path", F.lit("")).alias("matched_path"), "match_state")


def idle_references(spark: SparkSession, root: str) -> DataFrame:
    frames = load(spark, root, "prepared_broad_rows").where("identity_id is not null").select("sequence_id", "identity_id", "action", F.coalesce("normalized_array_sha256", F.lit("")).alias("target")).distinct()
    out = C.idle_references(frames, "identity_id", "action", "sequence_id", "target")
    return out.select("sequence_id", F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("relation", F.lit("")).alias("relation"), "reason")


def rotation_families(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "lineitem").select("l_returnflag", "l_partkey", (F.col("l_suppkey") % 9).cast("int").alias("rotation"), (F.col("l_linestatus") == "F").alias("mirrored"))
    return C.rotation_families(rows, "l_returnflag", "l_partkey", "rotation", "mirrored")


def calibrated_choice(spark: SparkSession, root: str) -> DataFrame:
    lines = load(spark, root, "lineitem")
    out = C.calibrated(lines, "l_discount", [F.round("l_quantity", 6), -F.round("l_tax", 6)], "l_quantity", "l_tax")
    return out.select("l_discount", F.round("l_quantity", 6).alias("mean_quantity"), F.round("l_tax", 6).alias("mean_tax"), "n_samples", "chosen")


def caption_reuse(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang")
    hit, left, bad = C.reused(docs.where("lang is null").drop("lang"), docs.where("lang is not null"), "digest", "doc_id", "lang")
    return union_all([
        hit.select(F.lit("reused").alias("state"), F.col("doc_id").cast("string").alias("id"), "lang"),
        left.select(F.lit("open").alias("state"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("lang")),
        bad.select(F.lit("conflict").alias("state"), F.col("digest").alias("id"), F.lit("").alias("lang")),
    ])


def eligible_frames(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "all_pass").when(F.col("o_orderstatus") == "O", "all_fail").otherwise("mixed")
    eight = lambda c: (c % 8).cast("int")
    clips = load(spark, root, "orders").select(
        "o_orderkey", status.alias("status"), F.array(eight(k), eight(k + 3), eight(k + 5)).alias("passed"), F.array(eight(k), eight(k + 5), eight(k + 6)).alias("confirmed"),
        F.when(k % 3 == 0, F.array(eight(k))).alias("ambiguous"))
    return C.eligible_frames(clips, "status", "passed", "confirmed", "ambiguous").select("o_orderkey", F.array_join(F.transform("eligible", lambda x: x.cast("string")), "|").alias("eligible"))


def world_view(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("source_size")
    extents = load(spark, root, "prepared_broad_rows").where("size(source_size) = 2 and source_id is not null").select(
        "source_id", (-(size[0] / 2).cast("int")).alias("left"), (-size[1]).alias("top"), (size[0] / 2).cast("int").alias("right"), F.lit(0).alias("bottom"))
    return C.world_view(extents, "source_id", 256)


def smallest_bucket(spark: SparkSession, root: str) -> DataFrame:
    frames = load(spark, root, "prepared_broad_rows").where("size(source_size) = 2")
    bucket = F.coalesce(C.smallest_bucket(F.col("source_size")[0], F.col("source_size")[1], BUCKETS), F.lit("none"))
    return frames.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def aligned_reports(spark: SparkSession, root: str) -> DataFrame:
    part = load(spark, root, "part").select(F.col("p_partkey").alias("position"), "p_type", "p_retailprice")
    other = part.where("position % 4 <> 0").select("position", F.when(F.col("position") % 5 == 0, F.lit("?")).otherwise(F.col("p_type")).alias("p_type"), (F.col("p_retailprice") / 2).alias("p_retailprice"))
    return C.aligned_reports([part, other], "position", ["p_type"], "p_retailprice").where("comparable").select("position", "p_retailprice_0", "p_retailprice_1")


def anchored_palette(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    pixels = load(spark, root, "part").select("p_brand", (k * 37 % 256).alias("r"), (k * 91 % 256).alias("g"), (k * 53 % 256).alias("b"), F.col("p_size").cast("bigint").alias("n"))
    return C.anchored_palette(pixels, "p_brand", ("r", "g", "b"), "n", ANCHORS).select("p_brand", "colour", "n", F.round("share", 9).alias("share"), "rank")


def alias_groups(spark: SparkSession, root: str) -> DataFrame:
    per = load(spark, root, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("p"))
    return C.alias_groups(per.select(F.col("o_custkey").cast("string").alias("k"), "p"), "k", F.col("p")).withColumnRenamed("k", "o_custkey")


def slot_choice(spark: SparkSession, root: str) -> DataFrame:
    motions = load(spark, root, "latent_motion_training_rows").where("source_id is not null and action_index is not null")
    return C.first_of_slots(motions, "source_id", "action_index", SLOTS)


def motion_ticks(spark: SparkSession, root: str) -> DataFrame:
    events = load(spark, root, "events").select("user_id", "event_id", (F.col("event_id") % 7 - 1).cast("int").alias("ticks"))
    return C.motion_ticks(events, "user_id", "event_id", "ticks")


QUERIES = {f.__name__: f for f in (
    densified_grid, overlay_layers, inherited_attributes, include_closure, effective_definitions, unique_match, idle_references, rotation_families,
    calibrated_choice, caption_reuse, eligible_frames, world_view, smallest_bucket, aligned_reports, anchored_palette, alias_groups, slot_choice, motion_ticks,
)}

_CLOSURE = """
    e AS (SELECT n_nationkey AS a, n_nationkey + d AS b, o FROM nation, (VALUES (3, 0), (1, 1)) v(d, o) WHERE n_nationkey + d < 25),
    r AS (SELECT a AS root, b AS document, [o] AS path FROM e UNION ALL SELECT root, e.b, list_append(path, o) FROM r JOIN e ON e.a = r.document),
    m AS (SELECT root, document, min(path) AS path FROM r GROUP BY 1, 2)"""
_ANCHOR_ROWS = ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(ANCHORS.items()))
_SLOT_ROWS = ", ".join(f"('{s}', {n}, {r})" for s, ns in SLOTS.items() for r, n in enumerate(ns))

ORACLES = {
    "densified_grid": """
        WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS i, CAST(l_suppkey % 8 AS INTEGER) AS lane, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2, 3),
        g AS (SELECT l_orderkey, unnest(range(max(i) + 1)) AS i FROM l GROUP BY 1), c AS (SELECT * FROM g, range(8) x(lane)),
        j AS (SELECT c.l_orderkey, l.v AS own, f.v AS front FROM c LEFT JOIN l ON l.l_orderkey = c.l_orderkey AND l.i = c.i AND l.lane = c.lane
            LEFT JOIN l f ON f.l_orderkey = c.l_orderkey AND f.i = c.i AND f.lane = 0)
        SELECT l_orderkey, CASE WHEN own IS NOT NULL THEN 'own' WHEN front IS NOT NULL THEN 'fallback' ELSE 'missing' END AS cell_state, count(*) AS n_cells,
            CAST(coalesce(sum(coalesce(own, front)), 0) AS BIGINT) AS part_sum FROM j GROUP BY 1, 2
    """,
    "overlay_layers": """
        WITH l AS (SELECT DISTINCT script_path, property_id, line_number FROM raw_properties WHERE line_number IS NOT NULL),
        b AS (SELECT *, max(CASE WHEN line_number % 3 = 0 THEN property_id END) OVER (PARTITION BY script_path) AS base FROM l)
        SELECT script_path, property_id FROM b WHERE base IS NULL OR property_id >= base
    """,
    "inherited_attributes": """
        WITH RECURSIVE n AS (SELECT c_custkey AS k, nullif(c_custkey // 3, 0) AS p, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS s FROM customer),
        r AS (SELECT k, k AS at, 0 AS depth FROM n UNION ALL SELECT r.k, n.p, depth + 1 FROM r JOIN n ON n.k = r.at WHERE n.s IS NULL AND n.p IS NOT NULL)
        SELECT r.k AS c_custkey, coalesce(max(n.s), '') AS segment, CAST(coalesce(max(CASE WHEN n.s IS NOT NULL THEN depth END), -1) AS INTEGER) AS depth FROM r JOIN n ON n.k = r.at GROUP BY 1
    """,
    "include_closure": f"WITH RECURSIVE {_CLOSURE} SELECT root, document, array_to_string(path, '.') AS path FROM m",
    "effective_definitions": f"""
        WITH RECURSIVE {_CLOSURE}
        SELECT root, n_regionkey AS k, first(n_name ORDER BY path) AS first_name, last(n_name ORDER BY path) AS last_name FROM m JOIN nation ON n_nationkey = document GROUP BY 1, 2
    """,
    "unique_match": """
        WITH t AS (SELECT DISTINCT doc_source AS p FROM mixture_targets), i AS (SELECT p FROM t UNION ALL SELECT upper(p) FROM t WHERE p LIKE 'k%'),
        g AS (SELECT lower(p) AS k, count(*) n, min(p) p FROM i GROUP BY 1), d AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
        SELECT source, CASE WHEN n = 1 THEN p ELSE '' END AS matched_path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_state
        FROM d LEFT JOIN g ON g.k = lower(source)
    """,
    "idle_references": """
        WITH f AS (SELECT DISTINCT sequence_id, identity_id, action, coalesce(normalized_array_sha256, '') AS t FROM prepared_broad_rows WHERE identity_id IS NOT NULL),
        r AS (SELECT identity_id, count(DISTINCT sequence_id) n, min(sequence_id) k, arg_min(t, sequence_id) t FROM f WHERE action = 'idle' GROUP BY 1)
        SELECT sequence_id, CASE WHEN n = 1 THEN k ELSE '' END AS reference,
            CASE WHEN n IS NULL OR n > 1 THEN '' WHEN k = sequence_id THEN 'same_sequence' WHEN r.t = f.t THEN 'same_target' ELSE 'cross_sequence' END AS relation,
            CASE WHEN n IS NULL THEN 'no_reference' WHEN n > 1 THEN 'several_references' ELSE '' END AS reason FROM f LEFT JOIN r USING (identity_id)
    """,
    "rotation_families": """
        WITH g AS (SELECT l_returnflag, l_partkey, list_sort(list_distinct(list(l_suppkey % 9))) AS h, count(*) FILTER (l_linestatus <> 'F') AS n_direct, count(*) FILTER (l_linestatus = 'F') AS n_mirrored
            FROM lineitem GROUP BY 1, 2),
        m AS (SELECT *, list_filter(range(1, 9), lambda x: NOT list_contains(h, x)) AS miss FROM g)
        SELECT l_returnflag, l_partkey, n_direct, n_mirrored, CASE WHEN list_contains(h, 0) AND len(miss) = 8 THEN '' ELSE array_to_string(miss, '|') END AS missing,
            CASE WHEN list_contains(h, 0) AND len(miss) < 8 THEN 'mixed' WHEN list_contains(h, 0) THEN 'all_views' WHEN len(miss) = 0 THEN 'directional' ELSE 'incomplete' END AS kind FROM m
    """,
    "calibrated_choice": """
        WITH m AS (SELECT l_discount, round(avg(l_quantity), 6) AS q, round(avg(l_tax), 6) AS t, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_discount, q AS mean_quantity, t AS mean_tax, n AS n_samples, row_number() OVER (ORDER BY q, t DESC, l_discount) = 1 AS chosen FROM m
    """,
    "caption_reuse": """
        WITH d AS (SELECT doc_id, sha256(text) AS h, lang FROM documents), g AS (SELECT h, count(DISTINCT lang) n, arg_min(lang, doc_id) l FROM d WHERE lang IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN n = 1 THEN 'reused' ELSE 'open' END AS state, CAST(doc_id AS VARCHAR) AS id, CASE WHEN n = 1 THEN l ELSE '' END AS lang FROM d LEFT JOIN g USING (h) WHERE lang IS NULL
        UNION ALL SELECT 'conflict', h, '' FROM g WHERE n > 1
    """,
    "eligible_frames": """
        WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, [k % 8, (k + 3) % 8, (k + 5) % 8] AS p, [k % 8, (k + 5) % 8, (k + 6) % 8] AS c, CASE WHEN k % 3 = 0 THEN k % 8 END AS a FROM orders)
        SELECT k AS o_orderkey, CASE WHEN s = 'F' THEN '0|1|2|3|4|5|6|7' WHEN s = 'O' THEN ''
            ELSE array_to_string(list_sort(list_filter(p, lambda x: list_contains(c, x) AND x IS DISTINCT FROM a)), '|') END AS eligible FROM o
    """,
    "world_view": """
        WITH e AS (SELECT source_id, -(source_size[1] // 2) AS l, -source_size[2] AS t, source_size[1] // 2 AS r FROM prepared_broad_rows WHERE len(source_size) = 2 AND source_id IS NOT NULL),
        b AS (SELECT source_id, min(l) AS "left", min(t) AS top, max(r) AS "right", 0 AS bottom FROM e GROUP BY 1)
        SELECT *, CAST(256 // greatest("right" - "left", bottom - top) AS BIGINT) AS scale FROM b
    """,
    "smallest_bucket": """
        SELECT CASE WHEN w <= 16 AND h <= 16 THEN '16x16' WHEN w <= 32 AND h <= 32 THEN '32x32' WHEN w <= 48 AND h <= 32 THEN '48x32' WHEN w <= 64 AND h <= 64 THEN '64x64' ELSE 'none' END AS bucket,
            count(*) AS n_rows FROM (SELECT source_size[1] AS w, source_size[2] AS h FROM prepared_broad_rows WHERE len(source_size) = 2) GROUP BY 1
    """,
    "aligned_reports": "SELECT p_partkey AS position, p_retailprice AS p_retailprice_0, p_retailprice / 2 AS p_retailprice_1 FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0",
    "anchored_palette": f"""
        WITH x AS (SELECT p_brand, p_partkey, p_size AS n, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part), a AS (SELECT * FROM (VALUES {_ANCHOR_ROWS}) v(name, i, ar, ag, ab)),
        c AS (SELECT p_brand, p_partkey, n, arg_min(name, ((r - ar) * (r - ar) + (g - ag) * (g - ag) + (b - ab) * (b - ab)) * 10 + i) AS colour FROM x, a GROUP BY 1, 2, 3),
        s AS (SELECT p_brand, colour, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2)
        SELECT p_brand, colour, n, round(n / sum(n) OVER (PARTITION BY p_brand), 9) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, colour) AS rank FROM s
    """,
    "alias_groups": """
        WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS k, list_sort(list(o_orderpriority)) AS p FROM orders GROUP BY 1),
        g AS (SELECT p, min(k) AS first_member, count(*) AS n_members FROM p GROUP BY p HAVING count(*) > 1)
        SELECT k AS o_custkey, first_member, n_members FROM p JOIN g USING (p)
    """,
    "slot_choice": f"""
        WITH w AS (SELECT * FROM (VALUES {_SLOT_ROWS}) v(slot, n, r))
        SELECT source_id, slot, arg_min(action_index, r) AS action_index FROM (SELECT DISTINCT source_id, action_index FROM latent_motion_training_rows WHERE source_id IS NOT NULL) JOIN w ON n = action_index GROUP BY 1, 2
    """,
    "motion_ticks": """
        WITH e AS (SELECT user_id, event_id, event_id % 7 - 1 AS t FROM events)
        SELECT user_id, count(*) AS n_elements, CAST(sum(greatest(t, 0)) AS BIGINT) AS total_ticks, arg_max(t, event_id) = -1 AS holds, CAST(sum(greatest(t, 1)) AS BIGINT) AS weight FROM e GROUP BY 1
    """,
}
