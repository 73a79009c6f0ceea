"""Queries of aliased actions, coordinate evidence, shape checks, paired distances and pixel audits, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import evidence as V
from framewright.operators import kernels as K
from framewright.plans.sequences import ONCE, PIXELS
from framewright.session import load


def aliased_actions(spark: SparkSession, root: str) -> DataFrame:
    """The lines of an order as declared actions of a manifest; every second one aliases an action of its order, some of none."""
    lines = load(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("n"), F.min("l_suppkey").alias("s"))
    name = F.concat(F.lit("a"), F.col("n") % 4)
    target = F.when(F.col("n") % 2 == 0, F.concat(F.lit("a"), F.col("s") % 5))
    rows = lines.select("l_orderkey", "l_linenumber", name.alias("name"), target.alias("target"), (F.col("s") % 2).cast("int").alias("flips"), F.concat(F.lit("f"), "n").alias("frames"))
    out = V.aliased_actions(rows, "l_orderkey", "l_linenumber", "name", "target", "flips", "frames")
    return out.select("l_orderkey", "l_linenumber", "name", F.coalesce("shown", F.lit("")).alias("shown"), "mirrored", "fault")


def sheet_places(spark: SparkSession, root: str) -> DataFrame:
    """Items whose metadata, nested in a frame's document, hold sheet coordinates, by the path to them."""
    frames = F.try_variant_get(F.try_parse_json("metadata_json"), "$.frames", "int")
    wrapped = F.when(frames % 3 == 0, F.concat(F.lit('{"frame":{"note":1,"Source_Rect":[0,0,1,1]},"m":'), "metadata_json", F.lit("}"))).when(
        frames % 3 == 1, F.concat(F.lit('{"m":'), "metadata_json", F.lit(',"parts":[{"a":1},{"x":1,"Y":2,"w":3,"h":4}]}'))).otherwise(F.col("metadata_json"))
    return load(spark, root, "corpus_items").groupBy(F.coalesce(V.sheet_place(wrapped), F.lit("none")).alias("place")).agg(F.count("*").alias("n_items"))


def shape_checks(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose frames all have one size."""
    rows = load(spark, root, "prepared_broad_rows").where("source_id is not null")
    return V.shape_checks(rows, "source_id", F.array_join(F.transform("source_size", lambda v: v.cast("string")), "x"))


def paired_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Vectors taken two by two as targets, their neighbours as what was made of them: mean metrics over all pairs."""
    v = load(spark, root, "embeddings").select("vec_id", "embedding")
    at = lambda shift, name: v.select((F.col("vec_id") - shift).alias("vec_id"), F.col("embedding").alias(name))
    quads = at(0, "a").where("vec_id % 4 = 0").join(at(1, "b"), "vec_id").join(at(2, "c"), "vec_id").join(at(3, "d"), "vec_id")
    made = V.paired_metrics((F.col("c"), F.col("d")), (F.col("d"), F.col("c")), (F.col("a"), F.col("b")))
    means = quads.agg(F.count("*").alias("n_pairs"), *[F.avg(m).alias(n) for n, m in made.items()])
    return means.select("n_pairs", *[F.round(n, 6).alias(n) for n in made])


def pixel_quality(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "prepared_broad_rows").where("sequence_id is not null").groupBy("sequence_id").agg(F.min("rgba").alias("rgba"), F.min("source_id").alias("source_id"))
    found = V.pixel_quality(K.frame_statistics(rows, "sequence_id", "rgba"), rows, "sequence_id", "source_id")
    return found.select(F.coalesce("source_id", F.lit("none")).alias("source_id"), "reason", "n_frames")


QUERIES = {f.__name__: f for f in (aliased_actions, sheet_places, shape_checks, paired_metrics, pixel_quality)}

_D = "list_avg(list_transform(list_zip({x}, {y}), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
ORACLES = {
    "aliased_actions": """
        WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
        d AS (SELECT o, k, 'a' || (n % 4) AS name, CASE WHEN n % 2 = 0 THEN 'a' || (s % 5) END AS target, s % 2 AS flips, 'f' || n AS frames FROM l),
        u AS (SELECT a.o, a.k, max(b.k) AS up FROM d a JOIN d b ON b.o = a.o AND b.k < a.k AND b.name = a.target GROUP BY 1, 2),
        t AS (SELECT d.*, u.up FROM d LEFT JOIN u USING (o, k)),
        r AS (SELECT o, k, k AS pos, 0 AS f FROM t UNION ALL SELECT r.o, r.k, t.up, r.f + t.flips FROM r JOIN t ON t.o = r.o AND t.k = r.pos WHERE t.up IS NOT NULL),
        e AS (SELECT o, k, min(pos) AS pos, max(f) AS f FROM r GROUP BY 1, 2)
        SELECT e.o AS l_orderkey, e.k AS l_linenumber, m.name, CASE WHEN x.target IS NULL THEN x.frames ELSE '' END AS shown, CASE WHEN x.target IS NULL THEN e.f % 2 = 1 ELSE false END AS mirrored,
            CASE WHEN x.target IS NULL THEN '' WHEN e.pos = e.k THEN 'target_not_declared' ELSE 'target_quarantined' END AS fault
        FROM e JOIN t x ON x.o = e.o AND x.k = e.pos JOIN t m ON m.o = e.o AND m.k = e.k
    """,
    "sheet_places": """
        WITH f AS (SELECT CASE WHEN json_valid(metadata_json) THEN CAST(json_extract_string(metadata_json, '$.frames') AS INTEGER) END AS n FROM corpus_items)
        SELECT CASE n % 3 WHEN 0 THEN '$.frame.Source_Rect' WHEN 1 THEN '$.parts[1]' ELSE 'none' END AS place, count(*) AS n_items FROM f GROUP BY 1
    """,
    "shape_checks": """
        SELECT source_id, count(*) AS n_rows, count(DISTINCT array_to_string(source_size, 'x')) AS n_shapes, count(DISTINCT array_to_string(source_size, 'x')) = 1 AND count(*) FILTER (source_size IS NULL) = 0 AS can_stack
        FROM prepared_broad_rows WHERE source_id IS NOT NULL GROUP BY 1
    """,
    "paired_metrics": f"""
        WITH q AS (SELECT a.embedding AS a, b.embedding AS b, c.embedding AS c, d.embedding AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2
            JOIN embeddings d ON d.vec_id = a.vec_id + 3 WHERE a.vec_id % 4 = 0),
        m AS (SELECT {_D.format(x='a', y='b')} AS t, {_D.format(x='c', y='d')} AS g, {_D.format(x='c', y='a')} AS r0, {_D.format(x='d', y='b')} AS r1, {_D.format(x='c', y='b')} AS w0, {_D.format(x='d', y='a')} AS w1 FROM q)
        SELECT count(*) AS n_pairs, round(avg(t), 6) AS target_distance, round(avg(g), 6) AS generated_distance, round(avg(g / greatest(t, 1e-8)), 6) AS separation_ratio,
            round(avg(((r0 < w0)::INT + (r1 < w1)::INT) / 2), 6) AS preference_rate, round(avg(((r1 < w0)::INT + (r0 < w1)::INT) / 2), 6) AS swap_rate, round(avg((w0 - r0 + w1 - r1) / 2), 6) AS margin FROM m
    """,
    "pixel_quality": f"""
        WITH {ONCE}, {PIXELS}, s AS (SELECT sequence_id, count(*) FILTER (a > 0) AS v, count(*) FILTER (a > 0 AND (i % 8 IN (0, 7) OR i // 8 IN (0, 7))) AS nb,
            count(DISTINCT (r, g, b)) FILTER (a > 0) AS nc, count(*) FILTER (a > 0 AND r = 255 AND g = 0 AND b = 255) AS ns FROM p GROUP BY 1),
        y AS (SELECT sequence_id, list_filter([CASE WHEN v = 0 THEN 'blank' END, CASE WHEN nb >= 20 THEN 'touches_border' END, CASE WHEN ns > 0 THEN 'sentinel_colour' END, CASE WHEN nc > 16 THEN 'many_colours' END], lambda x: x IS NOT NULL) AS w FROM s),
        z AS (SELECT sequence_id, unnest(CASE WHEN len(w) = 0 THEN ['sound'] ELSE w END) AS reason FROM y)
        SELECT coalesce(o.source_id, 'none') AS source_id, reason, count(*) AS n_frames FROM z JOIN o USING (sequence_id) GROUP BY 1, 2
    """,
}
