"""Queries of sequence metrics and pixel kernels; their oracles work on exploded pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import digest
from framewright.operators import sequences as Q
from framewright.session import load


def _once(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "prepared_broad_rows").where("sequence_id is not null").groupBy("sequence_id").agg(
        F.min("rgba").alias("rgba"), F.min("action").alias("action"), F.min("source_id").alias("source_id"), F.min(digest(F.col("normalized_array_sha256"))).alias("array"))


def sequence_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the frames of each source and action as one sequence."""
    rows = _once(spark, root).where("action is not null and source_id is not null").withColumn("seq", F.concat_ws("/", "source_id", "action"))
    found = Q.sequence_metrics(rows, "seq", "sequence_id", "rgba")
    return found.select("seq", "frame_count", "union_palette_size", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("seq", "frame_count", "union_palette_size")])


def decoded_frames(spark: SparkSession, root: str) -> DataFrame:
    found = Q.decoded_metrics(_once(spark, root), "sequence_id", "rgba", threshold=200)
    return found.select("frame_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "frame_id"])


def placed_frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames at twice their size on a canvas of 12, from (-3, 1): what is kept and what is clipped."""
    return Q.placed_frames(_once(spark, root), "sequence_id", "rgba", -3, 1, 2.0, 12, (4, 0))


def verified_frames(spark: SparkSession, root: str) -> DataFrame:
    return Q.verified_rows(_once(spark, root), "sequence_id", "rgba", "array").groupBy("state").agg(F.count("*").alias("n_rows"))


QUERIES = {f.__name__: f for f in (sequence_metrics, decoded_frames, placed_frames, verified_frames)}

_BYTE = "CAST(('0x' || substr(h, 8 * i + {k}, 2)) AS INTEGER)"
_HEX = "regexp_replace(regexp_replace(lower(normalized_array_sha256), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
ONCE = f"""o AS (SELECT sequence_id, min(rgba) AS rgba, min(action) AS action, min(source_id) AS source_id,
        min(CASE WHEN regexp_full_match({_HEX}, '[0-9a-f]{{64}}') AND NOT regexp_full_match({_HEX}, '0+') THEN {_HEX} END) AS arr FROM prepared_broad_rows WHERE sequence_id IS NOT NULL GROUP BY 1),
    w AS (SELECT * FROM o WHERE octet_length(rgba) = 256)"""
PIXELS = f"""e AS (SELECT sequence_id, hex(rgba) AS h, unnest(range(64)) AS i FROM w),
    p AS (SELECT sequence_id, i, {_BYTE.format(k=1)} AS r, {_BYTE.format(k=3)} AS g, {_BYTE.format(k=5)} AS b, {_BYTE.format(k=7)} AS a, substr(h, 8 * i + 1, 8) AS c FROM e)"""
ORACLES = {
    "sequence_metrics": f"""
        WITH {ONCE}, s AS (SELECT source_id || '/' || action AS seq, sequence_id, rgba, row_number() OVER (PARTITION BY source_id, action ORDER BY sequence_id) AS k FROM w WHERE action IS NOT NULL AND source_id IS NOT NULL),
        {PIXELS.replace('FROM w', 'FROM s')}, q AS (SELECT seq, k, p.* FROM p JOIN s USING (sequence_id)),
        fr AS (SELECT seq, k, count(*) FILTER (a > 0) AS v, count(*) FILTER (a > 0 AND a < 255) AS t, count(*) FILTER (a IN (0, 255)) AS cr, count(DISTINCT c) FILTER (a > 0) AS pal,
            CASE WHEN sum(a) > 0 THEN sum(a * (i % 8)) / sum(a) END AS cx, CASE WHEN sum(a) > 0 THEN sum(a * (i // 8)) / sum(a) END AS cy,
            max(i % 8) FILTER (a > 0) - min(i % 8) FILTER (a > 0) + 1 AS bw, max(i // 8) FILTER (a > 0) - min(i // 8) FILTER (a > 0) + 1 AS bh FROM q GROUP BY 1, 2),
        mv AS (SELECT y.seq, y.k, sum(abs(x.r * x.a / 255.0 - y.r * y.a / 255.0) + abs(x.g * x.a / 255.0 - y.g * y.a / 255.0) + abs(x.b * x.a / 255.0 - y.b * y.a / 255.0) + abs(x.a - y.a)) / 256 / 255 AS d,
            sum(abs(x.a - y.a)) / 64 / 255 AS da FROM q y JOIN q x ON x.seq = y.seq AND x.k = y.k - 1 AND x.i = y.i GROUP BY 1, 2),
        pl AS (SELECT DISTINCT seq, k, c FROM q WHERE a > 0),
        sh AS (SELECT y.seq, y.k, count(*) AS n FROM pl y JOIN pl x ON x.seq = y.seq AND x.k = y.k - 1 AND x.c = y.c GROUP BY 1, 2),
        ja AS (SELECT y.seq, y.k, CASE WHEN x.pal + y.pal = 0 THEN 0.0 ELSE 1 - coalesce(sh.n, 0) / (x.pal + y.pal - coalesce(sh.n, 0)) END AS j FROM fr y JOIN fr x ON x.seq = y.seq AND x.k = y.k - 1 LEFT JOIN sh ON sh.seq = y.seq AND sh.k = y.k),
        m AS (SELECT seq, avg(d) AS d, avg(da) AS da, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS dyn FROM mv GROUP BY 1), j AS (SELECT seq, avg(j) AS j FROM ja GROUP BY 1),
        u AS (SELECT seq, count(DISTINCT c) AS n FROM pl GROUP BY 1), d AS (SELECT seq, count(DISTINCT rgba) / count(*) AS r FROM s GROUP BY 1)
        SELECT fr.seq, count(*) AS frame_count, coalesce(max(u.n), 0) AS union_palette_size, round(sum(v) / (count(*) * 64), 6) AS visible_fraction, round(CASE WHEN sum(v) > 0 THEN sum(t) / sum(v) ELSE 0 END, 6) AS translucent_fraction,
            round(sum(cr) / (count(*) * 64), 6) AS crisp_fraction, round(avg(pal), 6) AS mean_palette_size, round(coalesce(max(j.j), 0), 6) AS palette_distance, round(max(d.r), 6) AS unique_ratio,
            round(coalesce(max(m.d), 0), 6) AS temporal_rgba_l1, round(coalesce(max(m.da), 0), 6) AS temporal_alpha_l1, round(coalesce(max(m.dyn), 0), 6) AS dynamic_fraction,
            round(coalesce(sqrt(var_pop(cx) + var_pop(cy)), 0), 6) AS centroid_jitter, round(coalesce(sqrt(var_pop(bw) + var_pop(bh)), 0), 6) AS box_jitter
        FROM fr LEFT JOIN m USING (seq) LEFT JOIN j USING (seq) LEFT JOIN u USING (seq) LEFT JOIN d USING (seq) GROUP BY fr.seq
    """,
    "decoded_frames": f"""
        WITH {ONCE}, {PIXELS}, d AS (SELECT *, CASE WHEN a >= 200 THEN 1 ELSE 0 END AS k FROM p)
        SELECT sequence_id AS frame_id, round(count(*) FILTER (a >= 127.5 AND k = 1) / greatest(count(*) FILTER (a >= 127.5 OR k = 1), 1), 6) AS alpha_iou, round(avg(abs(a / 255.0 - k)), 6) AS alpha_mae,
            round(sum(abs(r / 255.0 * a / 255.0 - k * r / 255.0) + abs(g / 255.0 * a / 255.0 - k * g / 255.0) + abs(b / 255.0 * a / 255.0 - k * b / 255.0) + abs(a / 255.0 - k)) / 256, 6) AS premultiplied_mae,
            round(coalesce(sum(CASE WHEN a > 0 AND k = 0 THEN (r + g + b) / 765.0 ELSE 0 END) / nullif(count(*) FILTER (a > 0), 0), 0), 6) AS visible_rgb_mae FROM d GROUP BY 1
    """,
    "placed_frames": f"""
        WITH {ONCE}, {PIXELS}, big AS (SELECT sequence_id, 4 - 6 + 2 * (i % 8) + dx AS x, 2 + 2 * (i // 8) + dy AS y FROM p, range(2) t(dx), range(2) u(dy) WHERE a > 0)
        SELECT w.sequence_id AS frame_id, CAST(count(*) FILTER (x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11) AS INTEGER) AS n_kept, CAST(count(*) FILTER (NOT (x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 11)) AS INTEGER) AS n_clipped
        FROM w LEFT JOIN big USING (sequence_id) GROUP BY 1
    """,
    "verified_frames": f"WITH {ONCE} SELECT CASE WHEN rgba IS NULL THEN 'absent' WHEN arr IS NULL THEN 'unnamed' WHEN sha256(rgba) = arr THEN 'verified' ELSE 'differs' END AS state, count(*) AS n_rows FROM o GROUP BY 1",
}
