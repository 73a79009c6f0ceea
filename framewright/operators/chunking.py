"""Per-key results without imbalance, by exact offset chunking.

Rows are numbered within their key: counts per stored partition and key give,
by prefix sums, the offset at which each partition starts counting. A key with
more than ``chunk_rows`` rows is then cut into chunks of exactly that many, each
chunk is reduced on its own, and the ordered chunk states are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import Scratch, parallel_tasks

#: Most rows of a chunk, and most offsets (hot keys times stored partitions) that are broadcast.
MOST_ROWS, MOST_OFFSETS = 4_000_000, 200_000


def numbered(
    spark: SparkSession, df: DataFrame, key: str = "key", chunk_rows: int | None = None, parts: int | None = None
) -> tuple[DataFrame, int, int]:
    """``df`` with ``row_pos`` (stored order), ``key_row`` (from 0 within a hot key) and ``chunk_id``.

    Returns (rows, number of rows, rows per chunk). A key of at most
    ``chunk_rows`` rows is one chunk and needs no number (``key_row`` null).
    By default a chunk holds what an average task would, and never more than
    MOST_ROWS. Only keys above ``chunk_rows`` get offsets, so there are fewer
    than rows / chunk_rows of them times the number of stored partitions; they
    are broadcast only where that product is at most MOST_OFFSETS.
    Null keys are dropped: an absent key groups with nothing.
    """
    scratch = Scratch(spark, "chunks")
    stored = scratch.write(
        df.where(F.col(key).isNotNull()).withColumn("row_pos", F.monotonically_increasing_id()), "rows"
    ).withColumn("_part", F.shiftright("row_pos", 33))
    per_part = scratch.write(stored.groupBy(key, "_part").agg(F.count("*").alias("_n")), "counts")
    total = per_part.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    size = chunk_rows or max(1, min(math.ceil(total / (parts or 4 * parallel_tasks(spark))), MOST_ROWS))
    hot = per_part.groupBy(key).agg(F.sum("_n").alias("_all")).where(F.col("_all") > size).drop("_all")
    hot = scratch.write(hot, "hot")
    # beyond the bound both sides are shuffled by key and partition, which no key can crowd
    few = hot.count() * max(per_part.select("_part").distinct().count(), 1) <= MOST_OFFSETS
    offer = F.broadcast if few else (lambda x: x)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.join(offer(hot), key).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = Window.partitionBy(key, "_part").orderBy("row_pos")
    big = (
        stored.join(offer(hot), key)
        .withColumn("_in_part", F.row_number().over(placed) - 1)
        .join(offer(offsets.drop("_n")), [key, "_part"])
        .withColumn("key_row", F.col("_offset") + F.col("_in_part"))
        .withColumn("chunk_id", F.floor(F.col("key_row") / size))
        .drop("_offset", "_in_part")
    )
    small = (
        stored.join(offer(hot), key, "left_anti")
        .withColumn("key_row", F.lit(None).cast("bigint"))
        .withColumn("chunk_id", F.lit(0).cast("bigint"))
    )
    return small.unionByName(big).drop("_part"), total, size


def key_profile(
    spark: SparkSession,
    df: DataFrame,
    key: str,
    at: str,
    label: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Per key: rows, first and last arrival, distinct labels, and rows that lie after a later arrival.

    ``late_rows`` depends on the stored order: a row counts when its arrival is
    earlier than that of the row of the same key stored just before it. Inside
    a chunk this is a window; over chunk borders the merge compares the last
    arrival of one chunk with the first of the next.

    Nulls: rows without key are left out, null times and labels are ignored.
    An empty table gives an empty result. Extra columns are ignored.
    """
    slim = df.select(
        F.col(key).alias("key"),
        F.col(at).alias("at"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
    )
    rows, _, _ = numbered(spark, slim, chunk_rows=chunk_rows)
    ordered = Window.partitionBy("key", "chunk_id").orderBy("row_pos")
    states = (
        rows.withColumn("_late", (F.col("at") < F.lag("at").over(ordered)).cast("int"))
        .groupBy("key", "chunk_id")
        .agg(
            F.count("*").alias("n"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.coalesce(F.sum("_late"), F.lit(0)).alias("late"),
            F.min_by("at", "row_pos").alias("head_at"),
            F.max_by("at", "row_pos").alias("tail_at"),
        )
    )
    along = Window.partitionBy("key").orderBy("chunk_id")  # at most rows / chunk size states per key
    merged = (
        states.withColumn("_border", (F.col("head_at") < F.lag("tail_at").over(along)).cast("int"))
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("*").alias("n_chunks"),
            F.max("n").alias("largest_chunk"),
            F.min("first_at").alias("first_arrival"),
            F.max("last_at").alias("last_arrival"),
            F.sum(F.col("late") + F.coalesce(F.col("_border"), F.lit(0))).alias("late_rows"),
        )
    )
    if label is None:
        return merged.withColumn("distinct_labels", F.lit(None).cast("bigint"))
    labels = (
        rows.where(F.col("label").isNotNull())
        .groupBy("key", "label")
        .agg(F.lit(1))
        .groupBy("key")
        .agg(F.count("*").alias("distinct_labels"))
    )
    return merged.join(labels, "key", "left").withColumn(
        "distinct_labels", F.coalesce(F.col("distinct_labels"), F.lit(0).cast("bigint"))
    )


def heavy_keys(spark: SparkSession, df: DataFrame, key: str, at: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of ``df``, rows without key included in the total."""
    total = df.count()
    return key_profile(spark, df, key, at).where(F.col("n_rows") >= share * total)
