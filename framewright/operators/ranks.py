"""Row numbers and prefix sums within groups that no single task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import Scratch


def distributed_rank(
    spark: SparkSession, df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank"
) -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row within its group in the given order.

    Rows are range-partitioned by group and order, so a group of any size is
    cut into ranges; rows are numbered inside each range, and the counts of the
    ranges before it, prefix-summed per group, are added. ``order`` should end
    in a unique column, else ties are broken arbitrarily.

    The ranges are written once and read twice: their borders can't move
    between the two. Per group there is one count per range it touches.
    """
    scratch = Scratch(spark, "ranks")
    ranged = scratch.write(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranged",
    ).withColumn("_range", F.shiftright("_place", 33))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy("_place")
    placed = ranged.withColumn("_inside", F.row_number().over(inside))
    keys = [placed[g].eqNullSafe(offsets[g]) for g in group] + [placed["_range"] == offsets["_range"]]
    return placed.join(offsets, keys).select(
        *[placed[c] for c in df.columns], (F.col("_offset") + F.col("_inside")).alias(name)
    )


def running_sum(spark: SparkSession, df: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the row and those before it within its group, in an order without ties.

    As for ranks: ranges are summed inside, then the sums of the ranges before are added.
    """
    scratch = Scratch(spark, "sums")
    ranged = scratch.write(
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_place", F.monotonically_increasing_id()), "ranged"
    ).withColumn("_range", F.shiftright("_place", 33))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_inside", F.sum(amount).over(inside))
    keys = [placed[g].eqNullSafe(offsets[g]) for g in group] + [placed["_range"] == offsets["_range"]]
    return placed.join(offsets, keys).select(*[placed[c] for c in df.columns], (F.col("_offset") + F.col("_inside")).alias(name))
