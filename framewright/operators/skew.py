"""Joins that keep hot keys from gathering in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that are treated as hot, the greatest first; adaptive execution splits what is left.
MOST_HOT = 4096
#: Rows from which a key can be hot at all.
LEAST_HOT = 10_000


def _tasks(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hottest(counts: DataFrame, key: str, total: int, n: str = "n", least: int | None = None, parts: int | None = None) -> list:
    """The keys of a table (key, n) that hold more rows than an average task gets, at most MOST_HOT of them."""
    parts = min(parts or _tasks(counts.sparkSession), MOST_HOT)
    bound = max(LEAST_HOT if least is None else least, -(-total // parts))
    return [r[0] for r in counts.where(F.col(n) >= bound).orderBy(F.desc(n)).select(key).limit(parts).collect()]


def hot_keys(df: DataFrame, key: str, parts: int | None = None, least: int | None = None) -> list:
    """Keys that hold more rows than an average task gets (and ``least`` rows): never more than there are tasks, or MOST_HOT."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    parts = min(parts or _tasks(df.sparkSession), MOST_HOT)
    least = LEAST_HOT if least is None else least
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n")).limit(parts).collect()
    if not top:
        return []
    total = counts.agg(F.sum("n")).first()[0]
    return [r[key] for r in top if r["n"] >= max(least, total / parts)]


def lookup_join(probe: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join ``probe`` with a lookup holding at most one row per key.

    Rows of hot keys meet their lookup rows, at most MOST_HOT, by broadcast and
    stay where they are; all other rows are shuffled by key as usual. Rows
    with a null key match nothing (kept by ``how='left'``).
    """
    hot = hot_keys(probe, key) if hot is None else hot
    if not hot:
        return probe.join(lookup, key, how)
    if len(hot) > MOST_HOT:
        raise ValueError("the broadcast side would not be bounded")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = lookup.where(F.col(key).isin(hot))
    return (
        probe.where(~is_hot)
        .join(lookup, key, how)
        .unionByName(probe.where(is_hot).join(F.broadcast(few), key, how))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, hot: list | None = None) -> DataFrame:
    """Inner join of many to many where a hot key is spread over ``salts`` tasks.

    The left rows of a hot key get one salt each, the right ones are repeated
    per salt; other keys keep salt 0 on both sides. The result is that of the
    plain join.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    spread = F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", spread)
        .join(right.withColumn("_salt", F.explode(every)), [key, "_salt"])
        .drop("_salt")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
