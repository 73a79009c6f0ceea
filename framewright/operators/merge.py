"""Keyed writes as batch merges: coalescing, last wins, insert or ignore, and the closure checks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesce_merge(
    observations: DataFrame, keys: list[str], order: list[str], keep_first: list[str] = (), overwrite: list[str] = (), fill: list[str] = ()
) -> DataFrame:
    """One row per key from its observations in order.

    ``keep_first``: the first observation's value; ``overwrite``: the last
    one's, null included; ``fill``: the last known value, so a later null
    doesn't wipe an earlier fact. Aggregates, not a window: partial results
    are combined before the shuffle, and a hot key is no sorted group.
    """
    at = F.struct(*order)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return observations.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(c) for c in keep_first],
        *[F.max_by(c, at).alias(c) for c in overwrite],
        *[known(c).alias(c) for c in fill],
        F.count("*").alias("n_observations"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order of each key; order should end in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """``current`` with ``updates`` (one row per key) applied: per column "keep", "overwrite" or "fill"."""
    old, new = current.alias("o"), updates.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    is_new, is_old = F.col("n._here").isNotNull(), F.col("o._here").isNotNull()
    old = current.withColumn("_here", F.lit(True)).alias("o")
    new = updates.withColumn("_here", F.lit(True)).alias("n")

    def merged(c: str) -> Column:
        how = policy.get(c, "overwrite")
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if how == "keep":
            return F.when(is_old, o).otherwise(n)
        return F.coalesce(n, o) if how == "fill" else F.when(is_new, n).otherwise(o)

    state = F.when(is_old & is_new, "updated").when(is_new, "created").otherwise("kept")
    return old.join(new, on, "full_outer").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys],
        *[merged(c).alias(c) for c in current.columns if c not in keys],
        state.alias("merge_state"),
    )


def insert_or_ignore(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those ``rows`` whose key it lacks, one per key."""
    fresh = rows.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh)


def readiness_diff(expected: DataFrame, indexed: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """Full comparison by key: status match, mismatched, missing (not indexed) or unregistered (not expected), and the facts that differ."""
    e = expected.withColumn("_e", F.lit(True)).alias("e")
    i = indexed.withColumn("_i", F.lit(True)).alias("i")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"i.{f}")), F.lit(f)) for f in facts]))
    status = (
        F.when(F.col("i._i").isNull(), "missing").when(F.col("e._e").isNull(), "unregistered")
        .when(F.size(differ) > 0, "mismatched").otherwise("match")
    )
    return e.join(i, [F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys], "full_outer").select(
        *[F.coalesce(F.col(f"e.{k}"), F.col(f"i.{k}")).alias(k) for k in keys],
        status.alias("status"),
        F.when(status == "mismatched", F.array_join(differ, "|")).otherwise("").alias("differing"),
    )


def closure(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on either side only, in both, and repeated keys; equal sets have no key on one side only."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_a"))
    b = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_b"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_a").isNull()).alias("n_right_only"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
        F.count_if(F.col("_a") > 1).alias("n_left_repeated"),
        F.count_if(F.col("_b") > 1).alias("n_right_repeated"),
    )


def key_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one value: the idempotence check of registered source keys."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def merged_union(frames: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): the union keyed by ``key``; equal repeats collapse, differing ones are reported."""
    from framewright.operators.skew import union_all

    every = union_all(frames)
    rest = [c for c in every.columns if c != key]
    grouped = every.groupBy(key).agg(
        F.count_distinct(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("_n"), F.first(F.struct(*rest)).alias("_r")
    )
    return grouped.where("_n = 1").select(key, "_r.*"), grouped.where("_n > 1").select(key, F.col("_n").alias("n_versions"))
