"""Connected components and leakage groups on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.skew import hottest, lookup_join
from framewright.session import Scratch

MAX_ROUNDS = 60


def components(
    spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge list.

    Hash-to-min: every node holds a cluster, at first itself and its neighbours.
    In each round it sends the whole cluster to the cluster's minimum and the
    minimum to every member, until nothing changes; then the minimum of a
    component holds all its nodes and every other node holds only the minimum.
    The number of rounds grows with the logarithm of the longest path.

    Clusters are kept as (node, member) rows, never as one list, so a cluster
    of any size is spread over tasks; minima are pre-aggregated, and a node that
    holds more pairs than an average task meets its minimum by broadcast. Each round is
    written to the shared folder, and the last but one is dropped. Null ends
    and self-loops: an edge with a null end is ignored, a self-loop makes its
    node known. Repeated edges count once. No edges give no rows.
    """
    scratch = Scratch(spark, "components")
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.col(src).alias("node"), F.col(dst).alias("member")
    )
    pairs = scratch.write(
        ends.unionByName(ends.select(F.col("member").alias("node"), F.col("node").alias("member")))
        .unionByName(ends.select("node", F.col("node").alias("member")))
        .unionByName(ends.select(F.col("member").alias("node"), "member"))
        .distinct(),
        "round0",
    )
    known = None
    for k in range(1, max_rounds + 1):
        least = scratch.write(pairs.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n")), f"least{k}")
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # the cluster of a component's minimum may hold most pairs: it meets its one row by broadcast
        joined = lookup_join(pairs, least.select("node", "least"), "node", hot=hottest(least, "node", total))
        sent = (
            joined.select(F.col("least").alias("node"), "member")
            .unionByName(joined.select(F.col("member").alias("node"), F.col("least").alias("member")))
            .distinct()
        )
        after = scratch.write(sent, f"round{k}")
        state = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("node", "member")), F.lit(0))).first()
        scratch.drop(f"round{k - 1}")
        scratch.drop(f"least{k}")
        pairs = after
        if state == known:
            return pairs.groupBy("node").agg(F.min("member").alias("component"))
        known = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def star_edges(rows: DataFrame, node: str, token: str) -> DataFrame:
    """(src, dst): each node tied to the smallest node of its token, so edges stay linear in rows."""
    held = rows.where(F.col(token).isNotNull() & F.col(node).isNotNull()).select(node, token).distinct()
    centre = held.groupBy(token).agg(F.min(node).alias("dst"))
    return held.join(centre, token).select(F.col(node).alias("src"), "dst")
