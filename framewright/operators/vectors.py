"""Vectors: normalization, channel statistics, separation within groups, nearest match and retrieval rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.skew import union_all
from framewright.session import parallel_tasks


def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector gives null."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def standardized(vector: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std per channel; a channel without spread becomes 0."""
    centred = F.zip_with(vector, mean, lambda x, m: x.cast("double") - m)
    return F.zip_with(centred, std, lambda x, s: F.when(s > 0, x / s).otherwise(0.0))


def channel_statistics(df: DataFrame, vector: str) -> DataFrame:
    """(channel, n_values, mean, std) over all vectors, population deviation; nulls and NaN are left out."""
    values = df.select(F.posexplode(vector).alias("channel", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return values.groupBy("channel").agg(
        F.count("*").alias("n_values"), F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std")
    )


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n_rows, centroid)."""
    sums = df.select(group, F.posexplode(vector).alias("channel", "v")).groupBy(group, "channel").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return sums.groupBy(group).agg(
        F.max("n").alias("n_rows"), F.transform(F.array_sort(F.collect_list(F.struct("channel", "m"))), lambda x: x["m"]).alias("centroid")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def group_separation(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Per group of unit vectors: rows and the mean cosine over all its pairs.

    The sum over pairs follows from the length of the sum vector, (|s|^2 - n)
    / 2, so no pair is ever formed.
    """
    units = df.select(group, unit(F.col(vector)).alias("u")).where("u is not null")
    middle = centroids(units, group, "u")
    n = F.col("n_rows")
    length = dot(F.col("centroid"), F.col("centroid")) * n * n
    return middle.select(group, n, F.when(n > 1, (length - n) / (n * (n - 1))).alias("mean_cosine"))


def _best_of_block(k: int):
    """Per pair of a query block and a row block the k nearest rows of each query."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        asks = table["asks"].to_numpy(bool)
        asked, held = table[asks], table[~asks]
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        ids, own = asked["id"].to_numpy(), held["id"].to_numpy()
        x = np.stack(held["u"].to_numpy()).astype(np.float64)
        names, found, scores = [], [], []
        for at in range(0, len(ids), 512):
            q = np.stack(asked["u"].iloc[at : at + 512].to_numpy()).astype(np.float64)
            s = np.round(q @ x.T, 9)
            s[ids[at : at + 512][:, None] == own[None, :]] = -9
            take = min(k, s.shape[1])
            bound = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
            row, col = np.nonzero((s >= bound[:, None]) & (s > -5))
            order = np.lexsort((own[col], -s[row, col], row))
            row, col = row[order], col[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            names.append(ids[at : at + 512][row[kept]])
            found.append(own[col[kept]])
            scores.append(s[row[kept], col[kept]])
        return pd.DataFrame({"query_id": np.concatenate(names), "id": np.concatenate(found), "cosine": np.concatenate(scores)})

    return run


def nearest_match(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 1, block: int = 2000, rows_of_block: int = 50_000) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest rows of every query by exact search.

    Queries are a stated set. Query blocks meet row blocks, one task each, and
    their best rows are merged per query; nothing is collected, and the plan
    doesn't grow with the queries. Ties go to the smaller key.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), unit(F.col(vector)).alias("u"), is_query.alias("q")).where("u is not null")
    size = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    across, down = max(1, -(-size["q"] // block)), max(-(-size["n"] // rows_of_block), min(parallel_tasks(df.sparkSession), -(-size["n"] // 1000)), 1)
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("q").select("id", "u", F.lit(True).alias("asks"), place(across).alias("a"), every(down).alias("b"))
    held = rows.select("id", "u", F.lit(False).alias("asks"), place(down).alias("b"), every(across).alias("a")).select("id", "u", "asks", "a", "b")
    found = asked.unionByName(held).groupBy("a", "b").applyInPandas(_best_of_block(k), "query_id bigint, id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _against_centroids(queries: list[tuple]):
    """A scan over centroids that counts, per query, those nearer than its own and keeps the best other."""
    ids = np.array([q[0] for q in queries])
    names = np.array([q[1] for q in queries])
    own = np.array([q[3] for q in queries])
    vectors = np.array([q[2] for q in queries], np.float64).reshape(len(queries), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(ids):
                continue
            s = np.round(vectors @ np.stack(b["c"].to_numpy()).astype(np.float64).T, 9)
            other = names[:, None] != b["identity"].to_numpy()[None, :]
            yield pd.DataFrame({
                "query_id": ids, "n_nearer": ((s > own[:, None]) & other).sum(1), "best_other": np.where(other, s, -9.0).max(1),
            })

    return run


def retrieval_rank(df: DataFrame, key: str, vector: str, identity: str, is_query: Column, block: int = 2000) -> DataFrame:
    """Per query the rank of its own identity among the identities' centroids, its reciprocal, and the margin to the best other.

    Queries are a stated set, taken in blocks; each block meets one vector per
    identity in one scan. An identity alone in the table has margin null.
    """
    units = df.select(F.col(key).alias("query_id"), F.col(identity).alias("identity"), unit(F.col(vector)).alias("u"), is_query.alias("q")).where("u is not null and identity is not null")
    middle = centroids(units, "identity", "u").select("identity", unit(F.col("centroid")).alias("c")).where("c is not null")
    asked = units.where("q").join(middle, "identity").select("query_id", "identity", "u", F.round(dot(F.col("u"), F.col("c")), 9).alias("own"))
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        queries = sorted((r["query_id"], r["identity"], list(r["u"]), r["own"]) for r in part.collect())
        parts.append(middle.mapInPandas(_against_centroids(queries), "query_id bigint, n_nearer bigint, best_other double"))
    found = union_all(parts).groupBy("query_id").agg(F.sum("n_nearer").alias("n"), F.max("best_other").alias("best"))
    rank = F.col("n") + 1
    return asked.join(found, "query_id").select(
        "query_id", "identity", rank.alias("rank"), (1 / rank).alias("reciprocal_rank"),
        F.when(F.col("best") > -5, F.round(F.col("own") - F.col("best"), 6)).alias("margin"),
    )
