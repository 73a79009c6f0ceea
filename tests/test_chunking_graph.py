import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framewright.operators.chunking import heavy_keys, key_profile, numbered
from framewright.operators.graph import components, star_edges
from framewright.operators.ranks import distributed_rank
from framewright.operators.skew import hot_keys, lookup_join, salted_join

SCHEMA = "key string, at timestamp, label string, n_rows int"


def rows(n, seed=1):
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)
    return [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), start + timedelta(minutes=rng.randrange(10_000)), rng.choice(["x", "y", None]), i)
        for i in range(n)
    ]


def expected(data):
    out = {}
    for key, at, label, _ in data:
        if key is None:
            continue
        e = out.setdefault(key, {"n": 0, "first": at, "last": at, "labels": set(), "late": 0, "prev": None})
        e["n"] += 1
        e["first"], e["last"] = min(e["first"], at), max(e["last"], at)
        if label:
            e["labels"].add(label)
        e["late"] += e["prev"] is not None and at < e["prev"]
        e["prev"] = at
    return out


@pytest.mark.parametrize("chunk", [7, None])
def test_profile_matches_a_plain_pass(spark, chunk):
    data = rows(600)
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    got = {r["key"]: r for r in key_profile(spark, df, "key", "at", "label", chunk_rows=chunk).collect()}
    want = expected(data)
    assert set(got) == set(want)
    for k, e in want.items():
        r = got[k]
        assert (r["n_rows"], r["first_arrival"], r["last_arrival"], r["distinct_labels"], r["late_rows"]) == (
            e["n"], e["first"], e["last"], len(e["labels"]), e["late"])
    if chunk:
        assert got["hot"]["n_chunks"] == -(-want["hot"]["n"] // chunk)
        assert got["hot"]["largest_chunk"] == chunk


def test_chunks_are_equal_and_numbers_dense(spark):
    df = spark.createDataFrame(rows(500), SCHEMA).repartition(5)
    placed, total, size = numbered(spark, df, chunk_rows=20)
    assert size == 20
    hot = placed.where("key = 'hot'").select("key_row", "chunk_id").collect()
    assert sorted(r["key_row"] for r in hot) == list(range(len(hot)))
    assert all(r["chunk_id"] == r["key_row"] // 20 for r in hot)
    assert total == sum(1 for r in rows(500) if r[0] is not None)


def test_empty_and_all_null_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert key_profile(spark, none, "key", "at", "label").count() == 0
    null = spark.createDataFrame([(None, None, None, 1)] * 3, SCHEMA)
    assert key_profile(spark, null, "key", "at").count() == 0
    untimed = spark.createDataFrame([("k", None, None, 1)] * 2, SCHEMA)
    r = key_profile(spark, untimed, "key", "at", "label").first()
    assert (r["n_rows"], r["first_arrival"], r["distinct_labels"], r["late_rows"]) == (2, None, 0, 0)


def test_heavy_keys_count_null_rows_in_the_total(spark):
    data = [("a", None, None, 1)] * 3 + [("b", None, None, 1)] + [(None, None, None, 1)] * 6
    df = spark.createDataFrame(data, SCHEMA)
    assert {r["key"] for r in heavy_keys(spark, df, "key", "at", 0.3).collect()} == {"a"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500), (None, 3), (1, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges * 2, "src int, dst int")
    got = {r["node"]: r["component"] for r in components(spark, df).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark, spark.createDataFrame([], "src int, dst int")).count() == 0


def test_star_edges_are_linear(spark):
    df = spark.createDataFrame([(i, "t") for i in range(50)] + [(1, None), (None, "t")], "node int, token string")
    edges = star_edges(df, "node", "token")
    assert edges.count() == 50
    assert {r["dst"] for r in edges.collect()} == {0}


def test_distributed_rank_equals_a_sort(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else rng.choice("abc"), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(data + [(None, 3, 900)], "g string, v int, id int").repartition(6)
    got = {r["id"]: r["rank"] for r in distributed_rank(spark, df, ["g"], ["v", "id"]).collect()}
    for g in {d[0] for d in data}:
        for place, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])), 1):
            assert got[d[2]] == place
    assert got[900] == 1


def test_skew_joins_equal_plain_joins(spark):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [("a", 1), (None, 2), ("z", 3)], "k string, i int")
    right = spark.createDataFrame([("h", 10), ("a", 20), ("q", 30)], "k string, v int")
    assert hot_keys(left, "k", least=10) == ["h"]
    for how in ("inner", "left"):
        a = lookup_join(left, right, "k", how, hot=["h"]).select("k", "i", "v").collect()
        b = left.join(right, "k", how).select("k", "i", "v").collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
    many = right.unionByName(right.withColumn("v", F.col("v") + 1))
    a = salted_join(left, many, "k", 4, hot=["h"]).select("k", "i", "v").collect()
    b = left.join(many, "k").select("k", "i", "v").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
