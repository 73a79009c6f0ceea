import random

from framewright.llm import grouped_splits as G

SCHEMA = "sequence_id string, identity_id string, source_file_sha256 string, split string, node string, component string, group string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)


def sha(n):
    return f"{n:064x}"


def expected(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for s, i, f, _ in rows:
        for token in (("i", i) if i else None, ("f", f) if f else None):
            if token:
                parent[find(("s", s))] = find(token)
    groups = {}
    for s, _, _, split in rows:
        groups.setdefault(find(("s", s)), []).append((s, split))
    out = {}
    for members in groups.values():
        if len({sp for _, sp in members if sp}) > 1:
            out |= {s: min(m for m, _ in members) for s, _ in members}
    return out


def test_torn_groups_match_union_find(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{i:03d}", rng.choice([None, f"i{rng.randrange(60)}"]), rng.choice([None, sha(rng.randrange(1, 80))]), rng.choice(["train", "train", "test", "validation", None])) for i in range(150)]
    rows += [(f"z{i}", f"chain{i // 2}", sha(1000 + (i + 1) // 2), "train" if i else "test") for i in range(40)]
    table(spark, rows + rows[:20]).write.parquet(f"{tmp_path}/prepared_broad_rows.parquet")
    got = {r["sequence_id"]: r["group_first_sequence_id"] for r in G.p6_found(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    placed = G.p6_splits(spark, str(tmp_path)).collect()
    assert sorted(r["sequence_id"] for r in placed) == sorted(r[0] for r in rows)
    by_group = {}
    for r in placed:
        by_group.setdefault(r["group_first_sequence_id"], set()).add(r["new_split"])
    assert all(len(s) == 1 for s in by_group.values())


def test_absent_values_tie_nothing(spark, tmp_path):
    rows = [("a", "unknown", "0" * 64, "train"), ("b", "Unknown", "0" * 64, "test"), ("c", " ", None, "test"), ("d", None, "xyz", "train"), ("e", "", "xyz", "test")]
    table(spark, rows).write.parquet(f"{tmp_path}/prepared_broad_rows.parquet")
    assert G.p6_found(spark, str(tmp_path)).count() == 0
    assert G.p6_splits(spark, str(tmp_path)).count() == 5


def test_empty(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/prepared_broad_rows.parquet")
    assert G.p6_found(spark, str(tmp_path)).count() == 0
    assert G.p6_splits(spark, str(tmp_path)).count() == 0


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) as k")
    got = df.select("k", G.rendezvous(df["k"]).alias("a"), G.rendezvous(df["k"], {"train": 0.8, "validation": 0.1, "test": 0.1, "new": 0.1}).alias("b")).collect()
    share = sum(r["a"] == "train" for r in got) / len(got)
    assert 0.78 < share < 0.82
    assert all(r["a"] == r["b"] or r["b"] == "new" for r in got)
