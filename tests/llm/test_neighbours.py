import numpy as np

from framewright.llm import neighbours as N

SCHEMA = "row_index bigint, description string, embedding array<float>, copy_of int, unit string, place int"


def brute(ids, x, k):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[a, j], ids[j]))[:k]] for a, i in enumerate(ids)}


def table(spark, rows):
    return spark.createDataFrame([(i, "d", v, 1, "c", 2) for i, v in rows], SCHEMA)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate([centres[i % 60] + 0.25 * rng.normal(size=64) for i in range(900)]).reshape(900, 64).astype(np.float32)
    ids = list(range(900))
    want = brute(ids, x, 5)
    got = {}
    for r in N.nearest(spark, table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), window=64).collect():
        got.setdefault(r["row_index"], []).append(r["other"])
    assert set(got) == set(ids) and all(len(v) == 5 and i not in v for i, v in got.items())
    recall = np.mean([len(set(want[i]) & set(got[i])) / 5 for i in ids])
    assert recall >= 0.97


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64).astype(np.float32), rng.normal(size=64).astype(np.float32)
    rows = [(i, a.tolist()) for i in range(10)] + [(20, b.tolist()), (20, b.tolist())]
    rows += [(30, None), (31, [0.0] * 64), (32, [1.0] * 63), (33, [float("nan")] + [1.0] * 63), (34, [float("inf")] + [1.0] * 63), (None, a.tolist())]
    rows += [(35, [None] + [1.0] * 63)]
    got = {}
    for r in N.nearest(spark, table(spark, rows)).collect():
        got.setdefault(r["row_index"], []).append((r["rank"], r["other"]))
    assert set(got) == {*range(10), 20}
    for i in range(10):
        assert [o for _, o in sorted(got[i])] == [j for j in range(10) if j != i][:5]
    assert [o for _, o in sorted(got[20])] == [0, 1, 2, 3, 4]


def test_few_rows(spark):
    assert N.nearest(spark, table(spark, [])).count() == 0
    one = np.ones(64).tolist()
    assert N.nearest(spark, table(spark, [(1, one)])).count() == 0
    assert {(r["row_index"], r["other"]) for r in N.nearest(spark, table(spark, [(1, one), (2, [-1.0] * 64)])).collect()} == {(1, 2), (2, 1)}


def test_rounds_are_added_and_the_exact_way_closes_what_they_miss(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 64)).astype(np.float32)  # evenly spread: small windows miss most partners
    ids = list(range(700))
    want = brute(ids, x, 5)
    rows = table(spark, [(i, v.tolist()) for i, v in zip(ids, x)])

    def recall(**how):
        got = {}
        for r in N.nearest(spark, rows, window=16, curves=2, **how).collect():
            got.setdefault(r["row_index"], []).append(r["other"])
        return np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in ids])

    few = recall(most=2, target=0.0)
    more = recall(most=6, target=0.3)
    assert few < more and more >= 0.25
    assert recall(most=4) >= 0.999


def test_equal_single_precision_scores_stay_bounded():
    rng = np.random.default_rng(10)
    base = rng.normal(size=64)
    x = (base + 1e-7 * rng.normal(size=(6000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = N.best_of(np.arange(6000), x, np.arange(6000), x, 5)
    assert all(len(n) == 5 for n in found.column("near").to_pylist())


def test_hilbert_neighbours_touch():
    for axes, bits in ((2, 5), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = N.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_recall_in_a_dense_group_of_near_copies(spark):
    # a third of the table around one direction, as close as scaled and encoded copies, far denser than a cell of the curves
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    spread_out = np.repeat(rng.normal(size=(200, 64)), 10, axis=0) + 0.3 * rng.normal(size=(2000, 64))
    basis = rng.normal(size=(4, 64))
    dense = centre + 0.0004 * rng.normal(size=(1000, 4)) @ basis
    x = np.concatenate([spread_out, dense]).astype(np.float32)[rng.permutation(3000)]
    ids = list(range(3000))
    want = brute(ids, x, 5)
    got = {}
    for r in N.nearest(spark, table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]), window=32).collect():
        got.setdefault(r["row_index"], []).append(r["other"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    group = [i for i in ids if u[i] @ centre > 0.99]
    assert len(group) == 1000
    assert np.mean([len(set(want[i]) & set(got[i])) / 5 for i in group]) >= 0.9


def test_the_query_finds_every_partner_and_orders_ties_by_key(spark, tmp_path):
    # 700 evenly spread rows, which small partitions of the curves miss; near copies that differ beyond single precision; ties by signs
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    x[600:640] = x[600] * (1 + 3e-7 * rng.normal(size=(40, 64)))
    x[640] = x[641] = x[0]
    ids = list(range(700))
    want = brute(ids, x.astype(np.float64), 5)
    table(spark, [(i, v.tolist()) for i, v in zip(ids, x)]).write.parquet(str(tmp_path / "semantic_embedding_rows.parquet"))
    got = {}
    for r in N.p4_neighbours(spark, str(tmp_path)).orderBy("row_index", "rank").collect():
        got.setdefault(r["row_index"], []).append(r["other"])
    assert all(got[i] == want[i] for i in ids if not 600 <= i < 640)
    assert all(set(got[i]) <= set(range(600, 640)) and len(got[i]) == 5 for i in range(600, 640))


def test_keys_of_several_vectors_follow_the_sql(spark, tmp_path):
    # keys with other, scaled and opposite vectors, some of them copies of other keys' vectors, and one key with most of the rows
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x)] + [(3, x[50]), (3, 2 * x[3]), (3, 3 * x[3]), (7, -x[7]), (50, x[7]), (51, x[7]), (52, 2 * x[7]), (53, x[0])]
    rows += [(8, x[8]), (8, x[8])] + [(99, v) for v in rng.normal(size=(900, 64)).astype(np.float32)] + [(99, x[9]), (98, x[9])]
    table(spark, [(i, v.tolist()) for i, v in rows]).write.parquet(str(tmp_path / "semantic_embedding_rows.parquet"))
    held = {(i, v.tobytes()): v.astype(np.float64) for i, v in rows}
    keys = np.array([i for i, _ in held])
    u = np.stack([v / np.linalg.norm(v) for v in held.values()]).astype(np.float32).astype(np.float64)
    s = np.round(u @ u.T, 12)
    want = {}
    for i in set(keys.tolist()):
        met = sorted((-s[a, b], int(keys[b])) for a in np.flatnonzero(keys == i) for b in np.flatnonzero(keys != i))
        want[i] = [o for _, o in met[:5]]
    got = {}
    for r in N.p4_neighbours(spark, str(tmp_path)).orderBy("row_index", "rank").collect():
        got.setdefault(r["row_index"], []).append(r["other"])
        assert r["rank"] == len(got[r["row_index"]])
    assert got == want


def test_only_rows_of_other_keys_are_met():
    x = np.eye(64, dtype=np.float32)
    one = N.best_of(np.array([5, 5, 6]), x[[0, 1, 2]], np.array([5, 5, 5]), x[[0, 1, 1]], 5).to_pylist()
    assert [(r["row_index"], [n["other"] for n in r["near"]]) for r in one] == [(5, []), (6, [5, 5, 5])]


def test_tiles_keep_every_partner():
    # more columns than a tile, rising products so that all pass the first bound, and near copies that single precision can't tell apart
    rng = np.random.default_rng(14)
    centre = rng.normal(size=64)
    far = rng.normal(size=(N.TILE + 3, 64))
    for y in (np.concatenate([far, centre + 0.2 * rng.normal(size=(N.TILE, 64))]), centre + 1e-7 * rng.normal(size=(2 * N.TILE + 1, 64))):
        y = (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)
        ids, other = np.arange(len(y))[-40:], np.arange(len(y))
        for r in N.best_of(ids, y[ids], other, y, 5).to_pylist():
            i = r["row_index"]
            s = N.products(y[[i]], y, np.zeros(len(y), int), other)
            want = sorted((-v, o) for v, o in zip(s.tolist(), other.tolist()) if o != i)[:5]
            assert [(n["away"], n["other"]) for n in r["near"]] == want
