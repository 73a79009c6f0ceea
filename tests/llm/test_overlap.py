import numpy as np
import pytest

from framewright.llm import overlap as M

SCHEMA = (
    "sequence_id string, identity_id string, action string, split string, source_id string, source_file_sha256 string, "
    "normalized_array_sha256 string, rgba binary, key string, pic int, train boolean, spans string"
)


def frame(rng, visible=44):
    x = rng.integers(0, 256, (64, 4)).astype(np.uint8)
    x[:, 3] = 255
    x[rng.permutation(64)[: 64 - visible]] = 0
    return x


def row(sid, split, x=None, identity=None, digest=None):
    data = None if x is None else bytearray(x.tobytes()) if isinstance(x, np.ndarray) else bytearray(x)
    return (sid, identity, None, split, "src", None, digest, data, "clash", 7, None, "s")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, rows):
    pairs = M.Overlaps(spark, table(spark, rows)).pairs().collect()
    return {(r["train_id"], r["eval_id"]): r["kind"] for r in pairs}, [(r["train_id"], r["eval_id"], r["kind"]) for r in pairs]


def test_near_pictures_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, frames, splits = [], [], []
    for i in range(120):
        x = frame(rng, int(rng.integers(1, 64)))
        copies = [x]
        for amount in (1, 2):
            y = x.astype(int)
            y[x[:, 3] > 0, :3] += rng.integers(-amount, amount + 1, (int((x[:, 3] > 0).sum()), 3))
            copies.append(np.clip(y, 0, 255).astype(np.uint8))
        y = x.copy()
        y[rng.integers(64)] = 0
        copies.append(y)
        z = x.copy()
        z[z[:, 3] > 0, :3] //= 2
        copies.append(z)
        for k, c in enumerate(copies):
            frames.append(c)
            splits.append(["train", "test", "val", "test", "dev"][k])
    values = M.premultiplied(np.stack(frames)).astype(float).reshape(len(frames), -1)
    want = set()
    for i, s in enumerate(splits):
        if s != "train" or not values[i].any():
            continue
        away = np.abs(values - values[i]).mean(1)
        want |= {(f"q{i:04d}", f"q{j:04d}") for j in np.flatnonzero(away <= M.NEAR) if splits[j] != "train" and (frames[j][:, 3] > 0).any()}
    rows = [row(f"q{i:04d}", s, x) for i, (s, x) in enumerate(zip(splits, frames))]
    got, _ = found(spark, rows)
    assert set(got) <= want
    assert len(set(got) & want) >= 0.97 * len(want)


def test_digests_identities_blanks_and_nulls(spark):
    rng = np.random.default_rng(1)
    x = frame(rng)
    hidden = x.copy()
    hidden[:, 3] = 0
    a, b = "ab" * 32, "cd" * 32
    rows = [
        row("t1", "train", x, "One:Fox-1", a), row("e1", "TEST", None, "one fox 1", None), row("e2", "val", None, None, a.upper()),
        row("e3", "test ", x, None, None), row("n1", None, x, "One:Fox-1", a), row("t2", "training", hidden, "unknown", b),
        row("e4", "test", hidden, "Unknown", b), row("e5", "test", None, None, b), row("t3", "train", b"short", None, "0" * 64),
        row("e6", "test", b"short", "", "0" * 64), row("t1", "train", x, "One:Fox-1", a), row(None, "train", x, "One:Fox-1", a),
    ]
    got, every = found(spark, rows)
    assert {k for k in got} == {("t1", "e1"), ("t1", "e2"), ("t1", "e3")}
    assert len(every) == len(set(every))


def test_hidden_colour_does_not_count(spark):
    rng = np.random.default_rng(2)
    x = frame(rng)
    y = x.copy()
    y[y[:, 3] == 0, :3] = 200
    got, _ = found(spark, [row("t", "train", x), row("e", "test", y)])
    assert set(got) == {("t", "e")}


def test_copies_on_both_sides_and_empty(spark):
    x = frame(np.random.default_rng(3))
    got, _ = found(spark, [row(f"t{i}", "train", x) for i in range(5)] + [row(f"e{i}", "test", x) for i in range(4)])
    assert len(got) == 20
    assert found(spark, [])[0] == {}
    assert M.Overlaps(spark, table(spark, [])).records.count() == 0


@pytest.mark.parametrize("visible", [1, 3, 64])
def test_every_picture_has_a_suffix(visible):
    x = frame(np.random.default_rng(visible), visible)[None]
    owner, _ = M.suffixes(x)
    assert len(owner) >= max(1, visible - M.DEPTH + 1 if visible == 64 else 1)


def test_words_order_and_cover_like_the_suffixes():
    rng = np.random.default_rng(12)
    x = np.stack([frame(rng, int(rng.integers(M.DEPTH, 65))) for _ in range(40)])
    owner, word = M.suffixes(x)
    assert (word >= 0).all()
    # the pixels of each word are visible ones of its picture, and all of them are covered by its suffixes unless a wide gap cuts them off
    masks = M.span_mask(word, np.full(len(word), M.DEPTH)).view(np.uint64)
    for i in range(len(x)):
        seen = sum(1 << int(p) for p in np.flatnonzero(x[i, :, 3]))
        union = int(np.bitwise_or.reduce(masks[owner == i])) if (owner == i).any() else 0
        assert union & ~seen == 0
        if np.diff(np.flatnonzero(x[i, :, 3])).max() < M.FAR:
            assert union == seen


def test_intervals_give_all_pairs_of_shared_prefixes_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(13)
    word = np.sort(rng.integers(0, 400, 3000) << 8)
    pic, seat = rng.permutation(3000), rng.integers(0, 2, 3000) << 30
    table = pa.table({"word": word, "pic": pic, "seat": seat})
    got = [tuple(r.values())[:2] for b in M._intervals(iter(table.to_batches(max_chunksize=97))) for r in b.to_pylist()]
    key = word >> (M.SYMBOL * (M.DEPTH - M.LEAST))
    want = [
        (int(pic[i]), int(pic[j])) for i in np.flatnonzero(seat > 0) for j in np.flatnonzero((key == key[i]) & (seat == 0))
    ]
    assert sorted(got) == sorted(want)


def test_one_altered_pixel_per_row_shares_a_span():
    rng = np.random.default_rng(14)
    x = np.full((300, 64, 4), 100, np.uint8)
    x[:, :, 3] = 255
    y = x.copy()
    for i in range(len(y)):
        for r in range(8):
            y[i, 8 * r + rng.integers(8), rng.integers(3)] += 60
    _, one = M.suffixes(x[:1])
    owner, two = M.suffixes(y)
    shared = np.isin(two >> (M.SYMBOL * (M.DEPTH - M.LEAST)), one >> (M.SYMBOL * (M.DEPTH - M.LEAST)))
    assert set(owner[shared].tolist()) == set(range(300))


def test_crowded_intervals_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(15)
    x = frame(rng)
    rows, want = [], set()
    for i in range(60):
        y = x.astype(int)
        y[np.flatnonzero(x[:, 3])[i % 40], i % 3] ^= 1
        rows.append(row(f"q{i:02d}", "train" if i % 3 else "test", y.astype(np.uint8)))
    plain = set(found(spark, rows)[0])
    monkeypatch.setattr(M, "CROWDED", 1)
    monkeypatch.setattr(M, "SAMPLED", 1)
    assert set(found(spark, rows)[0]) == plain and plain


def test_packed_sums_bound_the_distance(spark):
    rng = np.random.default_rng(8)
    x, y = np.stack([frame(rng) for _ in range(50)]), np.stack([frame(rng) for _ in range(50)])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(M.packed(M.row_sums(x))[0], M.packed(M.row_sums(y))[0])], "a bigint, b bigint")
    gaps = [r[0] for r in df.select(M._gap("a", "b")).collect()]
    away = np.abs(M.premultiplied(x) - M.premultiplied(y)).sum((1, 2))
    assert all(g <= d + 8 for g, d in zip(gaps, away))


def test_report_counts_what_the_pairs_say(spark):
    rng = np.random.default_rng(16)
    rows = []
    for i in range(60):
        x = frame(rng)
        y = x.copy()
        y[np.flatnonzero(x[:, 3])[0], 0] ^= 1
        rows += [row(f"t{i:02d}", "train", x, f"id{i % 7}"), row(f"e{i:02d}", "test", y if i % 2 else x, f"id{i % 9}", "ab" * 32 if i % 5 == 0 else None)]
    o = M.Overlaps(spark, table(spark, rows))
    pairs = {(r["eval_id"], r["kind"]) for r in o.pairs().collect()}
    hits = o.overlapping().collect()
    assert {(r["eval_id"], r["kind"]) for r in hits} == pairs
    masks = [r["mask"] & (2**64 - 1) for r in hits if r["kind"] == "near picture"]
    assert masks and all(m == 0 or bin(m).count("1") >= M.LEAST for m in masks) and any(masks)


def test_small_edits_in_every_row_are_found(spark):
    # one value of a visible pixel of each row moved by 64, an even shift of 4 in half the values, strong edits of one pixel
    rng = np.random.default_rng(6)
    rows, want = [], set()
    for i in range(150):
        x = rng.integers(70, 186, (64, 4)).astype(np.uint8)
        x[:, 3] = 255
        local, even, strong = (x.astype(int) for _ in range(3))
        for r in range(8):
            local[8 * r + rng.integers(8), rng.integers(3)] += 64 * rng.choice([-1, 1])
        even[:, 0] += 4
        even[:, 1] -= 4
        strong[rng.integers(64), :2] += 64
        rows.append(row(f"t{i:03d}", "train", x))
        for k, y in enumerate((local, even, strong)):
            assert np.abs(M.premultiplied(x[None]).astype(float) - M.premultiplied(y[None].astype(np.uint8)).astype(float)).mean() <= M.NEAR
            rows.append(row(f"v{k}{i:03d}", "test", y.astype(np.uint8)))
            want.add((f"t{i:03d}", f"v{k}{i:03d}"))
    got, every = found(spark, rows)
    assert want <= set(got) and len(every) == len(set(every))
    assert set(got.values()) == {"near picture"}


def test_cells_hold_every_near_picture():
    rng = np.random.default_rng(7)
    one = np.concatenate([rng.uniform(0, 8160, (4000, 8)), rng.integers(0, 8, (2000, 8)) * M.CELL, np.zeros((10, 8))])
    spend = rng.dirichlet(np.full(8, 0.4), len(one)) * rng.choice([512, 300, 20], (len(one), 1)) * rng.choice([-1, 1], one.shape)
    two = np.maximum(one + spend, 0)
    _, held = M.cells(one, np.zeros(len(one), bool))
    owner, around = M.cells(two, np.ones(len(two), bool))
    assert set(range(len(one))) == set(owner[around == held[owner]].tolist())
