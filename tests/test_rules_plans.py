import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import rules as R
from framewright.operators import planning as P
from framewright.operators import projection as J
from framewright.operators import sequences as Q
from framewright.operators.skew import hot_keys, hottest, lookup_join


def column_of(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_durations_and_times(spark):
    assert column_of(spark, ["120", "120ms", " 3s ", "3 s", "", None, "-1", "9" * 30], R.literal_milliseconds) == [120, 120, 3000, None, None, None, None, None]
    assert column_of(spark, ["1", "0.5", "0.123", "0", "-2", "x", None, "1e3"], R.decisecond_milliseconds) == [100, 50, None, None, None, None, None, None]
    assert column_of(spark, [0.5, -0.5, 1.5, 2.5, None], R.half_away, "double") == [1.0, -1.0, 2.0, 3.0, None]
    df = spark.createDataFrame([(2024, 2, 29, 1, 2, 3), (2023, 2, 29, 1, 2, 3), (2024, 0, 1, 0, 0, 0), (None, 1, 1, 0, 0, 0)], "a int, b int, c int, d int, e int, f int")
    assert [r[0] for r in df.select(R.archive_time(*[F.col(c) for c in "abcdef"])).collect()] == ["2024-02-29T01:02:03", None, None, None]


def test_lump_names(spark):
    got = column_of(spark, ["sprites/TrooA1.png", "TROOA2A8.PNG", "TROOA9.png", "TROO.png", "TR*OA1.png", "TROO[0.png", None, ""], R.sprite_name)
    assert got[0]["family"] == "TROO" and [tuple(f) for f in got[0]["frames"]] == [("A", 0, 1, False)]
    assert [tuple(f) for f in got[1]["frames"]] == [("A", 0, 2, False), ("A", 0, 8, True)]
    assert [tuple(f) for f in got[5]["frames"]] == [("[", 26, 0, False)] and got[2:5] == [None] * 3 and got[6:] == [None] * 2


def test_states_paths_and_credits(spark):
    assert column_of(spark, ["dead2", "pre_walk-run", "nothing", "", None], R.state_action) == ["death", "run", None, None, None]
    got = column_of(spark, ["spritesheets/body/walk/fg/red.png", "spritesheets/a", "tools/x.js", "x/README", None], lambda c: R.sheet_path(c, ["walk"]))
    assert tuple(got[0]) == ("sheet", "body", "walk", "fg", "body/red") and [g and g["kind"] for g in got[1:]] == ["sheet_directory", "source_code", "documentation", None]
    assert column_of(spark, ["body/walk/fg/red.png", "body/sit.png"], lambda c: R.credit_candidates(c, ["walk"], {"walk": ["stroll"]})) == [
        ["body/walk/fg/red.png", "body/fg/walk.png", "body/fg/stroll.png"], ["body/sit.png"]]


def test_captions_and_replies(spark):
    assert column_of(spark, ["<s> a  <pad>b</s>", "", None], R.sanitized_caption) == ["a b", "", None]
    assert column_of(spark, ["A cat. White background. Hat", "Background", None], R.appearance_caption) == ["A cat. Hat.", "", None]
    assert column_of(spark, ["aa bb cccccccc d", "", None], lambda c: R.wrapped(c, 5)) == [["aa bb", "cccccccc", "d"], [], None]
    choices = {"a": ["x", "y"], "b": ["z"]}
    got = column_of(spark, ['{"a":"x","b":"z"}', '```json\n{"b":"z","a":"y"}\n```', '{"a":"x"}', '{"a":"x","b":"q"}', '{"a":"x","b":"z","c":1}', '{"a":"x","b":"z"}}', "no", None], lambda c: R.strict_choices(c, choices))
    assert got == [{"a": "x", "b": "z"}, {"a": "y", "b": "z"}] + [None] * 6
    df = spark.createDataFrame([("b", 1), ("q", 2), (None, 3)], "label string, label_ids int")
    assert [r["label_id"] for r in R.encoded_labels(df, {"label": ["a", "b"]}).orderBy("label_ids").collect()] == [1, None, None]
    with pytest.raises(Exception, match="unknown label"):
        R.encoded_labels(df, {"label": ["a", "b"]}, strict=True).collect()


def test_plan_and_projection(spark):
    audit = spark.createDataFrame([("a", 1, "c"), ("b", None, "c"), ("b", 2, "c"), (None, 3, "c"), ("d", None, "c")], "k string, v int, admitted string").drop("admitted")
    records, out = J.planned(audit, "k", [(F.col("v").isNull(), "no_value")])
    assert [r["k"] for r in records.collect()] == ["a"]
    assert sorted((r["k"] or "", r["v"] or 0, tuple(r["exclusion_reasons"])) for r in out.collect()) == [
        ("", 3, ("missing_key",)), ("b", 0, ("repeated_key", "no_value")), ("b", 2, ("repeated_key",)), ("d", 0, ("no_value",))]
    held = spark.createDataFrame([("x", 1), ("y", 2)], "k string, f int")
    rows = spark.createDataFrame([("x", 1), ("y", 3), ("z", 4), ("z", 4), ("w", 5), ("w", 6)], "k string, f int")
    got = {(r["table_name"], r["state"]): r["n_rows"] for r in J.projected({"t": (held, rows, ["k"], ["f"])}).collect()}
    assert got == {("t", "reused"): 1, ("t", "conflict"): 2, ("t", "created"): 1}
    after = J.appended(held, rows, ["k"])
    assert sorted(r["k"] for r in after.collect()) == ["w", "x", "y", "z"] and J.appended(after, rows, ["k"]).count() == 4
    assert J.projected({"t": (held.limit(0), rows.limit(0), ["k"], ["f"])}).count() == 0
    assert J.pinned(held, {"f > 1": 1}) is held
    with pytest.raises(ValueError, match="pins"):
        J.pinned(held, {"f > 1": 2})


def test_guarded_writes(spark):
    members = spark.createDataFrame([("a", 1, None, "listed"), ("a", 2, None, "listed"), ("b", 1, None, "listed")], "arc string, o int, extracted_blob_sha256 string, inspection_status string")
    blobs = spark.createDataFrame([("s1", 5, None)], "sha256 string, size_bytes int, mime_type string")
    told = spark.createDataFrame([("a", 1, "s1", 5, "m"), ("b", 1, "s2", 6, "m"), ("b", 9, "s3", 7, "m")], "arc string, o int, sha256 string, size_bytes int, mime_type string")
    assert [tuple(r) for r in J.extraction_faults(told, members, "arc", "o").collect()] == [("b", 9, "missing_member")]
    after, stored = J.registered_extractions(told, members, blobs, "arc", "o")
    assert sorted((r["arc"], r["o"], r["inspection_status"]) for r in after.collect()) == [("a", 1, "extracted"), ("a", 2, "listed"), ("b", 1, "listed")]
    assert [tuple(r) for r in stored.collect()] == [("s1", 5, "m")]
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (2, "p"), (3, "p")], "k int, s string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (4, "q"), (3, "q"), (3, "r")], "k int, s string")
    changed, faults = J.keyed_update(rows, asked, ["k"], ["s"])
    assert sorted((r["k"], r["s"]) for r in changed.collect()) == [(1, "q"), (2, "p"), (2, "p"), (3, "p")]
    assert sorted((r["k"], r["n_updates"], r["n_matches"]) for r in faults.collect()) == [(2, 1, 2), (3, 2, 1), (4, 1, 0)]


def test_joins_picks_and_scopes(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0), (None, "n", 0)], "k int, f string, extra int")
    b = spark.createDataFrame([(1, "x", 9), (2, "q", 9), (4, "z", 9)], "k int, f string, more int")
    rows, faults = P.agreed_join(a, b, "k", ["f"])
    assert [tuple(r) for r in rows.collect()] == [(1, "x", 0, 9)]
    assert {r["fault"]: r["n_keys"] for r in faults.collect()} == {"differs:f": 1, "left_only": 2, "right_only": 1}
    df = spark.createDataFrame([("g", "b", "d1", 2), ("g", "a", "d1", 1), ("g", "c", "d2", 3), ("h", "a", "d1", 1)], "g string, o string, d string, place int")
    assert sorted((r["g"], r["o"], r["place"]) for r in P.first_distinct(df, "g", ["o"], "d", 2).collect()) == [("g", "a", 1), ("g", "c", 2), ("h", "a", 1)]
    assert [tuple(r) for r in P.matched_pairs(df, "g", "o", "d", 5).collect()] == [("g", "a", "c")]
    names = spark.createDataFrame([("p.A", "B"), ("p.B", None), ("p.q.A", "B"), ("p.q.B", None), ("r.C", "D"), ("s.D", None), ("s.A", "Nope"), ("t.E", "A")], "n string, p string")
    got = {r["n"]: (r["resolved"], r["method"]) for r in P.scoped_parents(names, "n", "p").collect()}
    assert got == {"p.A": ("p.B", "scope"), "p.q.A": ("p.q.B", "scope"), "r.C": ("s.D", "unique_name"), "s.A": (None, "unresolved"), "t.E": (None, "unresolved")}


def test_sequence_metrics_and_kernels(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 8, 8, 4)).astype(np.uint8)
    x[0] = x[1]
    x[4, ..., 3] = 0
    rows = [("s", i, bytearray(f.tobytes()), 1) for i, f in enumerate(x)] + [("s", 9, None, 1), (None, 1, bytearray(x[0].tobytes()), 1), ("t", 0, bytearray(b"short"), 1), ("u", 0, bytearray(x[2].tobytes()), 1)]
    got = {r["seq"]: r for r in Q.sequence_metrics(spark.createDataFrame(rows, "seq string, place int, px binary, palette int"), "seq", "place", "px").collect()}
    assert set(got) == {"s", "u"} and got["s"]["frame_count"] == 5 and got["s"]["unique_ratio"] == 0.8 and got["s"]["dynamic_fraction"] == 0.75
    v = x.astype(float)
    v[..., :3] *= v[..., 3:] / 255
    assert abs(got["s"]["temporal_rgba_l1"] - np.mean([np.abs(v[i + 1] - v[i]).mean() / 255 for i in range(4)])) < 1e-9
    assert got["u"]["temporal_rgba_l1"] == 0.0 and got["u"]["centroid_jitter"] == 0.0
    one = np.zeros((1, 4, 4, 4), np.uint8)
    one[0, 1, 2] = (1, 2, 3, 255)
    out, lost = Q.placed(one, 0, 0, 2.0, 8, (0, 0))
    assert lost == 0 and (out[0, 2:4, 4:6, 3] == 255).all() and (out[..., 3] > 0).sum() == 4
    assert Q.placed(one, -4, 0, 1.0, 4, (0, 0))[1] == 1 and Q.union_box(one * 0) is None
    big = Q.aligned(one, 6)
    assert (big[..., 3] > 0).all() and not Q.aligned(one * 0, 6).any()
    assert Q.codec_metrics(x, x)["premultiplied_mae"].max() == 0 and (Q.hard_alpha(x)[..., 3] % 255 == 0).all()


def test_hot_keys_by_rows(spark):
    rows = [("big", i) for i in range(300)] + [(f"k{j}", i) for j in range(200) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(4)
    assert hot_keys(df, "k", parts=10, least=50) == ["big"]
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert hottest(counts, "k", 900, least=50, parts=10) == ["big"] and hottest(counts, "k", 900) == []
    look = df.select("k").distinct().withColumn("w", F.length("k"))
    plain = sorted(map(tuple, df.join(look, "k").collect()))
    assert sorted(map(tuple, lookup_join(df, look, "k", hot=["big"]).select("k", "v", "w").collect())) == plain
