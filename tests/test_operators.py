import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import hashing as H
from framewright.functions import keys as Keys
from framewright.functions import labels as L
from framewright.operators import kernels as K
from framewright.operators import merge as M
from framewright.operators import reports as R
from framewright.operators import sampling as P
from framewright.operators import selection as S
from framewright.operators import timeline as T
from framewright.operators import vectors as V
from framewright.plans import sampling_timelines as Q
from framewright.sources import archives as A
from framewright.sources import publish as W
from framewright.sources import schema


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column.alias("x")).first()["x"]


def column_of(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.orderBy("i").select(expr(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_keys(spark):
    same = ["mirefold:violet-urchin-00000792", " MIREFOLD_Violet Urchin 00000792 ", "ｍｉｒｅｆｏｌｄ：ｖｉｏｌｅｔ－ｕｒｃｈｉｎ－００００００７９２", "mirefold:violet\xa0-urchin-00000792"]
    got = column_of(spark, same, Keys.letters_and_digits)
    assert got[0] == got[1] == got[3] == "mirefoldvioleturchin00000792"
    assert column_of(spark, ["Unknown", "  ", None, "ｕｎｋｎｏｗｎ"], Keys.letters_and_digits) == [None] * 4
    hexed = "ab" * 32
    forms = [hexed, hexed.upper(), f"sha256:{hexed}", f" {hexed}\t", "-".join(hexed[i : i + 16] for i in range(0, 64, 16)), f"SHA256-{hexed}"]
    assert column_of(spark, forms, Keys.digest) == [hexed] * 6
    assert column_of(spark, ["0" * 64, "abc", None, "unknown", ""], Keys.digest) == [None] * 5
    assert column_of(spark, ["TRAIN", "training", "val", "dev ", " test", "testing", None, "x"], Keys.split_name) == [
        "train", "train", "validation", "validation", "test", "test", None, None]


def test_hashing(spark):
    doc = '{"b": [1, 2.5], "a": "é"}'
    assert column_of(spark, [doc, None, "{"], H.canonical_json) == ['{"a":"é","b":[1,2.5]}', None, None]
    assert column_of(spark, ["a", "b"], lambda c: H.member_hash(F.array(c, F.lit("z"))))[0] == H.hashlib.sha256(b"a\0z").hexdigest()
    got = column_of(spark, [str(i) for i in range(2000)], lambda c: H.hash_split("s", c, {"train": 0.8, "validation": 0.1, "test": 0.1}))
    assert 0.76 < got.count("train") / 2000 < 0.84 and set(got) == {"train", "validation", "test"}
    data = np.arange(8, dtype=np.uint8).tobytes()
    want = H.hashlib.sha256(b"uint8\0" + b"2x4\0" + data).hexdigest()
    df = spark.createDataFrame([("uint8", [2, 4], bytearray(data))], "d string, s array<int>, b binary")
    assert df.select(H.array_hash(F.col("d"), F.col("s"), F.col("b")).alias("x")).first()["x"] == want


def test_labels(spark):
    assert column_of(spark, ["Crème Brûlée!", "--", None], L.slug) == ["creme_brulee", "", None]
    assert column_of(spark, ["pack/HeroKnight_v2.png"], L.humanized) == ["hero knight v2"]
    assert column_of(spark, ["see https://a.b/c). and http://X.y/z, https://a.b/c"], L.url_references) == [["https://a.b/c", "http://X.y/z"]]
    assert column_of(spark, ["CC-BY-NC 4.0", "CC0", "MIT", None, "odd"], L.rights_status) == ["restricted", "public_domain", "open", "unknown", "other"]
    df = spark.createDataFrame([(["red hat", "a very long phrase here", None, "hat", "cape"],)], "p array<string>")
    assert df.select(L.budgeted_words(F.col("p"), 3).alias("x")).first()["x"] == "red hat; cape"
    ids = column_of(spark, ["aé", "", "ééé"], lambda c: L.token_ids(c, 6))
    assert ids[0] == [1, 97 + 3, 0xC3 + 3, 0xA9 + 3, 2, 0]
    assert ids[1] is None
    assert ids[2] == [1, 0xC3 + 3, 0xA9 + 3, 0xC3 + 3, 0xA9 + 3, 2]
    assert column_of(spark, ["aéé"], lambda c: L.token_ids(c, 6)) == [[1, 100, 0xC3 + 3, 0xA9 + 3, 2, 0]]


def test_long_names_and_equal_lengths(spark):
    vocab = spark.createDataFrame([("a b c d e", "five words"), ("dash", "dash"), ("jump", "jump")], "name string, canonical string")
    df = spark.createDataFrame([("a b c d e",), ("now a b c d e too",), ("jump dash",)], "raw string")
    got = {r["raw"]: (r["label"], r["method"]) for r in L.normalized_label(df, "raw", vocab).collect()}
    assert got == {"a b c d e": ("five_words", "alias"), "now a b c d e too": ("five_words", "embedded_token"), "jump dash": ("dash", "embedded_token")}


def test_phases_of_an_intro_that_loops(spark):
    rows = [([None, None, 0.0, 0.5], True), ([0.0, 0.5], False), ([None, 0.25, 0.5], False), ([None, 0.0, None], False), ([None, 0.0, 1.0], False), ([None, None], False), ([], False)]
    df = spark.createDataFrame(rows, "p array<double>, want boolean").select(S.phases_ready(F.col("p"), F.lit("intro_then_loop")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_normalized_label(spark):
    vocab = spark.createDataFrame([("run", "run"), ("jog", "run"), ("light attack", "light attack")], "name string, canonical string")
    df = spark.createDataFrame([("Run",), ("jog",), ("hero light-attack 2",), ("zzz",), (None,), ("  ",)], "raw string")
    got = {r["raw"]: (r["label"], r["confidence"], r["method"]) for r in L.normalized_label(df, "raw", vocab).collect()}
    assert got == {
        "Run": ("run", 1.0, "exact"), "jog": ("run", 0.98, "alias"), "hero light-attack 2": ("light_attack", 0.85, "embedded_token"),
        "zzz": (None, 0.0, "unmapped"), None: (None, 0.0, "missing"), "  ": (None, 0.0, "unmapped")}


def test_merge(spark):
    obs = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "c", None), (2, 1, None, None)], "k int, t int, v string, w string")
    got = {r["k"]: r for r in M.coalesce_merge(obs, ["k"], ["t"], ["v"], [], ["w"]).collect()}
    assert (got[1]["v"], got[1]["w"], got[1]["n_observations"]) == ("a", "x", 3)
    a = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, n int")
    b = spark.createDataFrame([(2, None, 7), (3, "z", None)], "k int, s string, n int")
    up = {r["k"]: (r["s"], r["n"], r["merge_state"]) for r in M.upsert(a, b, ["k"], {"s": "fill", "n": "overwrite"}).collect()}
    assert up == {1: ("a", 5, "kept"), 2: ("b", 7, "updated"), 3: ("z", None, "created")}
    rows, conflicts = M.merged_union([a, a, b], "k")
    assert {r["k"] for r in rows.collect()} == {1, 3} and {r["k"] for r in conflicts.collect()} == {2}
    empty = a.where("false")
    assert M.closure(empty, a, "k").first().asDict() == {"n_left_only": 0, "n_right_only": 2, "n_both": 0, "n_left_repeated": 0, "n_right_repeated": 0}


def test_filters_and_admission(spark):
    f = S.Filters(actions=(" Run", "run", "Walk"), include_sources=("b", "a"))
    assert f.actions == ("run", "walk") and f.include_sources == ("a", "b")
    with pytest.raises(ValueError):
        S.Filters(include_sources=("a",), exclude_sources=("a",))
    with pytest.raises(ValueError):
        S.Filters(temporal_mode="odd")
    df = spark.createDataFrame([(1, None, ["p"]), (2, "x", None)], "k int, v string, parent array<string>")
    got = {r["k"]: (r["exclusion_reasons"], r["admitted"]) for r in S.admitted(df, [(F.col("v").isNull(), "no_v")], ("parent", "up:")).collect()}
    assert got == {1: (["no_v", "up:p"], False), 2: ([], True)}
    cases = [([0.0, 0.5], "loop", True), ([0.0, 1.0], "loop", False), ([0.0, 1.0], "one_shot", True), ([0.5, 0.2], "loop", False), ([], "loop", False), (None, "loop", False), ([0.0], "unknown", False), ([0.0, None], "loop", False)]
    ready = spark.createDataFrame([(i, p, m) for i, (p, m, _) in enumerate(cases)], "i int, p array<double>, m string")
    got = [r["x"] for r in ready.orderBy("i").select("i", S.phases_ready(F.col("p"), F.col("m")).alias("x")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_timelines(spark):
    def pick(phases, targets, mode):
        df = spark.createDataFrame([(phases, targets, mode)], "p array<double>, t array<double>, m string")
        return df.select(T.nearest_frames(F.col("p"), F.col("t"), F.col("m")).alias("x")).first()["x"]

    assert pick([0.0, 0.5], [0.0, 0.25, 0.5, 0.75, 0.9], "loop") == [0, 0, 1, 0, 0]
    assert pick([0.0, 0.5, 1.0], [0.0, 0.25, 0.5, 0.75, 1.0], "ping_pong") == [0, 1, 2, 1, 0]
    assert pick([0.0, 0.5, 1.0], [0.0, 0.25, 1.0], "one_shot") == [0, 0, 2]
    df = spark.createDataFrame([([10.0, 20.0, 30.0],), ([],)], "d array<double>")
    assert [r["x"] for r in df.select(T.retimed(F.col("d"), F.lit(100.0)).alias("x")).collect()] == [[16.667, 33.333, 50.0], None]
    lanes = spark.createDataFrame([("g", "a", 0, 100), ("g", "a", 1, 50), ("g", "b", 0, 60), ("g", "b", 1, 60)], "g string, lane string, o int, ms int")
    got = sorted((r["start_ms"], r["span_ms"], r["lane"], r["frame_index"]) for r in T.folded(lanes, "g", "lane", ["o"], "ms").collect())
    assert got == [(0, 60, "a", 0), (0, 60, "b", 0), (60, 40, "a", 0), (60, 40, "b", 1), (100, 50, "a", 1), (100, 50, "b", 1)]
    tails = column_of(spark, [[None, 0.0, 0.5], [None, 0.2], [0.0, None]], T.tail_loop, "array<double>")
    assert tails == [[0.0, 0.5], None, None]


def test_sampling(spark):
    sizes = [(f"c{i}", 1) for i in range(30)]
    out = P.balanced_splits(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert sorted(list(out.values()).count(s) for s in ("train", "validation", "test")) == [3, 3, 24]
    pairs = P.greedy_pairs([("i", "a", "b"), ("i", "a", "c"), ("j", "a", "b"), ("j", "b", "c")], 3)
    assert len(set(pairs)) == 3 and {p[0] for p in pairs[:2]} == {"i", "j"}
    rows = spark.createDataFrame([("c", "run", "x"), ("c", "walk", "y"), ("c", "jump", "x"), ("d", "run", "x"), ("d", "run", "z"), ("e", "run", "q")], "cond string, act string, t string")
    got = {r["cond"]: (r["status"], r["actions"], r["n_aliases"], r["n_conflicting"]) for r in P.contrast_groups(rows, ["cond"], "act", "t").collect()}
    assert got["c"] == ("selected", "jump|walk", 1, 0)
    assert got["d"] == ("conflicting_targets", "", 0, 1) and got["e"][0] == "single_action"
    w = P.sampler_weights(rows, "cond", "act").agg(F.sum("weight")).first()[0]
    assert abs(w - 1) < 1e-12


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 8, 8, 4)).astype(np.uint8)
    x[0] = 0
    s = K.statistics(x)
    for i in range(5):
        seen = np.argwhere(x[i, ..., 3] > 0)
        assert s["n_visible"][i] == len(seen)
        box = (-1, -1, -1, -1) if not len(seen) else (seen[:, 1].min(), seen[:, 0].min(), seen[:, 1].max(), seen[:, 0].max())
        assert tuple(int(s[k][i]) for k in ("left", "top", "right", "bottom")) == tuple(map(int, box))
        assert s["n_colours"][i] == len({tuple(x[i, a, b, :3]) for a, b in seen})
    c = K.compared(x, x)
    assert (c["mae"] == 0).all() and (c["alpha_iou"] == 1).all() and np.allclose(c["histogram_overlap"], 1)
    c = K.compared(x[:1], x[1:2])
    assert c["alpha_iou"][0] == 0 and c["alpha_recall"][0] == 0
    assert (K.from_model_range(K.premultiplied_model_range(x))[..., 3] == x[..., 3]).all()
    mask = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [1, 0, 1, 1], [0, 0, 1, 1]], bool)
    assert K.largest_parts(mask, 3).sum() == 5
    assert K.medoid(np.stack([x[1], x[1], x[2]])) == 0
    out, n = K.keyed_out(np.full((1, 2, 2, 4), 255, np.uint8), (255, 255, 255))
    assert n[0] == 4 and out.sum() == 0
    assert K.resized(x, 4).shape == (5, 4, 4, 4)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).tolist()
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x)] + [(99, [0.0] * 4, 1), (98, None, 1)], "id bigint, v array<double>, g int")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["query_id"]: r["id"] for r in V.nearest_match(df, "id", "v", F.col("id") < 10, 1, block=4).collect()}
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {i: int(s[i].argmax()) for i in range(10)}
    sep = {r["g"]: r["mean_cosine"] for r in V.group_separation(df, "g", "v").collect()}
    for g in range(3):
        m = u[g::3] @ u[g::3].T
        n = len(m)
        assert abs(sep[g] - (m.sum() - n) / (n * (n - 1))) < 1e-9


def test_reports_on_empty_and_null(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert R.duplicate_summary(df, "v").first().asDict() == {"n_values": 0, "n_duplicate_groups": 0, "n_duplicate_rows": 0, "n_excess_rows": 0}
    assert R.distribution(df, F.col("k"), "k").count() == 0
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    obs = spark.createDataFrame([("a", "MIT"), ("b", "MIT"), ("b", "GPL"), ("c", None), ("d", "MIT"), ("d", None)], "k string, v string")
    assert {r["k"]: r["rights_state"] for r in R.rights_states(items, obs, "k", "v").collect()} == {
        "a": "known", "b": "conflicting", "c": "unknown", "d": "partial", "e": "none"}
    q = R.nearest_rank(spark.createDataFrame([("g", i) for i in range(1, 12)], "g string, v int"), "g", "v", {"p10": (1, 10), "median": (1, 2)}).first()
    assert (q["least"], q["p10"], q["median"], q["greatest"]) == (1, 2, 6, 11)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = zipped([("a/b.txt", b"hello"), ("c.txt", b"x" * 100)])
    bad = zipped([("../up.txt", b"1"), ("/abs.txt", b"2"), ("X.png", b"3"), ("x.png", b"4")])
    for name, data in (("good.zip", good), ("bad.zip", bad), ("broken.zip", b"PK nothing")):
        (tmp_path / name).write_bytes(data)
    files = A.binary_files(spark, str(tmp_path), "*.zip")
    members = A.zip_members(files)
    names = {r["sha256"]: os.path.basename(r["path"]) for r in files.select("sha256", "path").collect()}
    verdict = {names[r["archive"]]: r["reasons"] for r in A.archive_verdicts(members).collect()}
    assert verdict == {"good.zip": [], "bad.zip": ["absolute", "traversal", "case_collision"], "broken.zip": ["unreadable"]}
    chosen = members.where("path = 'a/b.txt'").select("archive", "ordinal")
    r = A.extracted(files, chosen).first()
    assert bytes(r["content"]) == b"hello" and r["ok"]
    every = members.where("ordinal >= 0 and fault = ''").select("archive", "ordinal").unionByName(chosen.select("archive", F.lit(77).alias("ordinal")))
    tight = {(names[r["archive"]], r["ordinal"]): r["fault"] for r in A.extracted(files, every, A.Limits(member_bytes=50)).collect()}
    assert tight[("good.zip", 0)] == "" and tight[("good.zip", 1)] == "beyond_limits" and tight[("good.zip", 77)] == "missing"
    total = {(names[r["archive"]], r["ordinal"]): r["fault"] for r in A.extracted(files, every, A.Limits(total_bytes=6)).collect()}
    assert total[("good.zip", 0)] == "" and total[("good.zip", 1)] == "beyond_limits"
    inventories, rows = A.inventory_rows(members)
    held = {names[r["archive_blob_sha256"]]: (r["member_count"], r["file_count"], len(r["inventory_sha256"])) for r in inventories.collect()}
    assert held == {"good.zip": (2, 2, 64), "bad.zip": (4, 4, 64)}
    assert rows.where("inspection_status = 'refused'").count() == 2
    assert A.member_path("a\\.\\b//c") == ("a/b/c", "") and A.member_path("C:/x")[1] == "drive"


def test_text_sources(spark, tmp_path):
    assert A.image_runs("w[01~03].png:100") == [("w01.png", 100), ("w02.png", 100), ("w03.png", 100)]
    assert A.image_runs("a[2~1][x,y]:5*2") == [("a2x", 5), ("a1y", 5)] * 2
    with pytest.raises(ValueError):
        A.image_runs("a[1~2][3]:1")
    assert A.key_value_sections("[Files]\nsff = \"a.sff\" ; c\n;x\nair=b.air") == [("files", 0, "sff", "a.sff"), ("files", 1, "air", "b.air")]
    head = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0\0\0\x10\0\0\0\x08\x08\x06\0\0\0" + b"\0\0\0\0"
    assert A.png_facts(head) | {} == {"format": "png", "width": 16, "height": 8, "bit_depth": 8, "alpha": "channel", "n_frames": 1, "palette_sha256": None}
    assert A.png_facts(b"gif")["format"] is None
    (tmp_path / "c.csv").write_text("\ufefffilename,notes,authors,licenses,urls\na.png,,\"X, Y\",CC0,\n", encoding="utf-8")
    r = A.credits(spark, str(tmp_path / "c.csv")).first()
    assert (r["filename"], r["authors"], r["urls"]) == ("a.png", ["X", "Y"], [])
    text = spark.createDataFrame([("Path = a\nSize = 3\n\nPath = b = c\n",)], "t string")
    assert [r["facts"] for r in A.listing_blocks(text, "t").collect()] == [{"Path": "a", "Size": "3"}, {"Path": "b = c"}]
    pages = spark.createDataFrame([("p", "<h2>One</h2><a href='u'>L <b>1</b></a>"), ("q", None)], "id string, html string")
    assert [tuple(r) for r in A.page_links(pages, "id", "html").collect()] == [("p", 0, "One", "u", "L 1")]
    assert A.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_manifest(spark, tmp_path):
    doc = {"schema_version": 1, "sequence_count": 2, "sequences": [{"sequence_id": "s1", "split": "train", "frame_count": 2}, {"sequence_id": "s2", "split": "test"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    path = str(tmp_path / "m.json")
    assert {r["sequence_id"] for r in A.manifest_clips(spark, path).collect()} == {"s1", "s2"}
    with pytest.raises(ValueError):
        A.manifest_clips(spark, path, "train", ["s2"])


def test_publishing(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", [1]), (1, None, [])], "k int, s string, a array<int>")
    lines = list(W.jsonl(df, ["k"]))
    assert lines == [b'{"a":[],"k":1,"s":null}\n', '{"a":[1],"k":2,"s":"é"}\n'.encode()]
    assert b"".join(W.csv_lines(df, ["k"])).decode() == "k,s,a\n1,,[]\n2,é,[1]\n"
    assert b"".join(W.jsonl_gz(df, ["k"])) == b"".join(W.jsonl_gz(df, ["k"])) != b""
    out = tmp_path / "x.txt"
    W.publish(str(out), [b"a"])
    with pytest.raises(FileExistsError):
        W.publish(str(out), [b"b"])
    assert out.read_bytes() == b"a" and os.listdir(tmp_path) == ["x.txt"]
    m = W.bundle(str(tmp_path / "b"), {"one.jsonl": lines})
    assert m["files"][0]["size_bytes"] == sum(map(len, lines))
    with pytest.raises(FileExistsError):
        W.bundle(str(tmp_path / "b"), {})
    d = W.put(str(tmp_path), b"blob")
    assert W.put(str(tmp_path), b"blob") == d and os.path.exists(A.store_path(str(tmp_path), d))
    md = spark.createDataFrame([("S*", "t_1", None)], "g string, m string, d string")
    assert [r["line"] for r in W.markdown_lines(md, "g", "m", "d").orderBy("g", "kind", "m").collect()] == ["## S\\*", "- t\\_1: unknown"]
    with pytest.raises(OSError):
        W.require_capacity(str(tmp_path), 1 << 60)


def test_schema(spark, tmp_path):
    assert len(schema.TABLES) == 25
    for name in schema.TABLES:
        assert schema.read(spark, str(tmp_path), name).count() == 0
    df = spark.createDataFrame([("s", 0, "zz", 0, -1.0, 2.0, None, None, None), ("s", 1, None, 0, 1.0, 0.5, None, None, None)], schema.TABLES["sequence_frames"][0])
    got = {r["ordinal"]: r["exclusion_reasons"] for r in schema.checked(df, "sequence_frames").collect()}
    assert got == {0: ["bad_source_blob_sha256", "negative_duration_ms", "range_phase"], 1: []}


def test_byte_tokens_keeps_whole_descriptions(spark, tmp_path):
    texts = ["a" * 23, "é" * 48, "b" * 95 + "é", None]
    spark.createDataFrame(list(enumerate(texts)), "row_index bigint, description string").write.parquet(str(tmp_path / "semantic_embedding_rows.parquet"))
    got = {r["row_index"]: [int(x) for x in r["tokens"].split()] for r in Q.byte_tokens(spark, str(tmp_path)).collect()}
    assert got == {0: [1, *[100] * 23, 2, *[0] * 73], 1: [1, *[0xC3 + 3, 0xA9 + 3] * 48, 2], 2: [1, *[101] * 95, 2, 0]}


def test_balanced_pairs_choose_from_every_identity(spark, tmp_path):
    # 300 identities of three common pairs, and a rare pair of the identity last in order
    held = {f"{i:03d}": ["a", "b", "c"] for i in range(300)} | {"zz": ["a", "x"], "solo": ["a"]}
    rows = [(i, a) for i, actions in held.items() for a in actions]
    df = spark.createDataFrame([*rows, *rows[:5], (None, "a"), (None, "b"), ("n", None)], "i string, a string")
    every = [(i, x, y) for i, actions in held.items() for x in actions for y in actions if x < y]
    found = P.pair_candidates(df, "i", "a", 40).collect()
    assert len(found) == 3 * 40 + 1
    frequency = {(r[1], r[2]): r[3] for r in found}
    assert frequency == {("a", "b"): 300, ("a", "c"): 300, ("b", "c"): 300, ("a", "x"): 1}
    chosen = P.greedy_pairs([tuple(r)[:3] for r in found], 40, frequency)
    assert chosen == P.greedy_pairs(every, 40) and chosen[0] == ("zz", "a", "x")
    # no more identities than picks: all candidates are offered
    few = [c for c in every if c[0] < "005" or c[0] == "zz"]
    near = df.where("i < '005' or i = 'zz'")
    assert P.greedy_pairs([tuple(r)[:3] for r in P.pair_candidates(near, "i", "a", 40).collect()], 40) == P.greedy_pairs(few, 40)
    spark.createDataFrame([(k, f"{p}") for k in range(500) for p in "abc"] + [(999, "a"), (999, "x")], "o_custkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in Q.balanced_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == 40 and got[0] == ("999", "a", "x") and len({g[0] for g in got}) == 40
