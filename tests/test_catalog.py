import json
import os

import duckdb
import pytest

from framewright import __main__ as cli
from framewright.operators import corpora as C
from framewright.plans import catalog

ROOT = "/root/testdata/sf0.001"
SOME = ["split_coverage", "rights_states", "admit_quarantine", "merge_coalesce", "contrast_groups", "temporal_select", "normalize_labels", "overlay_layers", "unique_match"]

needs_data = pytest.mark.skipif(not os.path.isdir(ROOT), reason="the test tables aren't here")


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


def lines(rows, names):
    order = sorted(names)
    return sorted(repr([str(round(r[n], 6)) if isinstance(r[n], float) else str(r[n]) for n in order]) for r in rows)


@needs_data
@pytest.mark.parametrize("name", SOME)
def test_queries_match_their_oracles(spark, name):
    db = duckdb.connect()
    for f in os.listdir(ROOT):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{ROOT}/{f}'")
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = lines([dict(zip(names, r)) for r in found.fetchall()], names)
    df = catalog.QUERIES[name](spark, ROOT)
    assert sorted(df.columns) == sorted(names)
    assert lines([r.asDict() for r in df.collect()], df.columns) == want


@needs_data
def test_reports_bundle_is_stable(spark, tmp_path):
    one = cli._reports(spark, ROOT, str(tmp_path / "a"))
    two = cli._reports(spark, ROOT, str(tmp_path / "b"))
    assert one == two and {f["name"] for f in one["files"]} == {"sources.csv", "inventory.jsonl", "attribution.md", "summary.json"}
    assert json.loads((tmp_path / "a" / "summary.json").read_text())["sources"] == 40


def test_captions_and_animations(spark):
    texts = ['```json\n{"identity": " Knight ", "appearance": ["Red cape", "red cape", "none", ""], "palette": null}\n```', "{broken", None, '{"palette": ["x"]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["c"] for r in df.select("i", C.parsed_caption(df["t"]).alias("c")).orderBy("i").collect()]
    assert (got[0]["identity"], got[0]["appearance"], got[0]["palette"]) == ("Knight", ["red cape"], []) and got[1:] == [None] * 3
    air = "[Begin Action 200]\n1,0, 0,0, 5\nLoopstart\n1,1,0,0,-1,H ; held\n1,x,0\n[begin action 5]\n2,0,0,0,3\n"
    rows = C.animation_rows(spark.createDataFrame([("f", air), ("g", None)], "n string, t string"), "n", "t").collect()
    assert [(r["action"], r["ordinal"], r["kind"], r["ticks"], r["loop_start"]) for r in rows] == [
        (200, 0, "element", 5, False), (200, 1, "element", -1, True), (200, 2, "excluded", 0, False), (5, 0, "element", 3, False)]


def test_inheritance_through_deep_chains_and_cycles(spark):
    chain = [(i, i - 1 if i else None, "root" if i == 0 else None) for i in range(20)] + [(100, 101, None), (101, 100, None), (200, None, None)]
    got = {r["n"]: (r["v"], r["depth"]) for r in C.inherited(spark.createDataFrame(chain, "n int, p int, v string"), "n", "p", "v").collect()}
    assert all(got[i] == ("root", i) for i in range(20))
    assert got[100] == got[101] == got[200] == (None, None)


def test_multi_action_identities_keeps_every_identity_with_two_verbs(spark, tmp_path):
    rows = [("two", "run", "s2"), ("two", "jump", "s1"), ("two", "jump", "s1"), ("one", "run", "s3"), ("one", "run", "s4"), ("half", "run", "s5"), ("half", None, "s6"), (None, "run", "s7"), (None, "jump", "s8")]
    spark.createDataFrame(rows, "identity_id string, verb string, sequence_id string").write.parquet(str(tmp_path / "latent_motion_training_rows.parquet"))
    got = catalog.QUERIES["multi_action_identities"](spark, str(tmp_path)).collect()
    assert {(r["identity_id"], r["verb"], r["sequence_id"], r["n_labels"]) for r in got} == {("two", "run", "s2", 2), ("two", "jump", "s1", 2)} and len(got) == 2


@needs_data
def test_streams_over_many_files_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{ROOT}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    events.orderBy("value").repartition(20).write.parquet(folder)
    for name in ("stream_event_windows", "stream_insert_or_ignore"):
        one, many = (catalog.QUERIES[name](spark, r) for r in (ROOT, str(tmp_path)))
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    days = events.groupBy("event_type").count().collect()
    assert {r["event_type"]: r["n_events"] for r in catalog.QUERIES["stream_insert_or_ignore"](spark, str(tmp_path)).collect()} == {r["event_type"]: r["count"] for r in days}


def test_includes_deeper_than_any_limit(spark):
    edges = spark.createDataFrame([(i, i + 1, 0) for i in range(22)] + [(22, 0, 0)], "a int, b int, o int")
    got = C.included(spark, edges.where("a >= 18 or a < 3"), "a", "b", "o").where("root = 18").collect()
    assert {r["document"] for r in got} == {19, 20, 21, 22, 0, 1, 2, 3}
    assert C.inherited(spark.createDataFrame([(i, i - 1 if i else None, "x" if i == 0 else None) for i in range(70)], "n int, p int, v string"), "n", "p", "v").where("v is null").count() == 0
