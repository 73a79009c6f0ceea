import re

from pyspark.sql import functions as F

from framewright.llm import balanced as B
from framewright.llm import mixing as X

DOCS = "doc_id bigint, text string, source string, tokens string, rank int, copies int, source_key int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "c", 1, 1, 1) for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "mixture_name string, doc_source string, target_weight double, max_repeats int, budget_ratio double")


def test_token_count(spark):
    texts = ["Hello, world_1!", "", None, "  ", "é-ß 東京。", "a\u200bb", "x" * 200_000 + " y", "a\u00a0b\u3000c\tz", "x²½"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", X.token_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts]


def test_shortfalls_and_draws(spark):
    docs = [(i, "w " * 10, "Big One" if i % 10 else "small") for i in range(200)] + [(900, "w", None), (901, None, "big-one"), (902, "", "void")]
    plan = targets(spark, [("m", "big_one", 0.5, 3, 1.0), ("m", "small", 0.5, 2, 1.0), ("m", "void", 0.0, 2, 1.0), ("m", "absent", 0.1, 2, 1.0)])
    draws, report = X.mixed(spark, documents(spark, docs), plan)
    got = {r["doc_source"]: r for r in report.collect()}
    assert got["big_one"]["tokens"] == 1800 and got["small"]["tokens"] == 200
    assert {s: r["short"] for s, r in got.items()} == {"big_one": False, "small": True, "void": False, "absent": True}
    rows = draws.collect()
    per = {s: [r["copies"] for r in rows if r["source_key"] == s] for s in ("bigone", "small")}
    assert per["small"] == [2] * 20  # the cap
    assert set(per["bigone"]) == {1}
    assert abs(sum(r["copies"] * r["tokens"] for r in rows if r["source_key"] == "bigone") - 1000) <= 10
    again = {(r["doc_id"], r["copies"]) for r in X.mixed(spark, documents(spark, docs).repartition(3), plan)[0].collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_mixture_of_nothing(spark):
    draws, report = X.mixed(spark, documents(spark, []), targets(spark, [("m", "a", 1.0, 2, 1.0)]))
    assert draws.count() == 0 and report.first()["short"] is False
    assert X.mixed(spark, documents(spark, [(1, "a b", "a")]), targets(spark, []))[0].count() == 0


def motions(spark, rows):
    return spark.createDataFrame([(s, i, v, "c", "c") for s, i, v in rows], "sequence_id string, identity_id string, verb string, canonical string, supply string")


VOCAB = [(1, "run", "travel", ["jog"]), (2, "walk", "travel", []), (3, "jump", "travel", None), (4, "sleep", "rest", [])]


def vocabulary(spark):
    return spark.createDataFrame(VOCAB, "vocab_id int, canonical_action string, action_family string, other_names array<string>")


def test_supply_counts_identities_once(spark):
    rows = [("a", "X:1", "run"), ("b", "x 1", "Run!"), ("c", "x1", "jog"), ("d", "y", "run"), ("e", None, "run"), ("f", "unknown", "run"), ("g", "z", None), ("h", "z", "???"), ("a", "X:1", "run")]
    got = {(r["canonical"], r["identity"]): r["sequence_id"] for r in B.supply_rows(spark, motions(spark, rows), vocabulary(spark)).collect()}
    assert got == {("run", "x1"): "a", ("run", "y"): "d"}
    assert B.supply_rows(spark, motions(spark, []), vocabulary(spark)).count() == 0


def test_report_and_sample(spark):
    rows = [(f"r{i}", f"i{i}", "run") for i in range(100)] + [(f"w{i}", f"i{i}", "walk") for i in range(10)] + [(f"s{i}", f"i{i}", "sleep") for i in range(3)]
    supply = B.supply_rows(spark, motions(spark, rows), vocabulary(spark))
    target = spark.createDataFrame(
        [("c", "run", 0.4, 5, 0.5), ("c", "walk", 0.5, 5, 0.5), ("c", "sleep", 0.05, 5, 0.5), ("c", "jump", 0.05, 0, 0.5)],
        "config_name string, verb string, target_share double, minimum_rows bigint, sample_share double")
    report = B.quota_report(supply, target)
    got = {r["verb"]: (r["supply"], r["sample_size"], r["unmet"]) for r in report.collect()}
    assert got == {"run": (100, 56, False), "walk": (10, 56, True), "sleep": (3, 56, True), "jump": (0, 56, True)}
    sample, quotas = B.balanced_sample(spark, supply, report, vocabulary(spark))
    drawn = {r["verb"]: r["n"] for r in sample.groupBy("verb").agg(F.count("*").alias("n")).collect()}
    quota = {r["verb"]: r["quota"] for r in quotas.collect()}
    assert drawn == {v: n for v, n in quota.items() if n}
    assert sum(quota.values()) == 56 and quota["walk"] == 10 and quota["sleep"] == 3 and quota["run"] == 43
    assert sample.groupBy("verb", "identity").count().where("count > 1").count() == 0


def test_unmet_quota_goes_to_siblings_first():
    rows = [
        {"verb": v, "family": f, "supply": s, "target_share": t, "minimum_rows": 0, "sample_size": 100}
        for v, f, s, t in (("a", "x", 10, 0.5), ("b", "x", 60, 0.1), ("c", "y", 500, 0.4))
    ]
    assert B.allocate(rows) == {"a": 10, "b": 50, "c": 40}
    rows[1]["supply"] = 20
    assert B.allocate(rows) == {"a": 10, "b": 20, "c": 70}
    assert B.whole_parts(10, {"a": 1.0, "b": 1.0, "c": 1.0}) == {"a": 4, "b": 3, "c": 3}
