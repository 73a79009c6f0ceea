import pytest

from framewright.llm import canonical as C

NAMES = [(1, "sprint"), (1, "dash"), (1, "full speed"), (2, "shield block"), (2, "guard"), (3, "double jump"), (3, "second jump"), (4, "jump"), (4, "leap"), (5, "calcify"), (6, "crawl"), (6, "creep"), (7, "get up")]


@pytest.mark.parametrize("value, entry", [
    ("  Sprint ", 1), ("srpint", 1), ("SPINT", 1), ("ｓｐｒｉｔ", 1), ("dаsh", 1), ("full-seed-left", 1), ("FullSpeed", 1), ("act:guuard", 2),
    ("sjirld block", 2), ("doule jump", 3), ("Send jump", 3), ("jump", 4), ("hero/leap", 4), ("cakc1fy", 5), ("c r a w w l", 6), ("crrep_01", 6),
    ("GetUp", 7), ("anim_get_up", 7), ("creep [side]", 6), ("ｃｒｅｅｐ (loop)", 6),
    ("Layer_2489", 0), ("???", 0), ("img_77", 0), ("12345", 0), ("background_tile", 0), ("", 0), ("   ", 0), ("do not use", 0),
])
def test_values(value, entry):
    assert C.Reference(NAMES).best(value)[0] == entry


def test_long_text_is_no_name():
    r = C.Reference(NAMES)
    assert r.best("sprint " * 5000)[0] == 0
    assert r.best("word " * 20000 + "sprint")[0] == 0


def test_edits_against_a_table():
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["sprint", "srpint", "", "print", "jump", "juump", "abc", "cab"]
    for a in words:
        for b in words:
            assert C.edits(a, b, 9) == slow(a, b)
            assert C.edits(a, b, 1) == min(slow(a, b), 2)


def test_ties_go_to_the_smaller_entry():
    assert C.Reference([(9, "roll"), (4, "roll")]).best("rolll")[0] == 4


def tables(spark, tmp_path, motions, frames, properties):
    vocab = [(1, "sprint", "travel", ["dash"]), (2, "crawl", "travel", None)]
    root = str(tmp_path)
    spark.createDataFrame(vocab, "vocab_id int, canonical_action string, action_family string, other_names array<string>").write.parquet(f"{root}/action_vocabulary.parquet")
    spark.createDataFrame(motions, "sequence_id string, verb string, value string, n int").write.parquet(f"{root}/latent_motion_training_rows.parquet")
    spark.createDataFrame(frames, "sequence_id string, action string, vocab_id int").write.parquet(f"{root}/prepared_broad_rows.parquet")
    spark.createDataFrame(properties, "property_id bigint, property_name string, property_values array<string>").write.parquet(f"{root}/raw_properties.parquet")
    return root


def test_query_over_small_tables(spark, tmp_path):
    root = tables(
        spark, tmp_path,
        [("m1", "sprint", "c", 1), ("m2", "srpint", "c", 1), ("m2", "srpint", "c", 2), ("m3", None, "c", 1), ("m4", " ", "c", 1), ("m5", "???", "c", 1)],
        [("f1", "Dash!", 3), ("f2", "crawl", 3)],
        [(7, " ACTION", ["crawl", "cralw", None, "", "dash"]), (8, "volume", ["dash"]), (9, "next_action", None), (10, None, ["dash"])],
    )
    got = sorted(tuple(r) for r in C.p3_found(spark, root).collect())
    assert got == [("action", "f1", 0, 1), ("property_values", "7", 1, 2), ("property_values", "7", 4, 1), ("verb", "m2", 0, 1), ("verb", "m5", 0, 0)]
    assert {r["value"]: r["n_rows"] for r in C.p3_values(spark, root).collect()} == {"srpint": 2, "???": 1, "Dash!": 1, "cralw": 1, "dash": 1}


def test_empty_tables(spark, tmp_path):
    assert C.p3_found(spark, tables(spark, tmp_path, [], [], [])).count() == 0


def test_canonical_verbs_keep_every_row(spark):
    vocab = spark.createDataFrame([(1, "sprint", ["dash"])], "vocab_id int, canonical_action string, other_names array<string>")
    df = spark.createDataFrame([("a", "sprint"), ("b", "dsah"), ("c", None), ("d", "zzzz"), ("e", " ")], "id string, verb string")
    got = {r["id"]: r["canonical"] for r in C.canonical_verbs(spark, df, "verb", vocab).collect()}
    assert got == {"a": "sprint", "b": "sprint", "c": None, "d": None, "e": None}


def test_token_join_finds_what_trying_all_words_finds(spark):
    import random

    rng = random.Random(5)
    names = [(i, "".join(rng.choice("abcdil") for _ in range(rng.randrange(1, 13)))) for i in range(60)]
    reference = C.Reference(names)
    typed = set()
    for _, w in names:
        for _ in range(6):
            t = list(w)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.4:
                    t.insert(at, rng.choice("abcdil1"))
                elif t and rng.random() < 0.5:
                    t.pop(min(at, len(t) - 1))
                elif len(t) > 1:
                    at = min(at, len(t) - 2)
                    t[at], t[at + 1] = t[at + 1], t[at]
            typed.add("".join(t) or "a")
    got = {r["token"]: dict(r["near"]) for r in C.repaired(spark, spark.createDataFrame([(t,) for t in typed], "token string"), sorted(reference.idf)).collect()}
    want = {t: reference.repair(t) for t in typed}
    assert got == {t: w for t, w in want.items() if w}


def test_names_near_as_one_word_are_offered():
    r = C.Reference([(i, n) for i, n in enumerate(["double jump", "shield block", "sprint", "get up", "up"], 1)])
    for value in ("doublejmp", "shieldblok", "sprnt", "gtup", "upp", "shildblock"):
        every = {k for k, n in enumerate(r.names) if C.edits(value, n[2], r.one_word_edits(n[2])) <= r.one_word_edits(n[2])}
        assert every <= r.near_as_one(value)
