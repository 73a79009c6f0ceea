import random

import numpy as np
import pytest

from framewright.llm import leaks as K
from framewright.llm import readability as R
from framewright.llm.prose import sentences

WORDS = "amber lantern river quiet mountain walks under seven bright windows while nobody counts copper kettles beside frozen harbours since early morning bells rang across narrow streets".split()


def passage(seed, n=40):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]


def leaks(spark, passages, docs):
    p = spark.createDataFrame([(i, t, "c", 1) for i, t in passages], "passage_id bigint, passage_text string, text string, doc_id int")
    d = spark.createDataFrame([(i, t, "c", 0.5) for i, t in docs], "doc_id bigint, text string, passage_id string, share double")
    return {(r["passage_id"], r["doc_id"]): r["share"] for r in K.leaked(spark, p, d).collect()}


def test_leaks_in_every_form(spark):
    p = passage(1)
    other = passage(2, 300)
    text = " ".join(p)
    altered = [w if i % 12 else "changed" for i, w in enumerate(p, 5)]
    html = "<p>" + "</p>\n<p>".join(" ".join(p[i : i + 10]) for i in range(0, 40, 10)) + "</p>"
    broken = " ".join(other[:50]) + " " + " ".join(w[:3] + "-\n" + w[3:] if i % 7 == 0 else w for i, w in enumerate(p))
    docs = [
        (1, " ".join(other) + " " + text), (2, text.upper()), (3, ", ".join(altered)), (4, html), (5, broken),
        (6, " ".join(p[:20]) + " " + " ".join(other[:60])), (7, " ".join(p[:16])), (8, " ".join(other)), (9, None), (10, ""),
        (11, "\u200b".join(text)), (12, " ".join(reversed(p))), (13, " ".join(w for q in zip(p, other) for w in q)),
        (14, " ".join(other * 200) + text), (15, " ".join(p[20:30] + other[:9] + p[30:40])), (16, " ".join(p[30:40] + other[:9] + p[20:30])),
    ]
    got = leaks(spark, [(7, text), (7, text), (8, None), (9, ""), (10, "too few words here")], docs)
    assert {d for _, d in got} == {1, 2, 3, 4, 5, 6, 11, 14, 15}
    assert all(q == 7 for q, _ in got)


def test_blocks_of_passages_give_the_same(spark, monkeypatch):
    ps = [(i, " ".join(passage(i))) for i in range(12)]
    docs = [(i, ps[i % 12][1] + " " + " ".join(passage(50 + i))) for i in range(30)]
    whole = leaks(spark, ps, docs)
    monkeypatch.setattr(K, "BLOCK_LETTERS", 700)
    assert leaks(spark, ps, docs) == whole and len(whole) == 30


def test_no_texts(spark):
    assert leaks(spark, [], [(1, "a b c")]) == {} and leaks(spark, [(1, " ".join(passage(1)))], []) == {}


def test_filter_loses_nothing_that_verification_keeps():
    rng = random.Random(9)
    texts = [passage(i, rng.randrange(20, 80)) for i in range(20)]
    index = K.Passages(list(range(20)), texts)
    docs = []
    for i in range(60):
        t = texts[rng.randrange(20)]
        a = rng.randrange(len(t) // 2)
        part = [w if rng.random() > 0.06 else "zz" for w in t[a : a + rng.randrange(8, len(t))]]
        docs.append(passage(100 + i, 30) + part + passage(200 + i, 30))
    got = {(d, p) for d, p, _ in index.search(docs)}
    want = set()
    for d, doc in enumerate(docs):
        for p, text in enumerate(texts):
            if K.covered(K.stretches(K.equal_runs(text, doc, np.arange(len(doc))), len(text))) >= 0.5 * len(text):
                want.add((d, p))
    assert len(want) > 10 and want <= got


EASY = "The cat sat on the mat. It is a big cat. We can see it run. Look at the dog! " * 5
HARD = "Notwithstanding the institutional degeneracy of perceptual generalization, the heterogeneous quantization of volumetric correspondence destabilizes the multidimensional discretization underlying longitudinal legitimacy. " * 4


def test_prose_extraction():
    text = "# The Heading Of It\n\n| a | b |\n| the | 2 |\n\n```\nfor the x in y:\n```\n" + "The small dog runs to the old gate.\n" + "https://the.invalid/of/it\n" + "{\"the\": 1}\n"
    assert [" ".join(s) for s in sentences(text)] == ["the small dog runs to the old gate"]
    assert sentences("Redistribution of the materials is permitted provided that attribution is retained.") == []
    assert sentences("Der alte Ritter ist in dem Turm und die Nacht ist kalt.") == []
    assert len(sentences("We saw the light of the vil-\nlage in the night.")[0]) == 10
    assert sentences(None) == [] and sentences("") == []
    assert len(sentences("<p>The cat is in the house.</p><p>It is a good cat.</p>")) == 2


def levels(spark, docs):
    df = spark.createDataFrame([(i, t, 9, "c") for i, t in docs], "doc_id bigint, text string, n_words int, row string")
    return {r["doc_id"]: r["reading_level"] for r in R.scored(spark, df).collect()}


def test_levels(spark):
    got = levels(spark, [(1, EASY), (2, HARD), (3, EASY.upper()), (4, "The cat sat on the mat."), (5, None), (6, ""), (7, HARD * 30), (8, "{} " * 500)])
    assert got == {1: 1, 2: 3, 3: 1, 4: None, 5: None, 6: None, 7: 3, 8: None}
    assert levels(spark, []) == {}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_repeated_documents_keep_their_rows(spark, n):
    df = spark.createDataFrame([(1, EASY)] * n, "doc_id bigint, text string")
    assert R.scored(spark, df).count() == n


@pytest.mark.parametrize("letters", [2, 3, 6])
def test_two_exact_stretches_of_common_words_are_found(letters):
    # passages of 32 words of which exactly half stand in two exact stretches, half of the words from 100 common ones
    rng = random.Random(letters)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = [word(rng.randrange(1, letters + 1)) for _ in range(100)]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.5 else word(rng.randrange(1, letters + 1)) for _ in range(n)]
    texts = [draw(32) for _ in range(300)]
    index = K.Passages(list(range(300)), texts)
    docs = [draw(60) + t[2:10] + draw(rng.randrange(1, 40)) + t[18:26] + draw(60) for t in texts]
    got = {(d, p) for d, p, _ in index.search(docs)}
    assert {(i, i) for i in range(300)} <= got


def test_one_altered_word_in_ten_of_short_words():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2))
    texts = [[word() for _ in range(20)] for _ in range(200)]
    docs = []
    for t in texts:
        part = list(t[3:13])
        part[rng.choice([4, 5])] = "q" * rng.randrange(1, 60)
        docs.append([word() for _ in range(30)] + part + [word() for _ in range(30)])
    got = {(d, p) for d, p, _ in K.Passages(list(range(200)), texts).search(docs)}
    assert {(i, i) for i in range(200)} <= got


def test_a_repeated_word_does_not_break_a_stretch():
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    doc = text[:8] + ["eight", "other"] + text[8:]
    assert K.covered(K.stretches(K.equal_runs(text, doc, np.arange(len(doc))), 16)) == 16
    assert K.covered(K.stretches(K.equal_runs(text, text[8:] + text[:8], np.arange(16)), 16)) == 8
    assert K.covered([]) == 0 and K.equal_runs(text, ["q"], np.arange(1)) == []


def test_long_tags_do_not_count():
    text = " ".join(WORDS)
    assert K.word_list(text.replace("quiet", '<a title="' + "words in a tag " * 60 + '">quiet')) == K.word_list(text)
