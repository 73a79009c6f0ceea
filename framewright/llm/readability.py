"""p9: reading level of each document, by a familiar-word formula over its English prose."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import letters_and_digits
from framewright.llm.prose import sentences
from framewright.session import Scratch, load, spread

#: The high-frequency list is drawn from this share of the texts, those with the shortest sentences; a familiar word stands in
#: at least FAMILIAR_SHARE of them. Over all texts technical words are as frequent as those of the simplest texts.
EASY_TEXTS, FAMILIAR_SHARE = 0.2, 0.08
#: Weights of the familiar-word formula: per cent of unfamiliar words, and words per sentence.
UNFAMILIAR_WEIGHT, LENGTH_WEIGHT = 0.1579, 0.0496
#: A text without stops tells nothing of its sentences; none counts as longer than this.
LONGEST_SENTENCE = 40
#: Scores from which a text is no longer for the first school years, and asks for university training.
UPPER_SCHOOL, UNIVERSITY = 6.0, 11.2
LEAST_WORDS = 50

_PROSE = "doc_id bigint, n_words int, n_sentences int, words array<struct<word:string,n:int>>"


def _prose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, times, ends, totals, lengths = [], [], [0], [], []
        for text in b.column("text").to_pylist():
            found = sentences(text)
            counts = Counter(w for s in found for w in s)
            words.extend(counts)
            times.extend(counts.values())
            ends.append(len(words))
            totals.append(sum(map(len, found)))
            lengths.append(len(found))
        items = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int32())], ["word", "n"])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(totals, pa.int32()), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
            names=["doc_id", "n_words", "n_sentences", "words"],
        )


def scored(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_sentences, unfamiliar, sentence_length, score, reading_level).

    Document frequencies are counted over all words of the EASY_TEXTS of all
    texts with enough prose; the words in at least FAMILIAR_SHARE of them are at
    most (distinct words per text) / FAMILIAR_SHARE, so the list may be
    broadcast at any corpus size. Without a text of enough prose none is familiar.

    A document with fewer than LEAST_WORDS words of English prose, and a null
    or empty text, has a null level. Whole texts are read. Other columns are
    ignored; a repeated doc_id gives a row each.
    """
    prose = Scratch(spark, "reading").write(
        spread(documents.select("doc_id", "text")).mapInArrow(_prose, _PROSE).withColumn("row", F.monotonically_increasing_id()), "prose"
    )
    length = F.col("n_words") / F.col("n_sentences")
    whole = prose.where(F.col("n_words") >= LEAST_WORDS)
    cut = whole.agg(F.percentile_approx(length, EASY_TEXTS, 10_000)).first()[0]
    easy = whole.where(length <= (cut or 0.0))
    held = easy.count()
    listed = (
        easy.select(F.explode("words.word").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
        .where(F.col("df") >= FAMILIAR_SHARE * held)
        .select("word")
    )
    familiar = (
        prose.select("row", F.explode("words").alias("s"))
        .select("row", F.col("s.word").alias("word"), F.col("s.n").alias("n"))
        .join(F.broadcast(listed), "word")
        .groupBy("row")
        .agg(F.sum("n").alias("familiar"))
    )
    unfamiliar = 100 * (1 - F.coalesce("familiar", F.lit(0)) / F.col("n_words"))
    measured = (
        prose.drop("words")
        .join(familiar, "row", "left")
        .withColumn("unfamiliar", F.when(F.col("n_words") > 0, unfamiliar))
        .withColumn("sentence_length", F.when(F.col("n_words") > 0, F.least(length, F.lit(float(LONGEST_SENTENCE)))))
        .withColumn("score", UNFAMILIAR_WEIGHT * F.col("unfamiliar") + LENGTH_WEIGHT * F.col("sentence_length"))
    )
    level = F.when(F.col("score") < UPPER_SCHOOL, 1).when(F.col("score") < UNIVERSITY, 2).otherwise(3)
    return measured.select(
        "doc_id", "n_words", "n_sentences", "unfamiliar", "sentence_length", "score",
        F.when(F.col("n_words") >= LEAST_WORDS, level).alias("reading_level"),
    )


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Every document with enough English prose, and its level."""
    return scored(spark, load(spark, root, "documents")).where("reading_level is not null").select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, root: str) -> DataFrame:
    """Documents, words and mean score per source and level; level 0 holds texts without enough prose."""
    documents = load(spark, root, "documents")
    keys = documents.select("doc_id", letters_and_digits(F.col("source")).alias("source_key"))
    return (
        scored(spark, documents)
        .join(keys, "doc_id")
        .groupBy("source_key", F.coalesce("reading_level", F.lit(0)).alias("reading_level"))
        .agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("score"), 6).alias("mean_score"))
    )


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile}
ORACLES: dict[str, str] = {}
