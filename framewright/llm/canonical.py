"""p3: freely typed values mapped to the entries of a reference list.

Distinct values are broken into tokens. The distinct tokens are joined with the
tokens of the reference names by edit distance: two tokens within d edits have a
common remainder once at most d letters are deleted from each, so both sides
are keyed by such remainders, joined on them and verified. The repaired
tokens are then combined by soft TF-IDF to rank the complete names that hold one
of them, or that are near when written as one word. A value that no name
explains well enough is reported with 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.skew import hottest, lookup_join, union_all
from framewright.session import Scratch, load, parallel_tasks

ACTION_PROPERTIES = ["action", "play_action", "on_hit_action", "next_action"]

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтвнѕјԁһοαεικρτυν", "aeopcyxikmtbhsjdhoaeikptuv")
# Digits typed for letters; 1 stays, as it may be read as i or l.
DIGIT_LETTERS = str.maketrans("034578", "oeastb")
# Words that decorate a name without changing it.
DECORATIONS = frozenset(
    "act action anim animation clip cycle fast slow loop looped left right up down side front back png gif npc hero new old final copy".split()
)
#: Least soft TF-IDF score of an accepted name.
ACCEPT = 0.72


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) from a to b, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y and not (x == "1" and y in "il")))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def letters(word: str) -> int:
    """The set of letters of a word as bits; a 1 is left out, as it may be either of two."""
    bits = 0
    for c in word:
        bits |= 0 if c == "1" else 1 << (ord(c) % 61)
    return bits


def allowed(length: int) -> int:
    """Edits a token of this length may have."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 9 else 3


def plain(value: str) -> str:
    """Compatible form with look-alike letters made Latin and camel case opened, lower case."""
    text = unicodedata.normalize("NFKC", value).translate(LOOKALIKES)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text).lower()


def tokens(value: str) -> list[str]:
    """Letter runs of a value: single spelled-out letters joined, digits inside words read as letters."""
    found = []
    for word in re.findall(r"[^\W_]+", plain(value)):
        core = re.sub(r"^\d+|\d+$", "", word)
        if re.search(r"[^\W\d_]", core):
            inner = core.translate(DIGIT_LETTERS) if re.search(r"\d", core) else core
            found.append(inner)
    if len(found) >= 3 and sum(len(t) == 1 for t in found) >= len(found) - 1:
        return ["".join(found)]
    return found


def within(token: str, word: str) -> int:
    """Edits within which a typed token may be taken for a word of a name."""
    return min(allowed(len(word)), allowed(max(len(token), 3)) + 1)


def remainders(token: str, most: int) -> set[str]:
    """What is left of a token after up to ``most`` deletions; letters that a 1 may stand for count as one."""
    found = {token.replace("1", "i").replace("l", "i")}
    last = found
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found = found | last
    return found


def reach(length: int, is_name: bool) -> int:
    """Most deletions a token of this length needs to meet any partner it may be matched with."""
    if is_name:
        return allowed(length)
    return max(min(allowed(n), allowed(max(length, 3)) + 1) for n in range(max(length - 3, 1), length + 4))


class Reference:
    """The reference names, ready to rank entries by repaired tokens."""

    def __init__(self, names: list[tuple[int, str]]):
        self.names = []
        for entry, name in names:
            if words := tokens(name):
                joined = "".join(words)
                self.names.append((entry, words, joined, letters(joined)))
        df: dict[str, int] = {}
        self.holding: dict[str, list[int]] = {}
        for k, (_, words, *_) in enumerate(self.names):
            for w in set(words):
                df[w] = df.get(w, 0) + 1
                self.holding.setdefault(w, []).append(k)
        n = max(len(self.names), 1)
        self.idf = {w: 1 + math.log(n / k) for w, k in df.items()}
        self.unknown = 1 + math.log(n)
        self.most_words = max((len(words) for _, words, *_ in self.names), default=0)
        self.most_letters = max((len(joined) for _, _, joined, _ in self.names), default=0)
        # names by the pairs of letters of their one-word form, to find those near as one word
        self.pairs: dict[str, list[int]] = {}
        self.short: list[int] = []
        for k, (_, _, joined, _) in enumerate(self.names):
            for pair in self.letter_pairs(joined):
                self.pairs.setdefault(pair, []).append(k)
            if len(joined) + 1 <= 3 * self.one_word_edits(joined):
                self.short.append(k)

    @staticmethod
    def letter_pairs(word: str) -> Counter:
        padded = f"^{word.replace('1', 'i').replace('l', 'i')}$"
        return Counter(padded[i : i + 2] for i in range(len(padded) - 1))

    @staticmethod
    def one_word_edits(joined: str) -> int:
        return max(1, round(len(joined) * 0.3))

    def near_as_one(self, one: str) -> set[int]:
        """Names whose one-word form may be within its edits: an edit touches at most three pairs of letters."""
        shared: Counter = Counter()
        for pair, times in self.letter_pairs(one).items():
            for k in self.pairs.get(pair, ()):
                shared[k] += times
        found = set(self.short)
        for k, times in shared.items():
            joined = self.names[k][2]
            if times >= max(len(one), len(joined)) + 1 - 3 * self.one_word_edits(joined):
                found.add(k)
        return found

    def score(self, value_tokens: list[str], near: dict[str, dict[str, float]], one: str, bits: int, name: tuple) -> float:
        """Soft TF-IDF cosine of a value and a name, or their likeness when both are written as one word."""
        _, words, joined, name_bits = name
        free = list(range(len(value_tokens)))
        hit, away = 0.0, 0.0
        likeness = lambda i, w: near.get(value_tokens[i], {}).get(w, 0.0)
        for w in words:
            best = max(free, key=lambda i: likeness(i, w), default=None)
            sim = likeness(best, w) if best is not None else 0.0
            if sim == 0.0:
                away += self.idf[w] ** 2
                continue
            free.remove(best)
            hit += self.idf[w] ** 2 * sim
        soft = 0.0
        if hit:
            rest = self.unknown**2 * sum(self.counts(value_tokens[i]) for i in free)
            own = sum(self.idf[w] ** 2 for w in words)
            soft = hit / math.sqrt(own * (own - away + rest))
        most = self.one_word_edits(joined)
        if (bits & ~name_bits).bit_count() > most:
            return soft
        d = edits(one, joined, most)
        return max(soft, 1 - d / max(len(one), len(joined)) if d <= most else 0.0)

    def repair(self, token: str) -> dict[str, float]:
        """Words of names that a token may stand for, by trying all of them: for a value outside a table."""
        found = {}
        for w in self.idf:
            most = within(token, w)
            if (d := edits(token, w, most)) <= most:
                found[w] = 1 - d / max(len(w), len(token))
        return found

    @staticmethod
    def counts(token: str) -> bool:
        """Whether a word of a value asks for an explanation by the name."""
        return len(token) > 1 and token not in DECORATIONS

    def best(self, value: str, near: dict[str, dict[str, float]] | None = None) -> tuple[int, float]:
        """(entry, score): 0 where no name reaches ACCEPT; ties to the smaller entry.

        ``near`` holds, per token of the value, the words of names it may stand
        for with their likeness. Names that hold none of them and aren't near as
        one word would score 0.
        """
        parts = tokens(value)
        bare = [t for t in parts if self.counts(t)] or parts
        one = "".join(bare)
        # each word too many weighs at least as much as a word of a name, so a much longer text can't reach ACCEPT
        if not parts or (len(bare) > 2 * self.most_words and len(one) > 2 * self.most_letters):
            return 0, 0.0
        bits = letters(one)
        near = {t: self.repair(t) for t in parts} if near is None else near
        offered = {k for t in parts for w in near.get(t, ()) for k in self.holding[w]} | self.near_as_one(one)
        top = max(((self.score(parts, near, one, bits, self.names[k]), -self.names[k][0]) for k in offered), default=(0.0, 0))
        return (-top[1], top[0]) if top[0] >= ACCEPT else (0, top[0])


#: Most reference names that are held by every task; a longer list is refused, not truncated.
MOST_NAMES = 50_000


def reference_names(vocabulary: DataFrame) -> list[tuple[int, str, bool]]:
    """(entry, name, is canonical) of a reference list, at most MOST_NAMES of them."""
    names = vocabulary.select(
        F.col("vocab_id").alias("entry"),
        F.explode(F.concat(
            F.array(F.struct(F.col("canonical_action").alias("name"), F.lit(True).alias("own"))),
            F.transform(F.coalesce("other_names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("own"))),
        )).alias("n"),
    ).select("entry", "n.name", "n.own").where("name is not null")
    held = names.limit(MOST_NAMES + 1).collect()
    if len(held) > MOST_NAMES:
        raise ValueError(f"the reference list has more than {MOST_NAMES} names")
    return sorted((r["entry"], r["name"], r["own"]) for r in held)


def _keyed(is_name: bool, longest: int):
    """(key, token): a token under each of its remainders; a token too long for any name has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t) for t in b["token"] if len(t) <= longest + 3 for k in sorted(remainders(t, reach(len(t), is_name)))]
            yield pd.DataFrame(rows, columns=["key", "token"])

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for token, word in zip(b["token"], b["word"]):
            most = within(token, word)
            if (d := edits(token, word, most)) <= most:
                rows.append((token, word, 1 - d / max(len(word), len(token))))
        yield pd.DataFrame(rows, columns=["token", "word", "likeness"])


def repaired(spark: SparkSession, typed: DataFrame, words: list[str]) -> DataFrame:
    """(token, near): per distinct token the words of names it may stand for, at most as many as there are words."""
    longest = max(map(len, words), default=0)
    named = spark.createDataFrame([(w,) for w in words], "token string").mapInPandas(_keyed(True, longest), "key string, token string").withColumnRenamed("token", "word")
    offered = typed.mapInPandas(_keyed(False, longest), "key string, token string")
    pairs = offered.join(named, "key").select("token", "word").distinct().mapInPandas(_verified, "token string, word string, likeness double")
    return pairs.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("word", "likeness"))).alias("near"))


def _tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(tokens=[list(dict.fromkeys(tokens(v))) for v in b["value"]])


def mapped_values(spark: SparkSession, values: DataFrame, names: list[tuple[int, str, bool]]) -> DataFrame:
    """(value, n, vocab_id, score) for distinct values with their row counts; vocab_id 0 where no name fits."""
    plain_names = [(entry, name) for entry, name, _ in names]
    words = sorted({w for _, name in plain_names for w in tokens(name)})
    parsed = Scratch(spark, "tokens").write(values.mapInPandas(_tokenized, "value string, n bigint, tokens array<string>"), "values")
    spread_out = parsed.select("value", F.explode("tokens").alias("token"))
    counts = spread_out.groupBy("token").agg(F.count("*").alias("n"))
    near = Scratch(spark, "repairs").write(repaired(spark, counts.select("token").repartition(parallel_tasks(spark)), words), "near")
    hot = hottest(counts.join(near, "token", "left_semi"), "token", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = lookup_join(spread_out, near, "token", hot=hot)
    told = met.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("token", "near"))).alias("near"))  # the tokens of one value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference = Reference(plain_names)
        for b in batches:
            best = [
                reference.best(v, {} if held is None else {t: dict(w) for t, w in (held.items() if isinstance(held, dict) else held)})
                for v, held in zip(b["value"], b["near"])
            ]
            yield b[["value", "n"]].assign(vocab_id=[e for e, _ in best], score=[float(s) for _, s in best])

    joined = parsed.select("value", "n").join(told, "value", "left")
    return joined.mapInPandas(run, "value string, n bigint, vocab_id int, score double")


def canonical_map(spark: SparkSession, values: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, list[str], list]:
    """Map the freely typed values of a column ``value``.

    Returns the written map (value, n, vocab_id, score) of all distinct values
    that aren't null, blank or exactly canonical; the canonical names; and the
    hot values for the join back.
    """
    names = reference_names(vocabulary)
    own = sorted({name for _, name, is_own in names if is_own})
    counted = free_values(values, own).groupBy("value").agg(F.count("*").alias("n"))
    found = Scratch(spark, "canonical").write(mapped_values(spark, counted.repartition(parallel_tasks(spark)), names), "map")
    return found, own, hottest(found, "value", found.agg(F.sum("n")).first()[0] or 0)


def free_values(df: DataFrame, own: list[str], value: str = "value") -> DataFrame:
    """Rows whose value is not null, blank or exactly a canonical name."""
    blank = F.regexp_replace(value, r"(?U)\s+", "") == ""
    return df.where(F.col(value).isNotNull() & ~blank & ~F.col(value).isin(own))


def typed_actions(spark: SparkSession, root: str) -> DataFrame:
    """(field_name, record_id, value_index, value) of every typed action of the three tables."""
    motions = load(spark, root, "latent_motion_training_rows").select(
        F.lit("verb").alias("field_name"), F.col("sequence_id").alias("record_id"), F.lit(0).alias("value_index"), F.col("verb").alias("value")
    )
    frames = load(spark, root, "prepared_broad_rows").select(
        F.lit("action").alias("field_name"), F.col("sequence_id").alias("record_id"), F.lit(0).alias("value_index"), F.col("action").alias("value")
    )
    named = load(spark, root, "raw_properties").where(F.lower(F.trim("property_name")).isin(ACTION_PROPERTIES))
    properties = named.select(
        F.lit("property_values").alias("field_name"),
        F.col("property_id").cast("string").alias("record_id"),
        F.posexplode("property_values").alias("value_index", "value"),
    )
    return union_all([motions, frames, properties])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Every typed action that isn't exactly canonical, with its entry or 0."""
    values = typed_actions(spark, root)
    found, own, hot = canonical_map(spark, values.select("value"), load(spark, root, "action_vocabulary"))
    return (
        lookup_join(free_values(values, own), found.select("value", "vocab_id"), "value", hot=hot)
        .select("field_name", "record_id", "value_index", "vocab_id")
        .distinct()
    )


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct typed value with its rows, entry, name and score; unmatched ones have entry 0."""
    vocabulary = load(spark, root, "action_vocabulary")
    found, _, _ = canonical_map(spark, typed_actions(spark, root).select("value"), vocabulary)
    return found.join(vocabulary.select("vocab_id", "canonical_action"), "vocab_id", "left").select(
        "value", F.col("n").alias("n_rows"), "vocab_id", "canonical_action", F.round("score", 6).alias("score")
    )


def canonical_verbs(spark: SparkSession, df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the canonical action a value stands for, null where none does."""
    found, own, hot = canonical_map(spark, df.select(F.col(column).alias("value")), vocabulary)
    named = found.join(vocabulary.select("vocab_id", "canonical_action"), "vocab_id").select(
        F.col("value").alias(column), F.col("canonical_action").alias("_mapped")
    )
    exact = df.where(F.col(column).isin(own)).withColumn("canonical", F.col(column))
    typed = lookup_join(df.where(~F.coalesce(F.col(column).isin(own), F.lit(False))), named, column, "left", hot=hot)
    return exact.unionByName(typed.withColumnRenamed("_mapped", "canonical"))


QUERIES = {"p3_found": p3_found, "p3_values": p3_values}
ORACLES: dict[str, str] = {}
