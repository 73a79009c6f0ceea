"""p7: evaluation passages that stand wholly or partly in training documents.

Q-gram lemma filtering: the letters of every document are cut into character
q-grams and looked up among those of the passages; hits are counted in
overlapping diagonal bands, and a region stays only if it shares at least the
q-grams that a stretch within the edit budget must share. A stretch of n words
with n / 10 of them altered holds an exact piece of at least PIECE words, which
gives the bound; pieces with fewer letters than a q-gram are looked up whole.
What stays is verified by an alignment in the bands around its exact pieces:
equal runs are found first and then chained, so that a repeated word can't lead
a stretch astray.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.prose import cleaned
from framewright.operators.skew import union_all
from framewright.session import Scratch, load, spread

#: Letters per q-gram; letters per diagonal band; documents looked up at once.
Q, BAND, CHUNK = 12, 64, 256
#: A leak covers this share of a passage's words in stretches of at least STRETCH words, of which 1 in 10 may be altered.
COVER, STRETCH, ALTERED = 0.5, 8, 0.1
#: Consecutive unaltered words that every stretch holds: of n words n // 10 are altered, which leaves the longest piece the
#: fewest, five, at n = 10.
PIECE = 5
#: Share of a passage's words that shared q-grams must spell out: half of the words lie in stretches, and of a stretch at
#: least half is seen (of ten words with one altered, a piece of four may be shorter than a q-gram).
SEEN = 0.25
#: Letters of passages that one task holds; more passages are searched in blocks, each against all documents.
BLOCK_LETTERS = 4_000_000

_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|blockquote|tr|td|th|table|h[1-6]|hr|pre|section)\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z!][^<>]*>")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?:[>|*#]+\s*)?(?=\w)|(?<=\w)[-‐‑](?=\w)")
_WORDS = re.compile(r"[^\W_]+")


def word_list(text: str | None) -> list[str]:
    """Words that count: markup, case, punctuation, spacing, hyphens, invisible characters and Unicode forms don't."""
    if not text:
        return []
    text = cleaned(text)
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub("\n", text))
    return _WORDS.findall(_HYPHEN.sub("", text).casefold())


@dataclass
class Letters:
    """The letters of many word lists in one array, and for each letter its owner and word."""

    code: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    at: np.ndarray  # place of the letter within its owner

    @classmethod
    def of(cls, texts: list[list[str]]) -> Letters:
        joined = ["".join(t) for t in texts]
        code = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(j) for j in joined], np.int64)
        lengths = np.array([len(w) for t in texts for w in t], np.int64)
        index = np.array([i for t in texts for i in range(len(t))], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return cls(code, owner, np.repeat(index, lengths), np.arange(len(code)) - starts[owner])

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every q-gram that lies in one owner."""
        n = len(self.code) - Q + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(Q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.code[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(self.owner[:n] == self.owner[Q - 1 :])
        return at, h[at]


def short_pieces(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(letter, hash) of every run of PIECE words that has fewer letters than a q-gram."""
    words = [w for t in texts for w in t]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(words) < PIECE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    last = len(words) - PIECE + 1
    short = np.flatnonzero((ends[PIECE - 1 :] - starts[:last] < Q) & (owner[:last] == owner[PIECE - 1 :]))
    hashes = [xxhash.xxh3_64_intdigest("\0".join(words[i : i + PIECE])) for i in short]
    return starts[short], np.array(hashes, np.uint64)


class Passages:
    """A block of passages, indexed by q-gram and by short piece."""

    def __init__(self, ids: list[int], texts: list[list[str]]):
        self.ids, self.texts = ids, texts
        self.letters = Letters.of(texts)
        self.grams = self._index(*self.letters.grams())
        self.pieces = self._index(*short_pieces(texts))
        self.sizes = np.array([len(t) for t in texts], np.int64)
        # per letter of the block: words (of all passages in a row) that start before it, and that end at or before it
        lengths = np.array([len(w) for t in texts for w in t], np.int64)
        ends = np.cumsum(lengths)
        letters = np.arange(len(self.letters.code) + 1)
        self.started = np.searchsorted(ends - lengths, letters, "left")
        self.ended = np.searchsorted(ends, letters, "right")
        # the q-grams of the piece of PIECE words that has the fewest, per passage: what a stretch must share at least
        self.bound = np.array([
            max(1, min((sum(map(len, t[i : i + PIECE])) for i in range(len(t) - PIECE + 1)), default=1) - Q + 1) for t in texts
        ], np.int64)

    @staticmethod
    def _index(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(h, kind="stable")
        keys, first, many = np.unique(h[order], return_index=True, return_counts=True)
        seen = np.zeros(1 << 22, bool)
        seen[(keys >> np.uint64(42)).astype(np.int64)] = True
        return at[order], keys, first, many, seen

    @staticmethod
    def _hits(index: tuple[np.ndarray, ...], at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letter in the documents, letter in the passages) of all equal entries."""
        places, keys, first, many, seen = index
        keep = seen[(h >> np.uint64(42)).astype(np.int64)]
        at, h = at[keep], h[keep]
        if not len(keys) or not len(h):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        same = keys[found] == h
        at, found = at[same], found[same]
        count = many[found]
        at = np.repeat(at, count)
        ends = np.cumsum(count)
        inner = np.arange(len(at)) - np.repeat(ends - count, count)
        return at, places[np.repeat(first[found], count) + inner]

    def regions(self, letters: Letters, docs: list[list[str]]) -> tuple[np.ndarray, ...]:
        """Runs of shared q-grams, (pair, first letter in the documents, in the passages), of pairs worth verifying."""
        at, place = self._hits(self.grams, *letters.grams())
        # hits on one diagonal of two texts are neighbours once sorted by it; diagonal and place are packed into one word
        base = len(self.letters.code)
        packed = np.sort(((at - place + base) << 32) | at)
        at = packed & 0xFFFFFFFF
        place = at - ((packed >> 32) - base)
        owner, passage = letters.owner[at], self.letters.owner[place]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(owner) != 0) | (np.diff(passage) != 0)
        heads = np.flatnonzero(fresh)
        tails = np.concatenate([heads[1:], [len(at)]]) - 1 if len(heads) else heads
        first = self.started[place[heads]]
        words = np.maximum(self.ended[place[tails] + Q] - first, 0)
        grams = tails - heads + 1
        at, place = at[heads], place[heads]
        if len(self.pieces[0]):
            more, there = self._hits(self.pieces, *short_pieces(docs))
            at, place = np.concatenate([at, more]), np.concatenate([place, there])
            words, first = np.concatenate([words, np.full(len(more), PIECE)]), np.concatenate([first, self.started[there]])
            grams = np.concatenate([grams, self.bound[self.letters.owner[there]]])  # a piece seen whole meets the bound
        if not len(at):
            return at, at, at
        pair = letters.owner[at] * len(self.texts) + self.letters.owner[place]
        passage = pair % len(self.texts)
        diagonal = letters.at[at] - self.letters.at[place]
        dense = np.zeros(len(pair), bool)
        for shift in (0, BAND // 2):
            _, band = np.unique(pair * (1 << 24) + (diagonal + shift) // BAND + (1 << 23), return_inverse=True)
            shared, longest = np.bincount(band, weights=grams), np.zeros(band.max() + 1, np.int64)
            np.maximum.at(longest, band, words)
            dense |= (shared[band] >= self.bound[passage]) & (longest[band] >= PIECE)
        pair, at, place, first, words = (c[dense] for c in (pair, at, place, first, words))
        order = np.lexsort((first, pair))
        pair, at, place, first, words = (c[order] for c in (pair, at, place, first, words))
        # words of the passage that the runs of a pair spell together, each counted once
        _, group = np.unique(pair, return_inverse=True)
        wide = np.int64(len(self.ended) + 1)
        reach = np.maximum.accumulate(group * wide + first + words) - group * wide if len(group) else first
        before = np.concatenate([[0], reach[:-1]])
        before[np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]] = 0
        fresh = np.maximum(first + words - np.maximum(before, first), 0)
        keep = np.bincount(group, weights=fresh)[group] >= SEEN * self.sizes[pair % len(self.texts)]
        return pair[keep], at[keep], place[keep]

    def search(self, docs: list[list[str]]) -> Iterator[tuple[int, int, float]]:
        """(document, passage, share of the passage's words covered) of each leak."""
        letters = Letters.of(docs)
        pair, at, place = self.regions(letters, docs)
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
        for a, b in zip(heads, [*heads[1:], len(pair)]):
            doc, passage = divmod(int(pair[a]), len(self.texts))
            text = self.texts[passage]
            share = covered(stretches(equal_runs(text, docs[doc], np.unique(letters.word[at[a:b]])), len(text))) / max(len(text), 1)
            if share >= COVER:
                yield doc, passage, share


def equal_runs(text: list[str], doc: list[str], near: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in the text, in the document, words) of the longest equal runs around the document's words ``near``.

    Only diagonals within the edit budget of a run of PIECE words are kept.
    """
    n = len(text)
    ids = {w: k for k, w in enumerate(dict.fromkeys(text))}
    own = np.array([ids[w] for w in text])
    cuts = np.flatnonzero(np.diff(near) > 2 * n) + 1
    found, far = [], -1
    for part in np.split(near, cuts):
        low, high = max(int(part[0]) - 2 * n, far, 0), min(int(part[-1]) + 2 * n, len(doc))
        far = high
        other = np.fromiter((ids.get(w, -1) for w in doc[low:high]), np.int64, high - low)
        i, j = np.nonzero(own[:, None] == other[None, :])
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order] + low
        if not len(i):
            continue
        fresh = np.ones(len(i), bool)
        fresh[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
        head = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([head, [len(i)]]))
        diagonal = (j - i)[head]
        strong = np.unique(diagonal[size >= PIECE])
        if not len(strong):
            continue
        slack = n // 10 + 1
        after = np.searchsorted(strong, diagonal)
        gap = np.minimum(
            np.abs(strong[np.minimum(after, len(strong) - 1)] - diagonal), np.abs(strong[np.maximum(after - 1, 0)] - diagonal)
        )
        ok = gap <= slack
        found += list(zip(i[head][ok].tolist(), j[head][ok].tolist(), size[ok].tolist()))
    return sorted(found)


def stretches(runs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int, int, int]]:
    """(first, last, from, to, altered): chains of equal runs within the edit budget, of at least STRETCH words.

    Words between two runs count as altered, the more of those on either side.
    """
    most = int(ALTERED * n + 1e-9)
    steps: list[list[tuple[int, int]]] = [[] for _ in runs]
    for a, (i, j, size) in enumerate(runs):
        for b in range(a + 1, len(runs)):  # runs lie in the order of the text
            p, q, length = runs[b]
            if p - i - size > most:
                break
            if q - j - size > most or p + length <= i + size or q + length <= j + size or p <= i or q <= j:
                continue
            trim = max(i + size - p, j + size - q, 0)
            if trim < length and (cost := max(p + trim - i - size, q + trim - j - size)) <= most:
                steps[a].append((b, cost))
    found = []
    for a, (i, j, _) in enumerate(runs):
        best = {a: 0}
        queue = [(i, a)]
        done = set()
        while queue:
            _, c = heapq.heappop(queue)
            if c in done:
                continue
            done.add(c)
            p, q, length = runs[c]
            words = p + length - i
            if words >= STRETCH and best[c] <= int(ALTERED * words + 1e-9):
                found.append((i, p + length - 1, j, q + length - 1, best[c]))
            for d, cost in steps[c]:
                if best[c] + cost < best.get(d, most + 1):
                    best[d] = best[c] + cost
                    done.discard(d)
                    heapq.heappush(queue, (runs[d][0], d))
    return found


def covered(found: list[tuple[int, int, int, int, int]]) -> int:
    """Most words in stretches that follow each other in text and document; where two overlap, the later starts after the earlier."""
    if not found:
        return 0
    s = np.array(sorted(set(found), key=lambda s: (s[1], s[3])), np.int64)
    best = np.zeros(len(s), np.int64)
    for k, (a, b, c, d, altered) in enumerate(s):
        best[k] = b - a + 1
        if k:
            lost = np.maximum(np.maximum(s[:k, 1] - a, s[:k, 3] - c) + 1, 0)
            rest = b - a + 1 - lost
            fits = (rest >= STRETCH) & (altered <= (ALTERED * rest + 1e-9).astype(np.int64)) & (s[:k, 3] < d)
            if fits.any():
                best[k] = max(best[k], int((best[:k] + rest)[fits].max()))
    return int(best.max())


def _search(passages: Passages):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, rows = b["doc_id"].tolist(), []
            lists = [word_list(t) for t in b["text"]]
            for k in range(0, len(lists), CHUNK):
                rows += [(passages.ids[p], ids[k + d], s) for d, p, s in passages.search(lists[k : k + CHUNK])]
            yield pd.DataFrame(rows, columns=["passage_id", "doc_id", "share"])

    return run


def leaked(spark: SparkSession, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(passage_id, doc_id, share): the documents that hold at least half of a passage's words in stretches.

    Passages are a stated query set: they are held in blocks, each checked to
    have at most BLOCK_LETTERS letters (or one passage), and each block meets
    all documents in one scan.
    Whole texts are searched. Null or empty texts, and passages of fewer than
    STRETCH words, match nothing; repeated passages and documents are each
    reported once per id; other columns are ignored.
    """
    held = passages.where("passage_id is not null and passage_text is not null").select("passage_id", "passage_text")
    blocks, own = 1, F.xxhash64("passage_id")
    while True:
        size = held.groupBy(F.pmod(own, F.lit(blocks)).alias("k")).agg(F.sum(F.length("passage_text")).alias("n"), F.countDistinct("passage_id").alias("m"))
        if size.where((F.col("n") > BLOCK_LETTERS) & (F.col("m") > 1)).isEmpty():
            break
        blocks *= 2
    texts, found = spread(documents.select("doc_id", "text")), []
    for k in range(blocks):
        block = held.where(F.pmod(own, F.lit(blocks)) == k) if blocks > 1 else held
        rows = sorted((r["passage_id"], r["passage_text"]) for r in block.distinct().collect())
        index = Passages([i for i, _ in rows], [word_list(t) for _, t in rows])
        found.append(
            texts.mapInPandas(_search(index), "passage_id bigint, doc_id bigint, share double")
        )
    return union_all(found).groupBy("passage_id", "doc_id").agg(F.max("share").alias("share"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a passage and a document it leaked into."""
    return leaked(spark, load(spark, root, "eval_passages"), load(spark, root, "documents")).select("passage_id", "doc_id")


def p7_passages(spark: SparkSession, root: str) -> DataFrame:
    """Per passage: documents that hold it, the greatest share held, and whether it leaked at all."""
    passages = load(spark, root, "eval_passages")
    pairs = Scratch(spark, "leaks").write(leaked(spark, passages, load(spark, root, "documents")), "pairs")
    counts = pairs.groupBy("passage_id").agg(F.count("*").alias("n_docs"), F.round(F.max("share"), 6).alias("most_share"))
    return passages.select("passage_id", "suite").join(counts, "passage_id", "left").select(
        "passage_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_share", F.lit(0.0)).alias("most_share")
    )


QUERIES = {"p7_found": p7_found, "p7_passages": p7_passages}
ORACLES: dict[str, str] = {}
