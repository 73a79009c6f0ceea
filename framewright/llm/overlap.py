"""p1: the same or nearly the same records across splits.

A picture is read as a text of its visible pixels: each symbol is the step from
the pixel before and the levels of its premultiplied colours, and each suffix
starts with its place in the frame, as frames lie in register. The suffixes of
all pictures, from every visible pixel, are put in order in partitions, cut at
DEPTH symbols; longer common prefixes show as chains of starts. Neighbours in
this order with a common prefix of LEAST symbols or more form an interval, in
which suffixes of train and evaluation pictures share a span; the spans of two
pictures are merged into the pixels they cover in common. As small edits in every
row can break all spans, pictures also meet in a grid over the sums of their
rows, in which no near pair is lost. The pairs of both paths are verified on the
full pixels. Digests and identities are joined beside.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.keys import digest, letters_and_digits, split_name
from framewright.operators.skew import lookup_join, salted_join
from framewright.session import Scratch, load, parallel_tasks, spread

SIDE, CHANNELS = 8, 4
PIXELS = SIDE * SIDE
BYTES = PIXELS * CHANNELS
#: Colour levels of a symbol are STEP wide, and a step of FAR pixels or more ends a text.
STEP, FAR = 64, 16
#: Symbols to which the suffix array is kept, and least common prefix of neighbours.
DEPTH, LEAST = 6, 5
#: Bits of a symbol: four for the step, six for the levels; a word starts with the place of its first pixel.
SYMBOL, LEVELS = 10, 6
#: Pixels that shared spans must cover together for a pair to be measured; pairs that share less are left to the grid.
COVER = 16
#: Candidate pairs up to which their pictures' names are broadcast; beyond, the pictures are shuffled to them.
FEW = 200_000
#: Rows of a key from which joins deal it out; at most HOTTEST keys are treated so, the greatest first.
HOT_ROWS, HOTTEST = 10_000, 64
#: Pictures whose suffixes one task orders.
PICTURES = 100_000
#: Pairs that one step compares, and estimated suffixes beyond which an interval is dealt over SALTS tasks.
PAIRS, CROWDED, SALTS = 1 << 21, 500_000, 16
#: One picture in SAMPLED tells which intervals are crowded; it decides where they are compared, never what.
SAMPLED = 64
#: Greatest mean difference of the 256 premultiplied values of near pictures.
NEAR = 2.0
#: Greatest sum of the differences of the row sums of near pictures, with room for rounding, and width of a grid cell.
#: A cell is wider than twice the budget, so a row sum reaches one neighbouring cell at most.
BUDGET, CELL = NEAR * BYTES + 1, 1040
#: Width of a band of brightness within an interval of the suffix array.
BAND = 4 * CELL

_RECORD = (
    "sequence_id string, split string, source_key string, identity string, digest string, blank boolean, pic bigint, image string, low bigint, high bigint, "
    "cells array<bigint>"
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed(words: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash per row of 64-bit words."""
    places = mixed(np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
    return mixed(mixed(words ^ places).sum(axis=1, dtype=np.uint64) + np.uint64(seed))


def pictures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, pixels [n, 64, 4]) of the values that are whole frames; hidden pixels are zeroed."""
    column = column.cast(pa.binary())
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros((0, PIXELS, CHANNELS), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = (np.diff(ends) == BYTES) & ~np.asarray(column.is_null())
    at = np.flatnonzero(whole)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    x = data[ends[at][:, None] + np.arange(BYTES)].reshape(-1, PIXELS, CHANNELS)
    x[x[:, :, 3] == 0] = 0
    return at, x


def premultiplied(x: np.ndarray) -> np.ndarray:
    v = x.astype(np.float32)
    v[:, :, :3] *= v[:, :, 3:] / np.float32(255)
    return v


def suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(picture, word) of each suffix: the place of its first pixel, its levels, and DEPTH - 1 times step and levels.

    Words compare like the suffixes they start. A suffix that ends before DEPTH
    symbols adds nothing to those before it and is kept only where the whole
    picture shows fewer visible pixels; its word is filled up with the end, zero.
    """
    owner, place = np.nonzero(x[:, :, 3] > 0)
    level = np.minimum(premultiplied(x)[owner, place, :3] / STEP, 3).astype(np.int64)
    levels = level[:, 0] << 4 | level[:, 1] << 2 | level[:, 2]
    n = len(owner)
    word = (place << LEVELS) | levels
    inside = np.ones(n, bool)
    for k in range(1, DEPTH):
        at = np.minimum(np.arange(n) + k, n - 1)
        step = place[at] - place[at - 1] if n else place
        inside &= (np.arange(n) + k < n) & (owner[at] == owner) & (step < FAR)
        word = (word << SYMBOL) | np.where(inside, (step << LEVELS) | levels[at], 0)
    shown = np.bincount(owner, minlength=len(x))
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else inside
    kept = inside | (first & (shown[owner] < DEPTH))
    return owner[kept], word[kept]


def span_mask(word: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The pixels that the first ``symbols`` symbols of a word show, one bit each."""
    place = word >> (LEVELS + SYMBOL * (DEPTH - 1))
    mask = np.uint64(1) << place.astype(np.uint64)
    for k in range(1, DEPTH):
        step = (word >> (SYMBOL * (DEPTH - 1 - k) + LEVELS)) & (FAR - 1)
        place = place + step
        mask |= np.where((k < symbols) & (step > 0), np.uint64(1) << (place & 63).astype(np.uint64), np.uint64(0))
    return mask.view(np.int64)


def halves(x: np.ndarray) -> np.ndarray:
    """Sums of the premultiplied values of the upper and the lower half of a picture, 15 bits each."""
    half = np.floor(premultiplied(x).reshape(len(x), 2, BYTES // 2).sum(2)).astype(np.int64)
    return half[:, 0] << 15 | half[:, 1]


def row_sums(x: np.ndarray) -> np.ndarray:
    """The sums of the premultiplied values of each pixel row; together they differ by no more than the pictures do."""
    return premultiplied(x).reshape(len(x), SIDE, SIDE * CHANNELS).sum(2, dtype=np.float64)


def packed(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row sums without fractions, 16 bits each: of the upper and of the lower four rows."""
    whole = np.floor(sums).astype(np.int64)
    return tuple(whole[:, k] | whole[:, k + 1] << 16 | whole[:, k + 2] << 32 | whole[:, k + 3] << 48 for k in (0, 4))


def cells(sums: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(picture, key) of the grid cell of the row sums, and where ``around`` says so of every cell that a near picture can lie in.

    To leave a cell a row sum must change by its distance to the border, and
    the changes of all rows together stay within the budget: about 33 cells.
    """
    cell = np.floor(sums / CELL).astype(np.int64)
    up = sums - cell * CELL > CELL / 2
    away = np.where(up, (cell + 1) * CELL - sums, sums - cell * CELL)
    owner, rest = np.arange(len(sums)), np.full(len(sums), BUDGET)
    for r in range(SIDE):
        move = np.flatnonzero(around[owner] & (away[owner, r] <= rest))
        moved = cell[move].copy()
        moved[:, r] += np.where(up[owner[move], r], 1, -1)
        cell, rest = np.concatenate([cell, moved]), np.concatenate([rest, rest[move] - away[owner[move], r]])
        owner = np.concatenate([owner, owner[move]])
    return owner, hashed(cell.view(np.uint64), 211).view(np.int64)


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """One list per row of the values it owns."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[np.argsort(owner, kind="stable")]))


def _gap(one: str, two: str) -> Column:
    """Sum of the differences of four packed sums: never more than that of all values, but for rounding."""
    quarter = lambda c, k: F.shiftright(c, 16 * k).bitwiseAND(F.lit(65535))
    return sum((F.abs(quarter(one, k) - quarter(two, k)) for k in range(4)), F.lit(0))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with blank flag, picture hash and a 128-bit name of the picture; of equal pictures of one side in a batch one carries the cells."""
    for b in batches:
        n = b.num_rows
        at, x = pictures(b.column("rgba"))
        pic = hashed(x.reshape(len(x), BYTES).view(np.uint64), 7).view(np.int64)
        seen = (x[:, :, 3] > 0).any(1)
        train = np.array([s == "train" for s in b.column("split").to_pylist()], bool)
        _, heads = np.unique(np.stack([pic, train[at].astype(np.int64)], axis=1)[seen], axis=0, return_index=True)
        heads = np.flatnonzero(seen)[heads]
        sums = row_sums(x)
        cell_owner, cell_key = cells(sums[heads], ~train[at[heads]])
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[at], high[at] = packed(sums)
        blank = np.zeros(n, bool)
        blank[at[~seen]] = True
        whole, hidden = np.zeros(n, np.int64), np.ones(n, bool)
        whole[at[seen]], hidden[at[seen]] = pic[seen], False
        image: list[str | None] = [None] * n
        for k, v in zip(at[seen], x[seen]):
            image[k] = blake2b(v.tobytes(), digest_size=16).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("sequence_id", "split", "source_key", "identity", "digest")]
            + [pa.array(blank), pa.array(whole, mask=hidden), pa.array(image, pa.string()), pa.array(low, mask=hidden), pa.array(high, mask=hidden)]
            + [_lists(at[heads][cell_owner], cell_key, n)],
            names=["sequence_id", "split", "source_key", "identity", "digest", "blank", "pic", "image", "low", "high", "cells"],
        )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, pic, seat) of every suffix; seat holds the side of the picture and the sums of its halves."""
    for b in batches:
        at, x = pictures(b.column("rgba"))
        train = np.asarray(b.column("train"))[at].astype(np.int64)
        pic = hashed(x.reshape(len(x), BYTES).view(np.uint64), 7).view(np.int64)
        _, heads = np.unique(np.stack([pic, train], axis=1), axis=0, return_index=True)
        owner, word = suffixes(x[heads])
        seat = (train[heads] << 30) | halves(x[heads])
        yield pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(pic[heads][owner]), pa.array(seat[owner].astype(np.int32))], names=["word", "pic", "seat"]
        )


def _interval_pairs(word: np.ndarray, pic: np.ndarray, seat: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pic_train, pic_eval, mask) of each train and evaluation suffix of one interval and slot whose halves may be those of near pictures."""
    interval = np.cumsum(fresh) - 1
    is_train = (seat >> 30 & 1) == 1
    t, e = np.flatnonzero(is_train), np.flatnonzero(~is_train)
    low, high = np.searchsorted(interval[t], interval[e], "left"), np.searchsorted(interval[t], interval[e], "right")
    e, low, many = e[high > low], low[high > low], (high - low)[high > low]
    for part in np.split(np.arange(len(e)), np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1):
        if not len(part):
            continue
        one = np.repeat(e[part], many[part])
        ends = np.cumsum(many[part])
        two = t[np.repeat(low[part] - (ends - many[part]), many[part]) + np.arange(ends[-1])]
        a, b = seat[one], seat[two]
        away = np.abs((a >> 15 & 32767) - (b >> 15 & 32767)) + np.abs((a & 32767) - (b & 32767))
        near = (away <= NEAR * BYTES + 8) & (a >> 31 == b >> 31) & (pic[one] != pic[two])
        one, two = one[near], two[near]
        common = np.where(word[one] == word[two], DEPTH, LEAST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pic[two]), pa.array(pic[one]), pa.array(span_mask(word[one], common))], names=["pic_train", "pic_eval", "mask"]
        )


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks ordered suffixes; neighbours with a common prefix of LEAST symbols or more stay in one interval."""
    held: list[np.ndarray] | None = None
    wait = 1 << 17

    def fresh_of(word: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] ^ word[:-1]) >> (SYMBOL * (DEPTH - LEAST)) != 0
        return fresh

    for b in batches:
        rows = [b.column(c).to_numpy() for c in ("word", "pic", "seat")]
        held = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows)]
        if len(held[0]) < wait:
            continue
        fresh = fresh_of(held[0])
        last = int(np.flatnonzero(fresh)[-1])  # the last interval may go on
        yield from _interval_pairs(*[c[:last] for c in held], fresh[:last])
        held = [c[last:] for c in held]
        wait = len(held[0]) + (1 << 17)
    if held is not None and len(held[0]):
        yield from _interval_pairs(*held, fresh_of(held[0]))


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, x = pictures(b.column("rgba"))
        pic = hashed(x.reshape(len(x), BYTES).view(np.uint64), 7).view(np.int64)
        _, heads = np.unique(pic, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pic[heads]), pa.array([v.tobytes() for v in x[heads]], pa.binary())], names=["pic", "pixels"]
        )


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (_, x), (_, y) = pictures(b.column("one")), pictures(b.column("two"))
        p, q = premultiplied(x).astype(np.float64), premultiplied(y).astype(np.float64)
        away = np.abs(p - q).reshape(len(x), BYTES).mean(1) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [b.column("pic_train"), b.column("pic_eval"), b.column("mask"), pa.array(away)],
            names=["pic_train", "pic_eval", "mask", "away"],
        )


class Overlaps:
    """Cross-split overlaps of a table of frames.

    Rows without split take no part. Nulls, blanks and "unknown" equal
    nothing; a picture that is null, not a whole frame, or shows no visible
    pixel matches nothing, and neither does the digest of such a blank
    picture. Repeated rows of a key count once. Clashing extra columns are
    not read.
    """

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.source = spark, df
        self.scratch = Scratch(spark, "overlap")
        split = split_name(F.col("split"))
        typed = spread(df).where(F.col("sequence_id").isNotNull() & split.isNotNull()).select(
            "sequence_id",
            split.alias("split"),
            letters_and_digits(F.col("source_id")).alias("source_key"),
            letters_and_digits(F.col("identity_id")).alias("identity"),
            digest(F.col("normalized_array_sha256")).alias("digest"),
            "rgba",
        )
        self.records = self.scratch.write(typed.mapInArrow(_records, _RECORD), "records")

    def _grid_pairs(self) -> DataFrame:
        """(pic_train, pic_eval): different pictures whose row sums differ by no more than those of near pictures may."""
        once = self.records.where("size(cells) > 0").select("pic", (F.col("split") == "train").alias("train"), "low", "high", "cells").dropDuplicates(["pic", "train"])
        side = lambda train, name: once.where(F.col("train") == train).select(
            F.explode("cells").alias("key"), F.col("pic").alias(f"pic_{name}"), F.col("low").alias(f"low_{name}"), F.col("high").alias(f"high_{name}"))
        gap = _gap("low_train", "low_eval") + _gap("high_train", "high_eval")
        return (
            side(True, "train").join(side(False, "eval"), "key")
            .where((F.col("pic_train") != F.col("pic_eval")) & (gap <= NEAR * BYTES + 8))
            .select("pic_train", "pic_eval")
        )

    def _sides(self) -> DataFrame:
        split = split_name(F.col("split"))
        return self.source.where(F.col("sequence_id").isNotNull() & F.col("rgba").isNotNull() & split.isNotNull()).select(
            (split == "train").alias("train"), "rgba"
        )

    def _banded(self, pictures: DataFrame) -> DataFrame:
        """Suffixes with their band of brightness; an evaluation suffix also enters the band that its budget reaches."""
        total = F.shiftright("seat", 15).bitwiseAND(F.lit(32767)) + F.col("seat").bitwiseAND(F.lit(32767))
        reach = F.when(F.col("seat") < (1 << 30), F.lit(int(BUDGET) + 2)).otherwise(F.lit(0))
        bands = F.sequence(F.floor((total - reach) / BAND).cast("int"), F.floor((total + reach) / BAND).cast("int"))
        return pictures.mapInArrow(_suffixes, "word bigint, pic bigint, seat int").select("word", "pic", "seat", F.explode(bands).alias("band"))

    def _span_pairs(self) -> DataFrame:
        """(pic_train, pic_eval, mask): neighbours in the suffix array of train and evaluation, with the pixels of their common prefix."""
        sides, interval = self._sides(), F.shiftright("word", SYMBOL * (DEPTH - LEAST))
        crowded = [
            (r["interval"], r["band"])
            for r in self._banded(sides.sample(1 / SAMPLED, seed=1)).groupBy(interval.alias("interval"), "band").count()
            .where(F.col("count") >= CROWDED / SAMPLED).orderBy(F.desc("count")).limit(1000).collect()
        ]
        rows, salt = self._banded(spread(sides)), F.lit(0)
        if crowded:
            hot = self.spark.createDataFrame(crowded, "_interval bigint, _band int")
            # at most 1000 intervals; train suffixes of a crowded one are dealt out, the evaluation suffixes meet each part
            rows = rows.join(F.broadcast(hot), (interval == F.col("_interval")) & (F.col("band") == F.col("_band")), "left")
            is_hot, train = F.col("_interval").isNotNull(), F.col("seat") >= (1 << 30)
            own = F.array(F.when(is_hot & train, F.pmod("pic", F.lit(SALTS)).cast("int")).otherwise(0))
            rows = rows.withColumn("salt", F.explode(F.when(is_hot & ~train, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(own)))
            salt = F.col("salt")
        # three words a row: the slot, band and salt, rides above the seat
        slot = F.shiftleft((F.col("band") * SALTS + salt).cast("bigint"), 31)
        return (
            rows.select("word", "pic", slot.bitwiseOR(F.col("seat").cast("bigint")).alias("seat"))
            .repartition(max(parallel_tasks(self.spark), self.records.count() // PICTURES), interval, F.shiftright("seat", 31))
            .sortWithinPartitions("word")
            .mapInArrow(_intervals, "pic_train bigint, pic_eval bigint, mask bigint")
        )

    def near_pictures(self) -> DataFrame:
        """(pic_train, pic_eval, mask, away) of different pictures whose mean difference is at most NEAR; mask shows the pixels of shared spans."""
        pairs = (
            self._span_pairs().withColumn("in_grid", F.lit(False))
            .unionByName(self._grid_pairs().select("*", F.lit(0).cast("bigint").alias("mask"), F.lit(True).alias("in_grid")))
            .groupBy("pic_train", "pic_eval")
            .agg(F.bit_or("mask").alias("mask"), F.max("in_grid").alias("in_grid"))  # shared spans merged into coverage
            .where(F.col("in_grid") | (F.bit_count("mask") >= COVER))
            .drop("in_grid")
        )
        pairs = self.scratch.write(pairs, "candidates")
        ends = pairs.select("pic_train", "pic_eval", "mask", F.explode(F.array(
            F.struct(F.col("pic_train").alias("pic"), F.lit(True).alias("is_train")),
            F.struct(F.col("pic_eval").alias("pic"), F.lit(False).alias("is_train")),
        )).alias("e")).select("pic_train", "pic_eval", "mask", "e.pic", "e.is_train")
        wanted = ends.select("pic").distinct()
        if pairs.count() <= FEW:
            wanted = F.broadcast(wanted)
        pixels = (
            self._sides()
            .select("rgba")
            .mapInArrow(_pixels, "pic bigint, pixels binary")
            .join(wanted, "pic", "left_semi")
            .groupBy("pic")
            .agg(F.first("pixels").alias("pixels"))
        )
        both = (
            ends.join(pixels, "pic")
            .groupBy("pic_train", "pic_eval", "mask")
            .agg(
                F.max(F.when(F.col("is_train"), F.col("pixels"))).alias("one"),
                F.max(F.when(~F.col("is_train"), F.col("pixels"))).alias("two"),
            )
        )
        measured = both.mapInArrow(_distances, "pic_train bigint, pic_eval bigint, mask bigint, away double")
        return measured.where(F.col("away") <= NEAR)

    def _keyed(self) -> tuple[DataFrame, list]:
        """(sequence_id, split, k) of the rows whose identity, digest or picture stands on both sides; and the hot keys among them."""
        rows = self.records.select("sequence_id", "split", "identity", "digest", "blank", "image")
        void = rows.where("blank and digest is not null").select(F.concat(F.lit("d"), "digest").alias("k")).distinct()
        keyed = rows.select(
            "sequence_id", "split",
            F.explode(F.array_compact(F.array(
                F.concat(F.lit("i"), "identity"),
                F.when(~F.col("blank"), F.concat(F.lit("d"), "digest")),
                F.concat(F.lit("p"), "image"),
            ))).alias("k"),
        )
        is_train = F.col("split") == "train"
        shared = (
            keyed.groupBy("k")
            .agg(F.max(is_train).alias("_t"), F.max(~is_train).alias("_e"), F.count("*").alias("n"))
            .where("_t and _e")
            .select("k", "n")
            .join(void, "k", "left_anti")
        )
        shared = self.scratch.write(shared, "shared")
        hot = _hottest(shared, "k")
        return self.scratch.write(lookup_join(keyed, shared.select("k"), "k", hot=hot).distinct(), "held"), hot

    def pairs(self) -> DataFrame:
        """(train_id, eval_id, kind): kind is identity, digest, same picture or near picture."""
        (held, hot), is_train = self._keyed(), F.col("split") == "train"
        train = held.where(is_train).select("k", F.col("sequence_id").alias("train_id"))
        others = held.where(~is_train).select("k", F.col("sequence_id").alias("eval_id"))
        equal = salted_join(train, others, "k", hot=hot).withColumn("kind", _kind("k")).drop("k")
        near = self.scratch.write(self.near_pictures(), "near").select("pic_train", "pic_eval")
        pics = self.records.where("pic is not null")
        of_train = pics.where(is_train).select(F.col("pic").alias("pic_train"), F.col("sequence_id").alias("train_id"))
        of_eval = pics.where(~is_train).select(F.col("pic").alias("pic_eval"), F.col("sequence_id").alias("eval_id"))
        hot = _hottest(pics.groupBy("pic").agg(F.count("*").alias("n")), "pic")
        close = salted_join(of_eval, salted_join(of_train, near, "pic_train", hot=hot), "pic_eval", hot=hot).withColumn("kind", F.lit("near picture"))
        names = ["train_id", "eval_id", "kind"]
        return equal.select(*names).unionByName(close.select(*names)).where("train_id <> eval_id")

    def overlapping(self) -> DataFrame:
        """(eval_id, kind, mask) of the evaluation rows with a partner in train, without listing the partners.

        Per key the smallest and the greatest train row tell whether one other
        than the row itself exists. ``mask`` shows the pixels that spans shared
        with near train pictures cover together; null for the other kinds.
        """
        (held, hot), is_train = self._keyed(), F.col("split") == "train"
        ends = [F.min("sequence_id").alias("least"), F.max("sequence_id").alias("most")]
        by_key = held.where(is_train).groupBy("k").agg(*ends)
        other = (F.col("least") != F.col("eval_id")) | (F.col("most") != F.col("eval_id"))
        equal = lookup_join(held.where(~is_train).select("k", F.col("sequence_id").alias("eval_id")), by_key, "k", hot=hot).where(other).select(
            "eval_id", _kind("k").alias("kind"), F.lit(None).cast("bigint").alias("mask")
        )
        near = self.scratch.write(self.near_pictures(), "near")
        pics = self.records.where("pic is not null")
        by_pic = pics.where(is_train).groupBy(F.col("pic").alias("pic_train")).agg(*ends)
        of_eval = near.join(by_pic, "pic_train").groupBy("pic_eval").agg(
            F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or("mask").alias("mask")
        )
        rows = pics.where(~is_train).select(F.col("pic").alias("pic_eval"), F.col("sequence_id").alias("eval_id"))
        hot = _hottest(rows.groupBy("pic_eval").agg(F.count("*").alias("n")), "pic_eval")
        close = lookup_join(rows, of_eval, "pic_eval", hot=hot).where(other).select("eval_id", F.lit("near picture").alias("kind"), "mask")
        return equal.unionByName(close)


def _hottest(counts: DataFrame, key: str) -> list:
    """The keys of at least HOT_ROWS rows, the HOTTEST greatest of them."""
    return [r[0] for r in counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).select(key).limit(HOTTEST).collect()]


def _kind(key: str) -> Column:
    first = F.substring(key, 1, 1)
    return F.when(first == "i", "identity").when(first == "d", "digest").otherwise("same picture")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of a train row and an evaluation row that show the same or nearly the same picture or share an identity."""
    return (
        Overlaps(spark, load(spark, root, "prepared_broad_rows")).pairs()
        .select(F.least("train_id", "eval_id").alias("sequence_id_a"), F.greatest("train_id", "eval_id").alias("sequence_id_b"))
        .distinct()
    )


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap train, by which kind, and pixels that shared spans cover in near rows."""
    found = Overlaps(spark, load(spark, root, "prepared_broad_rows"))
    hit = found.overlapping().groupBy("eval_id").agg(
        *[F.max((F.col("kind") == k).cast("int")).alias(c) for k, c in
          (("identity", "_identity"), ("digest", "_digest"), ("same picture", "_same"), ("near picture", "_near"))],
        F.bit_count(F.bit_or("mask")).alias("_covered"),
    )
    rows = found.records.where("split <> 'train'").select("sequence_id", "split", "source_key").dropDuplicates(["sequence_id"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return (
        rows.join(hit, rows["sequence_id"] == hit["eval_id"], "left")
        .groupBy("split", "source_key")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("eval_id").alias("n_overlapping"),
            total("_identity").alias("by_identity"),
            total("_digest").alias("by_digest"),
            total("_same").alias("by_same_picture"),
            total("_near").alias("by_near_picture"),
            total("_covered").alias("covered_pixels"),
        )
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
_BYTE = "CAST(('0x' || substr(h, 8 * i + {k}, 2)) AS INTEGER)"
_HEX = "regexp_replace(regexp_replace(lower(normalized_array_sha256), 'sha-?256', ''), '[^0-9a-z]+', '', 'g')"
_LETTERS = "regexp_replace(lower(split), '[^a-z]+', '', 'g')"
ORACLES = {
    # every train picture against every evaluation picture, pixel by pixel
    "p1_found": rf"""
        WITH b AS (SELECT sequence_id, CASE WHEN {_LETTERS} LIKE 'train%' THEN 'train' WHEN regexp_matches({_LETTERS}, '^(val|dev|test)') THEN 'held' END AS side, rgba, {_HEX} AS d,
            regexp_replace(lower(translate(identity_id, (SELECT string_agg(chr(CAST(65281 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)),
                (SELECT string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) FROM range(94) r(i)))), '[^\p{{L}}\p{{N}}]+', '', 'g') AS i FROM prepared_broad_rows WHERE sequence_id IS NOT NULL),
        r AS (SELECT * FROM b WHERE side IS NOT NULL),
        pic AS (SELECT rgba, row_number() OVER () AS n FROM (SELECT DISTINCT rgba FROM r WHERE octet_length(rgba) = 256)),
        e AS (SELECT n, hex(rgba) AS h, unnest(range(64)) AS i FROM pic),
        p AS (SELECT n, i, {_BYTE.format(k=1)} * a / 255.0 AS r, {_BYTE.format(k=3)} * a / 255.0 AS g, {_BYTE.format(k=5)} * a / 255.0 AS b, a FROM (SELECT *, {_BYTE.format(k=7)} AS a FROM e)),
        s AS (SELECT n, max(a) > 0 AS seen, sum(r) AS r, sum(g) AS g, sum(b) AS b, sum(a) AS a FROM p GROUP BY 1),
        w AS (SELECT DISTINCT r.sequence_id, r.side, pic.n FROM r JOIN pic USING (rgba) JOIN s ON s.n = pic.n WHERE s.seen),
        t AS (SELECT DISTINCT n FROM w WHERE side = 'train'), v AS (SELECT DISTINCT n FROM w WHERE side = 'held'),
        -- the sums of a channel differ by no more than its values do
        k AS (SELECT t.n AS x, v.n AS y FROM t JOIN s a ON a.n = t.n JOIN s c ON abs(a.r - c.r) + abs(a.g - c.g) + abs(a.b - c.b) + abs(a.a - c.a) <= 513 JOIN v ON v.n = c.n),
        near AS (SELECT x, y FROM k JOIN p a ON a.n = x JOIN p c ON c.n = y AND c.i = a.i GROUP BY 1, 2
            HAVING sum(abs(a.r - c.r) + abs(a.g - c.g) + abs(a.b - c.b) + abs(a.a - c.a)) / 256 <= 2.0),
        blank AS (SELECT DISTINCT r.d FROM r JOIN pic USING (rgba) JOIN s ON s.n = pic.n WHERE NOT s.seen),
        dig AS (SELECT DISTINCT r.sequence_id, r.side, d FROM r WHERE regexp_full_match(d, '[0-9a-f]{{64}}') AND NOT regexp_full_match(d, '0+') AND d NOT IN (SELECT d FROM blank WHERE d IS NOT NULL)),
        ide AS (SELECT DISTINCT sequence_id, side, i FROM r WHERE i NOT IN ('', 'unknown')),
        q AS (SELECT a.sequence_id AS x, c.sequence_id AS y FROM near JOIN w a ON a.n = near.x AND a.side = 'train' JOIN w c ON c.n = near.y AND c.side = 'held'
            UNION SELECT a.sequence_id, c.sequence_id FROM dig a JOIN dig c ON a.d = c.d WHERE a.side = 'train' AND c.side = 'held'
            UNION SELECT a.sequence_id, c.sequence_id FROM ide a JOIN ide c ON a.i = c.i WHERE a.side = 'train' AND c.side = 'held')
        SELECT DISTINCT least(x, y) AS sequence_id_a, greatest(x, y) AS sequence_id_b FROM q WHERE x <> y
    """,
}
