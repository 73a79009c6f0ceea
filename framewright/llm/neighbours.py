"""p4: the k most similar vectors for every vector, by shifted Hilbert orderings.

Every distinct vector is put in order along several space-filling curves, each
over its own random axes and shift. Vectors near each other in space are near in
at least one order with high probability, so per curve each row meets the rows
of its own, the preceding and the following window; the windows' results are
merged and reranked by exact cosine. Vectors of one cell of a curve are ordered
by the same curve's next finer levels, so a dense group of near copies is
ordered along each curve like the whole table.

How many curves a table needs depends on how its vectors are spread. So recall is
measured in every run, on PROBES rows against all others, and curves are added
by rounds until it reaches TARGET. Where MOST curves don't reach it, as for
vectors evenly spread in all directions, blocks of rows are compared exactly.
The queries take the exact way at once, as their SQL lists every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.skew import lookup_join
from framewright.session import Scratch, load, parallel_tasks

DIMENSIONS = 64
NEIGHBOURS = 5
#: Orderings added in a round and in all, rows per window, axes and bits per axis of a curve.
CURVES, MOST, WINDOW, AXES, BITS = 3, 24, 4096, 8, 7
#: Rows whose true neighbours are found to measure recall, and the recall at which no more curves are added.
PROBES, TARGET = 512, 0.995
#: Rows of a block of the exact search, of a task that walks a curve, and rows multiplied at once.
BLOCK, TASK_ROWS, STEP = 1 << 17, 1 << 17, 512
#: Least blocks of the exact search of a table of more than STEP rows.
LEAST_BLOCKS = 4
#: Columns of a tile of products, and partners of a row, on average, that are gathered before they are ranked.
TILE, LOOSE = 2048, 64
#: More than the single-precision product of two unit vectors can err; decimals to which cosines are compared.
ERR, DIGITS = np.float32(1e-5), 13
#: The same of double precision, and partners of a row, on average, beyond which it is taken.
FINE, CROWD = 1e-12, 1024
#: Further bits per axis, each time BITS, that order the vectors of one cell.
FINER = 2
NEAR = "row_index bigint, near array<struct<away:double,other:bigint>>"
POSITIONS = ["position", *[f"finer{k}" for k in range(1, FINER + 1)]]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells [n, axes], axes * bits <= 63."""
    return hilbert_keys(cells, bits, bits)[0]


def hilbert_keys(cells: np.ndarray, bits: int, part: int) -> list[np.ndarray]:
    """Position along the Hilbert curve of integer cells [n, axes] as keys of ``part`` levels each, coarsest first, axes * part <= 63.

    Per level from the coarsest, the orthant of a cell is read as a Gray code,
    after undoing the reflection and rotation that the levels above imply.
    """
    n, axes = cells.shape
    full = (1 << axes) - 1
    entry = np.zeros(n, np.int64)  # corner where the curve enters the current cube
    turn = np.zeros(n, np.int64)  # rotation of the axes within the current cube
    key = np.zeros(n, np.int64)
    keys = []
    for level in range(bits - 1, -1, -1):
        orthant = np.zeros(n, np.int64)
        for a in range(axes):
            orthant |= ((cells[:, a].astype(np.int64) >> level) & 1) << a
        seen = orthant ^ entry
        by = (turn + 1) % axes
        seen = ((seen >> by) | (seen << (axes - by))) & full
        rank = seen.copy()
        step = 1
        while step < axes:
            rank ^= rank >> step
            step <<= 1
        key = (key << axes) | rank
        even = np.where(rank == 0, 0, ((rank - 1) >> 1) << 1)
        corner = np.where(rank == 0, 0, even ^ (even >> 1))
        low = np.where(rank % 2 == 1, rank, rank - 1)  # trailing ones of this number give the direction
        low = np.where(rank == 0, 0, low)
        ones = np.zeros(n, np.int64)
        alive = np.ones(n, bool)
        for a in range(axes):
            alive &= ((low >> a) & 1) == 1
            ones += alive
        direction = np.where(rank == 0, 0, ones % axes)
        entry = entry ^ (((corner << by) | (corner >> (axes - by))) & full)
        turn = (turn + direction + 1) % axes
        if level % part == 0:
            keys.append(key)
            key = np.zeros(n, np.int64)
    return keys


def _matrix(column: pa.Array, width: int = DIMENSIONS) -> np.ndarray:
    """The vectors of a binary column of whole float32 vectors."""
    if not len(column):
        return np.zeros((0, width), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(np.float32).reshape(-1, width) if ends[0] % 4 == 0 else np.frombuffer(data.tobytes(), np.float32).reshape(-1, width)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(0, (len(x) + 1) * x.shape[1] * 4, x.shape[1] * 4, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_index, unit, own: its product with itself, whole: digest of the vector) of the vectors of DIMENSIONS finite numbers that aren't all zero."""
    for b in batches:
        column = b.column("v").cast(pa.list_(pa.float64()))
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        at = np.flatnonzero((np.diff(ends) == DIMENSIONS) & ~np.asarray(column.is_null()))
        values = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # a null entry is not a number
        x = values[ends[at][:, None] + np.arange(DIMENSIONS)]
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])  # entry by entry, as in products
            fit = np.isfinite(x).all(1) & (norm > 0) & np.isfinite(norm)
            unit = x[fit] / norm[fit][:, None]
        unit = unit.astype(np.float32)
        whole = [blake2b(v.tobytes(), digest_size=16).digest() for v in x[fit] + 0.0]  # -0.0 is 0.0
        own = products(unit, unit, np.arange(len(unit)), np.arange(len(unit)))
        keys = b.column("row_index").take(pa.array(at[fit]))
        yield pa.RecordBatch.from_arrays([keys, _binary(unit), pa.array(own), pa.array(whole, pa.binary())], names=["row_index", "unit", "own", "whole"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, value): number of vectors, their sums and the sums of their products, each under its own number."""
    n, total, outer = 0, np.zeros(DIMENSIONS), np.zeros((DIMENSIONS, DIMENSIONS))
    for b in batches:
        x = _matrix(b.column("unit")).astype(np.float64)
        n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
    if n:
        values = np.concatenate([[n], total, outer.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])


def _curves(count: int, mean: np.ndarray, cov: np.ndarray, seed: int):
    """Axes of curves: random directions, drawn the likelier the more the vectors vary along them."""
    rng = np.random.default_rng(seed)
    root = cov / max(np.trace(cov), 1e-12) + 1e-9 * np.eye(DIMENSIONS)
    for _ in range(count):
        axes = np.linalg.qr(root @ rng.normal(size=(DIMENSIONS, AXES)))[0]
        spread = np.sqrt(np.maximum(np.einsum("da,de,ea->a", axes, cov, axes), 1e-12))
        yield (axes / spread).astype(np.float32), (mean @ axes / spread).astype(np.float32), rng.random(AXES) * 0.5


def _keyed(curves: list, bits: int = BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("unit"))
            for j, (axes, mean, shift) in enumerate(curves):
                z = x.astype(np.float64) @ axes - mean
                even = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution function
                deep = bits * (1 + FINER)
                cells = np.minimum(((even * 0.5 + shift) * (1 << deep)).astype(np.int64), (1 << deep) - 1)
                positions = hilbert_keys(cells, deep, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(x), j, np.int32)),
                        *[pa.array(p) for p in positions],
                        b.column("row_index"),
                        b.column("unit"),
                    ],
                    names=["curve", *POSITIONS, "row_index", "unit"],
                )

    return run


def products(p: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of rows of p and y, added entry by entry so that a pair has one value wherever it is met, rounded to DIGITS decimals."""
    out = np.empty(len(row))
    for a in range(0, len(row), 1 << 14):
        at = slice(a, a + (1 << 14))
        out[at] = np.cumsum(p[row[at]].astype(np.float64) * y[col[at]], axis=1)[:, -1]
    out *= 10**DIGITS
    return np.trunc(out + np.copysign(0.5, out)) / 10**DIGITS


def best_of(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray, k: int) -> pa.RecordBatch | None:
    """(row_index, near): for each key of x the k rows of y of greatest cosine, rows of its own key left out, ties to the smaller key.

    A key of several rows has the k best of them all. Single precision only
    leaves out what lies further below the k-th best than it can err; the rest
    is ranked by double, to DIGITS decimals.
    """
    take = min(k, len(other))
    if take < 1 or not len(ids):
        return None
    whose, keys, away = [], [], []
    for a in range(0, len(ids), STEP):
        p, mine = x[a : a + STEP], ids[a : a + STEP]
        row, col = _passing(p, mine, other, y, take, np.float32, ERR) or _passing(p, mine, other, y, take, np.float64, FINE)
        whose.append(a + row)
        keys.append(other[col])
        away.append(-products(p, y, row, col))
        kept = _first(whose[-1], away[-1], keys[-1], k)
        whose[-1], keys[-1], away[-1] = whose[-1][kept], keys[-1][kept], away[-1][kept]
    whose, keys, away = np.concatenate(whose), np.concatenate(keys), np.concatenate(away)
    names, place = np.unique(ids, return_inverse=True)
    if len(names) < len(ids):
        ids, whose = names, place[whose]
        kept = _first(whose, away, keys, k)
        whose, keys, away = whose[kept], keys[kept], away[kept]
    ends = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(ids)))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(away), pa.array(keys)], ["away", "other"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["row_index", "near"])


def _passing(p: np.ndarray, mine: np.ndarray, other: np.ndarray, y: np.ndarray, take: int, kind: type, err: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, col) of the products of p and y that can be among the ``take`` greatest of a row, rows of its own key left out, if products of ``kind`` err by ``err``.

    Products are made by tiles that stay in the cache, and each row's bound
    rises as partners come in. None where single precision leaves more than
    CROWD partners a row.
    """
    p, held = p.astype(kind), np.empty(len(p) * min(TILE, len(y)), kind)
    row, col, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    met, size, bound = [], 0, np.full((len(p), 1), -3, kind)
    full = LOOSE * len(p)
    for c in range(0, len(y), TILE):
        part = y[c : c + TILE].astype(kind, copy=False)
        s = np.matmul(p, part.T, out=held[: len(p) * len(part)].reshape(len(p), len(part)))
        if c == 0:  # the first columns give each row a bound that few others pass
            s[mine[:, None] == other[None, : len(part)]] = -4
            bound = np.maximum(np.partition(s, len(part) - take, axis=1)[:, [len(part) - take]] - kind(err), -3)
        at = np.flatnonzero(s >= bound)
        r, q = np.divmod(at, len(part))
        alien = other[c + q] != mine[r]
        met.append((r[alien], c + q[alien], s.reshape(-1)[at[alien]]))
        size += len(met[-1][0])
        last = c + TILE >= len(y)
        if size <= full and not last:
            continue
        row, col, near = (np.concatenate(m) for m in zip((row, col, near), *met))
        order = np.lexsort((-near, row))
        row, col, near = row[order], col[order], near[order]
        sizes = np.bincount(row, minlength=len(p))
        least = np.cumsum(sizes) - sizes + np.minimum(sizes, take) - 1
        close = near >= near[least[row]] - kind(err)
        enough = sizes >= take
        bound[enough, 0] = np.maximum(bound[enough, 0], near[least[enough]] - kind(err))
        row, col, near = row[close], col[close], near[close]
        met, size = [], len(row)
        full = max(LOOSE * len(p), 2 * size)
        if size > CROWD * len(p) and kind is np.float32:
            return None
    return row, col


def _first(whose: np.ndarray, away: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each owner, owner by owner, ties to the smaller key."""
    order = np.lexsort((keys, away, whose))
    held = whose[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


def _windows(k: int, window: int):
    """Per window the k best of the window itself and of its two neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            held, size, curve = [], 0, None

            def cut(last: bool):
                nonlocal held, size
                if not size:
                    return
                ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                at = 0
                while len(ids) - at >= 2 * window or (last and at < len(ids)):
                    end = len(ids) if last and len(ids) - at < 2 * window else at + window
                    yield curve, (ids[at:end], x[at:end])
                    at = end
                held, size = ([(ids[at:], x[at:])], len(ids) - at) if at < len(ids) else ([], 0)

            for b in batches:
                if not b.num_rows:
                    continue
                kinds = b.column("curve").to_numpy()
                ids, x = b.column("row_index").to_numpy(), _matrix(b.column("unit"))
                for c in np.unique(kinds):
                    if curve is not None and c != curve:
                        yield from cut(True)
                    curve = c
                    held.append((ids[kinds == c], x[kinds == c]))
                    size += len(held[-1][0])
                    if size >= 4 * window:
                        yield from cut(False)
            yield from cut(True)

        before = here = None
        for after in blocks():
            if here is not None:
                yield from _meet(k, before, here, after)
            before, here = here, after
        if here is not None:
            yield from _meet(k, before, here, None)

    return run


def _meet(k: int, before, here, after) -> Iterator[pa.RecordBatch]:
    around = [q[1] for q in (here, before, after) if q is not None and q[0] == here[0]]
    found = best_of(*here[1], np.concatenate([o[0] for o in around]), np.concatenate([o[1] for o in around]), k)
    if found is not None:
        yield found


def _probed(ids: np.ndarray, x: np.ndarray, k: int):
    """Per task the k best partners of each probe among its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("row_index").to_numpy(), _matrix(b.column("unit"))))
            if sum(len(h[0]) for h in held) >= 1 << 15:
                if (found := best_of(ids, x, *merged(), k)) is not None:
                    yield found
                held = []
        if held and (found := best_of(ids, x, *merged(), k)) is not None:
            yield found

    return run


def _exact_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x, asks = table["row_index"].to_numpy(), _matrix(table["unit"].combine_chunks()), table["asks"].to_numpy(zero_copy_only=False)
        asks = asks.astype(bool)
        found = best_of(ids[asks], x[asks], ids[~asks], x[~asks], k) if (~asks).any() else None
        kind = pa.schema([("row_index", pa.int64()), ("near", pa.list_(pa.struct([("away", pa.float64()), ("other", pa.int64())])))])
        return pa.Table.from_batches([found]) if found is not None else kind.empty_table()

    return run


def _merged(near: DataFrame, k: int, spread_over: Column | None = None, again: bool = True) -> DataFrame:
    """The k best of all partners offered to each key; ``again``: a pair may be offered more than once and counts once."""
    offers = F.array_distinct("near") if again else F.col("near")
    keys = ["row_index"] if spread_over is None else ["row_index", spread_over.alias("_part")]
    return (
        near.groupBy(*keys)
        .agg(F.flatten(F.collect_list("near")).alias("near"))
        .select("row_index", F.slice(F.array_sort(offers), 1, k).alias("near"))
    )


def valid_vectors(df: DataFrame, key: str = "row_index", vector: str = "embedding") -> DataFrame:
    """One row per key and vector with the unit vector as 64 floats in binary; vectors that aren't 64 finite numbers, or are all zero, are left out.

    ``first`` is true for one row of each key, ``torn`` for all rows of a key
    that has more than one vector.
    """
    held = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("row_index"), F.col(vector).alias("v"))
    of_key = Window.partitionBy("row_index").orderBy("whole")
    before, after = F.lag(F.lit(True)).over(of_key), F.lead(F.lit(True)).over(of_key)
    return (
        held.mapInArrow(_units, "row_index bigint, unit binary, own double, whole binary")
        .repartition("row_index")
        .dropDuplicates(["row_index", "whole"])
        .select("row_index", "unit", "own", before.isNull().alias("first"), (before.isNotNull() | after.isNotNull()).alias("torn"))
    )


def _along_curves(spark: SparkSession, distinct: DataFrame, rows: int, curves: list, k: int, window: int) -> DataFrame:
    """(row_index, near) from the windows of some curves."""
    tasks = max(parallel_tasks(spark), len(curves) * (rows // TASK_ROWS))
    places = ["curve", *POSITIONS, "row_index"]
    return (
        distinct.mapInArrow(_keyed(curves), f"curve int, {', '.join(f'{p} bigint' for p in POSITIONS)}, row_index bigint, unit binary")
        .repartitionByRange(tasks, *places)
        .sortWithinPartitions(*places)
        .mapInArrow(_windows(k, window), NEAR)
    )


def _exact(spark: SparkSession, distinct: DataFrame, rows: int, k: int) -> DataFrame:
    """(row_index, near) by comparing every block of rows with every other, the exact way for tables that curves don't order well."""
    blocks = max(LEAST_BLOCKS if rows > STEP else 1, -(-rows // BLOCK))
    home = F.pmod(F.xxhash64("row_index", "unit"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows_of = distinct.withColumn("home", home)
    asking = rows_of.select(F.col("home").alias("one"), F.explode(every).alias("two"), F.lit(True).alias("asks"), "row_index", "unit")
    offered = rows_of.select(F.explode(every).alias("one"), F.col("home").alias("two"), F.lit(False).alias("asks"), "row_index", "unit")
    return asking.unionByName(offered).groupBy("one", "two").applyInArrow(_exact_block(k), NEAR)


def _recall(merged: DataFrame, true: dict[int, set[int]]) -> float:
    """Share of the true partners of the probes that were found."""
    found = merged.where(F.col("row_index").isin(list(true))).collect()
    hits = sum(len(true[r["row_index"]] & {n["other"] for n in r["near"]}) for r in found)
    return hits / max(sum(map(len, true.values())), 1)


def nearest_distinct(
    spark: SparkSession, scratch: Scratch, distinct: DataFrame, k: int, curves: int, most: int, window: int, target: float, seed: int
) -> DataFrame:
    """(row_index, near): the k best partners of every row of distinct vectors, by rounds of curves until the measured recall reaches ``target``.

    Without curves (``most`` 0) all rows are compared exactly.
    """
    if most < 1:
        return scratch.write(_merged(_exact(spark, distinct, distinct.count(), k), k, again=False), "exact")
    cells = {r["cell"]: r["value"] for r in distinct.mapInArrow(_moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    values = np.array([cells[c] for c in sorted(cells)]) if cells else np.zeros(1 + DIMENSIONS + DIMENSIONS**2)
    n, rows = max(values[0], 1), int(values[0])
    mean = values[1 : 1 + DIMENSIONS] / n
    cov = values[1 + DIMENSIONS :].reshape(DIMENSIONS, DIMENSIONS) / n - np.outer(mean, mean)
    probes = sorted(distinct.orderBy(F.xxhash64(F.lit(seed), "row_index"), "row_index").limit(PROBES).collect())
    true: dict[int, set[int]] = {}
    if probes:
        ids, x = np.array([p["row_index"] for p in probes]), np.stack([np.frombuffer(p["unit"], np.float32) for p in probes])
        best = distinct.mapInArrow(_probed(ids, x, k), NEAR)
        best = _merged(_merged(best, k, F.pmod(F.spark_partition_id(), F.lit(1024))), k)
        true = {r["row_index"]: {m["other"] for m in r["near"]} for r in best.collect()}
    merged, used = None, 0
    while used < most:
        found = _along_curves(spark, distinct, rows, list(_curves(curves, mean, cov, seed + 1009 * used)), k, window)
        used += curves
        merged = scratch.write(_merged(found if merged is None else found.unionByName(merged), k), f"merged{used}")
        if used > curves:
            scratch.drop(f"merged{used - curves}")
        if _recall(merged, true) >= target or not true:
            return merged
    return scratch.write(_merged(_exact(spark, distinct, rows, k), k, again=False), "exact")


def nearest(
    spark: SparkSession,
    df: DataFrame,
    key: str = "row_index",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    curves: int = CURVES,
    most: int = MOST,
    window: int = WINDOW,
    target: float = TARGET,
    seed: int = 11,
) -> DataFrame:
    """(row_index, other, cosine, rank): for every valid vector the k of greatest cosine, ties to the smaller key.

    Rows with equal vectors are searched once: a class of copies is stood for
    by its smallest key and its first k + 1 keys are put back afterwards, so a
    class of any size costs one search. Nulls, short, zero and non-finite
    vectors take no part; a row that repeats key and vector counts once; fewer
    than two valid keys give no pair; other columns are ignored.

    A key of several vectors offers all of them, and has the k closest of all,
    none of its own; another key then stands as often as its vectors are among
    them. Curves meet a pair more than once, so there two vectors of a key of the
    same cosine count once. Each of these vectors is searched, as none may
    meet another of its key.
    """
    scratch = Scratch(spark, "neighbours")
    copy_of = F.when(F.col("torn"), F.concat(F.lit("key:"), F.col("row_index"))).otherwise(
        F.concat_ws(":", F.xxhash64("unit"), F.xxhash64(F.lit(7), "unit"))
    )
    rows = scratch.write(valid_vectors(df, key, vector).withColumn("copy_of", copy_of), "rows")
    first = Window.partitionBy("copy_of").orderBy("row_index")
    heads = scratch.write(
        rows.where("first").select("row_index", "copy_of", "own").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1), "heads"
    )
    classes = heads.where("place > 1").select("copy_of").distinct().join(heads.where("place = 1").select("copy_of", F.col("row_index").alias("head")), "copy_of")
    # only rows of a class of copies meet their head; the others are their own
    distinct = scratch.write(
        lookup_join(rows, classes, "copy_of", "left").where("head is null or head = row_index").select("row_index", "unit"), "distinct"
    )
    merged = nearest_distinct(spark, scratch, distinct, k, curves, most, window, target, seed)
    members = heads.groupBy("copy_of").agg(
        F.min("row_index").alias("head"), F.min("own").alias("own"), F.array_sort(F.collect_list("row_index")).alias("members")
    )  # at most k + 1 keys each
    wide = members.where(F.size("members") > 1).select("head", "members")
    # a neighbouring class brings its first k keys, the own class its first k + 1
    reach = (
        merged.select("row_index", F.explode("near").alias("n"))
        .select("row_index", F.col("n.away").alias("away"), F.col("n.other").alias("head"))
        .where("away < 3")
        .join(wide, "head", "left")
        .select("row_index", "away", F.explode(F.coalesce("members", F.array("head"))).alias("other"))
        .groupBy("row_index")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("away", "other"))), 1, k).alias("around"))
    )
    lookup = members.join(reach, F.col("head") == F.col("row_index"), "left").select(
        "copy_of",
        F.concat(
            F.when(F.size("members") > 1, F.transform("members", lambda m: F.struct((-F.col("own")).alias("away"), m.alias("other"))))
            .otherwise(F.array().cast("array<struct<away:double,other:bigint>>")),
            F.coalesce("around", F.array().cast("array<struct<away:double,other:bigint>>")),
        ).alias("offers"),
    )
    offered = lookup_join(rows.where("first").select("row_index", "copy_of"), lookup, "copy_of")
    return offered.select(
        "row_index",
        F.posexplode(
            F.slice(F.filter(F.array_sort("offers"), lambda o: o["other"] != F.col("row_index")), 1, k)
        ).alias("place", "o"),
    ).select("row_index", F.col("o.other").alias("other"), (-F.col("o.away")).alias("cosine"), (F.col("place") + 1).alias("rank"))


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five closest other rows of every valid vector, all compared: what curves miss is missing from the result."""
    found = nearest(spark, load(spark, root, "semantic_embedding_rows"), most=0)
    return found.withColumn("cosine", F.round("cosine", 6))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs in which at least one row is among the five closest of the other, smaller key first."""
    return (
        p4_neighbours(spark, root)
        .select(F.least("row_index", "other").alias("row_index_a"), F.greatest("row_index", "other").alias("row_index_b"))
        .distinct()
    )


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
_NEAREST = """
    WITH v AS (SELECT DISTINCT row_index, CAST(embedding AS DOUBLE[]) AS x FROM semantic_embedding_rows WHERE row_index IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
    u AS (SELECT row_index, CAST(list_transform(x, lambda e: CAST(e / n AS FLOAT)) AS DOUBLE[]) AS x FROM (SELECT row_index, x, sqrt(list_inner_product(x, x)) AS n FROM v)),
    c AS (SELECT a.row_index AS row_index, b.row_index AS other, list_inner_product(a.x, b.x) AS cosine FROM u a JOIN u b ON a.row_index <> b.row_index),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_index ORDER BY round(cosine, 13) DESC, other) AS INTEGER) AS rank FROM c)
"""
ORACLES = {
    "p4_neighbours": _NEAREST + "SELECT row_index, other, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 5",
    "p4_found": _NEAREST + "SELECT DISTINCT least(row_index, other) AS row_index_a, greatest(row_index, other) AS row_index_b FROM r WHERE rank <= 5",
}
