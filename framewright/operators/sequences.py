"""Metrics of frame sequences, placement and codec kernels; frames are binary RGBA, one vectorized pass per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.kernels import premultiplied

_SINGLE = "seq string, place int, n_visible int, n_translucent int, n_crisp int, palette array<bigint>, digest string, centre_x double, centre_y double, box_w int, box_h int, rgba_l1 double, alpha_l1 double, palette_away double"


def stacked(values: pd.Series, side: int) -> np.ndarray:
    """[n, side, side, 4] of whole frames."""
    return np.frombuffer(b"".join(bytes(v) for v in values), np.uint8).reshape(-1, side, side, 4)


def placed(x: np.ndarray, left: int, top: int, scale: float, target: int, anchor: tuple[int, int]) -> tuple[np.ndarray, int]:
    """Frames scaled by nearest neighbours and set on a square canvas, and how many visible pixels fell outside it.

    Sizes and places are rounded half away from zero.
    """
    away = lambda v: int(np.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))
    n, height, width = x.shape[:3]
    at_x = np.minimum((np.arange(max(1, away(width * scale))) / scale).astype(int), width - 1)
    at_y = np.minimum((np.arange(max(1, away(height * scale))) / scale).astype(int), height - 1)
    big = x[:, at_y][:, :, at_x]
    x0, y0 = anchor[0] + away(left * scale), anchor[1] + away(top * scale)
    out = np.zeros((n, target, target, 4), np.uint8)
    xs, ys = np.arange(big.shape[2]) + x0, np.arange(big.shape[1]) + y0
    fit_x, fit_y = (xs >= 0) & (xs < target), (ys >= 0) & (ys < target)
    out[:, ys[fit_y][:, None], xs[fit_x][None, :]] = big[:, fit_y][:, :, fit_x]
    return out, int((big[..., 3] > 0).sum() - (out[..., 3] > 0).sum())


def union_box(x: np.ndarray) -> tuple[int, int, int, int] | None:
    """(left, top, right, bottom) of the pixels that any frame shows, right and bottom exclusive; None where none does."""
    seen = (x[..., 3] > 0).any(0)
    if not seen.any():
        return None
    ys, xs = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0))
    return int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1


def aligned(x: np.ndarray, target: int) -> np.ndarray:
    """Frames cut to their common box, enlarged by the greatest whole factor that fits, centred with their feet on the lower edge."""
    out = np.zeros((len(x), target, target, 4), np.uint8)
    box = union_box(x)
    if box is None:
        return out
    cut = x[:, box[1] : box[3], box[0] : box[2]]
    factor = min(target // cut.shape[2], target // cut.shape[1])
    if factor < 1:
        raise ValueError("the frames do not fit the canvas")
    big = cut.repeat(factor, 1).repeat(factor, 2)
    left = (target - big.shape[2]) // 2
    out[:, target - big.shape[1] :, left : left + big.shape[2]] = big
    return out


def hard_alpha(x: np.ndarray, threshold: int = 128) -> np.ndarray:
    """Alpha cut to 0 or 255 at a threshold; what becomes invisible loses its colour."""
    out = x.copy()
    out[..., 3] = np.where(x[..., 3] >= threshold, 255, 0)
    out[out[..., 3] == 0] = 0
    return out


def codec_metrics(target: np.ndarray, predicted: np.ndarray) -> dict[str, np.ndarray]:
    """Per frame: overlap of the masks at half alpha, alpha and premultiplied errors, and the error of visible colours."""
    t, p = target / 255.0, predicted / 255.0
    a, b = t[..., 3], p[..., 3]
    both, either = ((a >= 0.5) & (b >= 0.5)).sum((1, 2)), ((a >= 0.5) | (b >= 0.5)).sum((1, 2))
    tm, pm = t.copy(), p.copy()
    tm[..., :3] *= t[..., 3:]
    pm[..., :3] *= p[..., 3:]
    seen = a > 0
    colour = (np.abs(t[..., :3] - p[..., :3]).mean(-1) * seen).sum((1, 2)) / np.maximum(seen.sum((1, 2)), 1)
    return {
        "alpha_iou": both / np.maximum(either, 1), "alpha_mae": np.abs(a - b).mean((1, 2)),
        "premultiplied_mae": np.abs(tm - pm).mean((1, 2, 3)), "visible_rgb_mae": colour,
    }


def _frame_facts(side: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        grid = np.arange(side, dtype=np.float64)
        for b in batches:
            x = stacked(b["pixels"], side)
            before = [v is not None for v in b["before"]]
            y = x.copy()
            if any(before):
                y[before] = stacked(b["before"][before], side)
            a = x[..., 3]
            seen = a > 0
            code = (x.astype(np.int64) * [1 << 24, 1 << 16, 1 << 8, 1]).sum(-1)
            palettes = [np.unique(c[s]) for c, s in zip(code, seen)]
            earlier = (y.astype(np.int64) * [1 << 24, 1 << 16, 1 << 8, 1]).sum(-1)
            old = [np.unique(c[s]) for c, s in zip(earlier, y[..., 3] > 0)]
            shares = [1 - len(np.intersect1d(p, q)) / n if (n := len(np.union1d(p, q))) else 0.0 for p, q in zip(palettes, old)]
            weight = a.astype(np.float64)
            mass = weight.sum((1, 2))
            safe = np.where(mass > 0, mass, 1)
            centre = lambda axis: np.where(mass > 0, (weight.sum(axis) * grid).sum(1) / safe, np.nan)
            extent = lambda s: np.where(s.any(1), side - s[:, ::-1].argmax(1) - s.argmax(1), 0)
            none = ~np.array(before, bool)
            l1 = lambda u, v: np.where(none, np.nan, np.abs(u - v).reshape(len(x), -1).mean(1) / 255)
            yield pd.DataFrame({
                "seq": b["seq"], "place": b["place"], "n_visible": seen.sum((1, 2)), "n_translucent": (seen & (a < 255)).sum((1, 2)),
                "n_crisp": ((a == 0) | (a == 255)).sum((1, 2)), "palette": [p.tolist() for p in palettes],
                "digest": [hashlib.sha256(f.tobytes()).hexdigest() for f in x], "centre_x": centre(1), "centre_y": centre(2),
                "box_w": extent(seen.any(1)), "box_h": extent(seen.any(2)),
                "rgba_l1": l1(premultiplied(x), premultiplied(y)), "alpha_l1": l1(weight, y[..., 3].astype(np.float64)), "palette_away": np.where(none, np.nan, shares),
            })

    return run


def sequence_metrics(df: DataFrame, seq: str, order: str, pixels: str, side: int = 8) -> DataFrame:
    """Metrics of every sequence of whole frames, in order; a sequence of one frame has no change, distances are shares of the full range.

    Frames meet the one before them in their sequence and are reduced to facts
    before they are grouped; colours are counted over exploded palettes. Nulls
    and frames of another size are left out.
    """
    size = side * side * 4
    rows = df.where((F.octet_length(pixels) == size) & F.col(seq).isNotNull()).select(F.col(seq).alias("seq"), F.col(order).alias("o"), F.col(pixels).alias("pixels"))
    along = Window.partitionBy("seq").orderBy("o")
    placed_rows = rows.select("seq", F.row_number().over(along).alias("place"), "pixels", F.lag("pixels").over(along).alias("before"))
    facts = placed_rows.mapInPandas(_frame_facts(side), _SINGLE)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    colours = facts.select("seq", F.explode("palette").alias("c")).distinct().groupBy("seq").agg(F.count("*").alias("union_palette_size"))
    n = F.count("*") * F.lit(side * side)
    boxed = lambda c: F.when(F.col("n_visible") > 0, F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return facts.groupBy("seq").agg(
        F.count("*").alias("frame_count"), (F.sum("n_visible") / n).alias("visible_fraction"),
        zero(F.try_divide(F.sum("n_translucent"), F.sum("n_visible"))).alias("translucent_fraction"), (F.sum("n_crisp") / n).alias("crisp_fraction"),
        F.avg(F.size("palette")).alias("mean_palette_size"), zero(F.avg(known("palette_away"))).alias("palette_distance"),
        (F.count_distinct("digest") / F.count("*")).alias("unique_ratio"), zero(F.avg(known("rgba_l1"))).alias("temporal_rgba_l1"),
        zero(F.avg(known("alpha_l1"))).alias("temporal_alpha_l1"), zero(F.avg((known("rgba_l1") > 0).cast("double"))).alias("dynamic_fraction"),
        zero(F.sqrt(F.var_pop(known("centre_x")) + F.var_pop(known("centre_y")))).alias("centroid_jitter"),
        zero(F.sqrt(F.var_pop(boxed("box_w")) + F.var_pop(boxed("box_h")))).alias("box_jitter"),
    ).join(colours, "seq", "left").withColumn("union_palette_size", F.coalesce("union_palette_size", F.lit(0).cast("bigint")))


def decoded_metrics(df: DataFrame, key: str, pixels: str, side: int = 8, threshold: int = 128) -> DataFrame:
    """Per frame the codec metrics of its hard-alpha decoding against itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = stacked(b["pixels"], side)
            yield pd.DataFrame({"frame_id": b["frame_id"]} | codec_metrics(x, hard_alpha(x, threshold)))

    whole = df.where(F.octet_length(pixels) == side * side * 4).select(F.col(key).alias("frame_id"), F.col(pixels).alias("pixels"))
    return whole.mapInPandas(run, "frame_id string, alpha_iou double, alpha_mae double, premultiplied_mae double, visible_rgb_mae double")


def placed_frames(df: DataFrame, key: str, pixels: str, left: int, top: int, scale: float, target: int, anchor: tuple[int, int], side: int = 8) -> DataFrame:
    """(frame_id, n_kept, n_clipped): visible pixels of each frame on its canvas, and those that fell outside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [placed(f[None], left, top, scale, target, anchor) for f in stacked(b["pixels"], side)]
            yield pd.DataFrame({"frame_id": b["frame_id"], "n_kept": [int((o[..., 3] > 0).sum()) for o, _ in found], "n_clipped": [c for _, c in found]})

    whole = df.where(F.octet_length(pixels) == side * side * 4).select(F.col(key).alias("frame_id"), F.col(pixels).alias("pixels"))
    return whole.mapInPandas(run, "frame_id string, n_kept int, n_clipped int")


def verified_rows(df: DataFrame, key: str, pixels: str, digest: str) -> DataFrame:
    """(key, state): whether a row's bytes have the digest it names: verified, differs, unnamed or absent."""
    state = F.when(F.col(pixels).isNull(), "absent").when(F.col(digest).isNull(), "unnamed").when(F.sha2(pixels, 256) == F.col(digest), "verified").otherwise("differs")
    return df.select(key, state.alias("state"))
