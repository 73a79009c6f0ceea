"""Pixel kernels over binary RGBA frames, one vectorized pass per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "frame_id string, n_visible int, left int, top int, right int, bottom int, n_border int, n_colours int, mean_alpha double, "
    "n_sentinel int, centre_x double, centre_y double"
)
COMPARISON = (
    "frame_id string, reference_id string, mae double, alpha_mae double, alpha_iou double, alpha_precision double, alpha_recall double, "
    "centre_shift double, histogram_overlap double"
)
# Fixed value: the colour that marks transparency in old sheets.
SENTINEL = (255, 0, 255)


def _frames(values: pd.Series, side: int) -> tuple[np.ndarray, np.ndarray]:
    size = side * side * 4
    at = np.array([i for i, v in enumerate(values) if v is not None and len(v) == size], int)
    x = np.frombuffer(b"".join(values.iloc[i] for i in at), np.uint8).reshape(-1, side, side, 4)
    return at, x


def premultiplied(x: np.ndarray) -> np.ndarray:
    v = x.astype(np.float64)
    v[..., :3] *= v[..., 3:] / 255
    return v


def statistics(x: np.ndarray) -> dict[str, np.ndarray]:
    """Per frame: visible pixels, their box (empty: all -1), those on the border, colours, mean alpha, sentinel pixels, centre of alpha."""
    n, side = x.shape[0], x.shape[1]
    seen = x[..., 3] > 0
    count = seen.sum((1, 2))
    none = count == 0
    by_x, by_y = seen.any(1), seen.any(2)
    edge = np.zeros((side, side), bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    code = (x[..., :3].astype(np.int64) * [65536, 256, 1]).sum(-1)
    code[~seen] = -1
    flat = np.sort(code.reshape(n, -1), axis=1)
    colours = ((flat[:, 1:] != flat[:, :-1]) & (flat[:, 1:] >= 0)).sum(1) + (flat[:, 0] >= 0)
    weight = x[..., 3].astype(np.float64)
    mass = np.where(weight.sum((1, 2)) > 0, weight.sum((1, 2)), 1)
    grid = np.arange(side) + 0.5
    return {
        "n_visible": count,
        "left": np.where(none, -1, by_x.argmax(1)),
        "top": np.where(none, -1, by_y.argmax(1)),
        "right": np.where(none, -1, side - 1 - by_x[:, ::-1].argmax(1)),
        "bottom": np.where(none, -1, side - 1 - by_y[:, ::-1].argmax(1)),
        "n_border": (seen & edge).sum((1, 2)),
        "n_colours": colours,
        "mean_alpha": weight.mean((1, 2)),
        "n_sentinel": (seen & (x[..., :3] == SENTINEL).all(-1)).sum((1, 2)),
        "centre_x": (weight.sum(1) * grid).sum(1) / mass,
        "centre_y": (weight.sum(2) * grid).sum(1) / mass,
    }


def frame_statistics(df: DataFrame, key: str, pixels: str, side: int = 8) -> DataFrame:
    """Statistics of every whole frame; nulls and frames of another size are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = _frames(b["pixels"], side)
            yield pd.DataFrame({"frame_id": b["frame_id"].to_numpy()[at]} | statistics(x))

    return df.select(F.col(key).alias("frame_id"), F.col(pixels).alias("pixels")).mapInPandas(run, STATISTICS)


def compared(p: np.ndarray, r: np.ndarray, threshold: int = 127) -> dict[str, np.ndarray]:
    """Prediction against reference. Two empty masks agree fully; one empty mask has overlap 0."""
    a, b = p[..., 3] > threshold, r[..., 3] > threshold
    both, either = (a & b).sum((1, 2)), (a | b).sum((1, 2))
    na, nb = a.sum((1, 2)), b.sum((1, 2))
    empty = either == 0
    share = lambda top, bottom: np.where(empty, 1.0, np.where(bottom > 0, top / np.maximum(bottom, 1), 0.0))
    x, y = premultiplied(p), premultiplied(r)
    sp, sr = statistics(p), statistics(r)
    shift = np.hypot(sp["centre_x"] - sr["centre_x"], sp["centre_y"] - sr["centre_y"])
    shift = np.where((sp["n_visible"] > 0) & (sr["n_visible"] > 0), shift, 0.0)
    n = len(p)

    def histogram(f: np.ndarray) -> np.ndarray:
        bins = ((f[..., 0] >> 4).astype(np.int64) << 8) | ((f[..., 1] >> 4).astype(np.int64) << 4) | (f[..., 2] >> 4)
        bins = np.where(f[..., 3] > 0, bins, 4096).reshape(n, -1)
        h = np.zeros((n, 4097))
        np.add.at(h, (np.repeat(np.arange(n), bins.shape[1]), bins.ravel()), 1)
        h = h[:, :4096]
        return h / np.maximum(h.sum(1, keepdims=True), 1)

    return {
        "mae": np.abs(x - y).mean((1, 2, 3)) / 255,
        "alpha_mae": np.abs(x[..., 3] - y[..., 3]).mean((1, 2)) / 255,
        "alpha_iou": share(both, either), "alpha_precision": share(both, na), "alpha_recall": share(both, nb),
        "centre_shift": shift,
        "histogram_overlap": np.where(empty, 1.0, np.minimum(histogram(p), histogram(r)).sum(1)),
    }


def compare_frames(df: DataFrame, key: str, pixels: str, reference_key: str, reference: str, side: int = 8) -> DataFrame:
    """Metrics of each frame against its reference in the same row; rows lacking either whole frame are left out."""
    size = side * side * 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, p = _frames(b["pixels"], side)
            _, r = _frames(b["reference"], side)
            yield pd.DataFrame({"frame_id": b["frame_id"], "reference_id": b["reference_id"]} | compared(p, r))

    whole = df.where((F.octet_length(pixels) == size) & (F.octet_length(reference) == size))
    return whole.select(
        F.col(key).alias("frame_id"), F.col(pixels).alias("pixels"), F.col(reference_key).alias("reference_id"), F.col(reference).alias("reference")
    ).mapInPandas(run, COMPARISON)


def resized(x: np.ndarray, side: int) -> np.ndarray:
    """Nearest-neighbour resize by floor indices."""
    at = np.arange(side) * x.shape[1] // side
    return x[:, at][:, :, at]


def composited(x: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """RGB over a constant background, rounded half up."""
    a = x[..., 3:].astype(np.float64) / 255
    return np.floor(x[..., :3] * a + np.array(background) * (1 - a) + 0.5).astype(np.uint8)


def medoid(frames: np.ndarray) -> int:
    """Index of the frame with the least total difference to all others, ties to the first."""
    v = premultiplied(frames).reshape(len(frames), -1)
    return int(np.argmin([np.abs(v - row).sum() for row in v]))


def keyed_out(x: np.ndarray, colour: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Frames with an exact colour made transparent, and how many pixels that changed per frame."""
    hit = (x[..., :3] == colour).all(-1) & (x[..., 3] > 0)
    out = x.copy()
    out[hit] = 0
    return out, hit.sum((1, 2))


def largest_parts(mask: np.ndarray, least: int) -> np.ndarray:
    """A mask without its 4-connected parts of fewer than ``least`` pixels."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        grown = label.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(label, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = 0
                grown = np.maximum(grown, moved)
        grown[~mask] = 0
        if (grown == label).all():
            break
        label = grown
    sizes = np.bincount(label.ravel(), minlength=mask.size + 1)
    return mask & (sizes[label] >= least)


def premultiplied_model_range(x: np.ndarray) -> np.ndarray:
    """uint8 [n, h, w, 4] to float [n, 4, h, w] in [-1, 1], premultiplied."""
    return np.moveaxis(premultiplied(x) / 127.5 - 1, -1, 1)


def from_model_range(v: np.ndarray) -> np.ndarray:
    """The inverse of ``premultiplied_model_range``, clipped and rounded."""
    p = (np.moveaxis(v, 1, -1) + 1) * 127.5
    a = np.clip(p[..., 3:], 0, 255)
    rgb = np.where(a > 0, p[..., :3] * 255 / np.where(a > 0, a, 1), 0)
    return np.floor(np.clip(np.concatenate([rgb, a], -1), 0, 255) + 0.5).astype(np.uint8)
