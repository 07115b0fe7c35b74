"""Histogram and tone mapping of decoded lines, which stay arrays: no row is made for a pixel.

Lines come from exr.colour_lines: a row a line, with arrays r, g, b and a (null: not there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.pixels import LUMINANCE

#: Images whose counts a task holds at once.
HELD = 4096


def _channels(batch: pa.RecordBatch, first: int, n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(samples of each line, values of n channels as doubles, whether each value is there), end to end over the lines of a batch."""
    cols = [batch.column(first + i) for i in range(n)]
    sizes = [np.asarray(c.value_lengths().fill_null(0)) for c in cols]
    lengths = np.max(sizes, axis=0) if n else np.zeros(0, np.int64)
    values, there = [], []
    for c, own in zip(cols, sizes, strict=True):
        has = np.repeat(own == lengths, lengths) & np.repeat(own > 0, lengths)
        out = np.zeros(int(lengths.sum()))
        whole = own == lengths
        flat = c.flatten().to_numpy(zero_copy_only=False)
        out[has] = flat if whole.all() else flat[np.repeat(whole, own)]
        values.append(out)
        there.append(has)
    return lengths, values, there


def displayed(v: np.ndarray, exposure: float = 0.0, gamma: float = 2.2) -> np.ndarray:
    """v * 2**exposure, not below 0, to the power 1 / gamma; a gamma of 0 or less counts as 1."""
    if exposure:
        v = v * 2.0**exposure
    v = np.where(v < 0, 0.0, v)
    return v if gamma <= 0 or gamma == 1 else v ** (1.0 / gamma)


def _whole(v: np.ndarray) -> np.ndarray:
    """The whole part; NaN is 0."""
    return np.where(np.isnan(v), 0, np.clip(v, -(2**31), 2**31 - 1)).astype(np.int64)


def bins_of(lum: np.ndarray, bins: int) -> np.ndarray:
    """Bins of luminances; below 0 for those below the first bin."""
    return np.where(lum >= 1, bins - 1, _whole(lum * bins))


def to_bytes(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 1, 255, _whole(v * 255)).astype(np.uint8)


def alpha_bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(_whole(a * 255), 0, 255).astype(np.uint8)


def histogram(lines: DataFrame, mode: str = "display", exposure: float = 0.0, gamma: float = 2.2, bins: int = 64) -> DataFrame:
    """(path, part_id, bin, n) of every bin: the luminances of each part, 'display' after exposure and gamma, 'linear' as they are.

    Each task counts the lines that it has, image by image; what is shuffled is
    a row for each task, image and bin.
    """
    if mode not in ("display", "linear"):
        raise ValueError(f"no such mode: {mode}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            paths, parts = zip(*held, strict=True) if held else ((), ())
            cols = [pa.array(paths, pa.string()), pa.array(parts, pa.int32()), pa.array([c.tolist() for c in held.values()], pa.list_(pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["path", "part_id", "counts"])

        for batch in batches:
            lengths, rgb, _ = _channels(batch, 2, 3)
            if mode == "display":
                rgb = [displayed(c, exposure, gamma) for c in rgb]
            at = bins_of(sum(c * w for c, w in zip(rgb, LUMINANCE, strict=True)), bins)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            image = np.repeat(np.array([number[k] for k in keys], np.int64), lengths)
            inside = at >= 0
            counts = np.bincount(image[inside] * bins + at[inside], minlength=len(number) * bins).reshape(-1, bins)
            for k, i in number.items():
                held[k] = held[k] + counts[i] if k in held else counts[i]
            if len(held) > HELD:
                yield out()
        yield out()

    parts = lines.select("path", "part_id", "r", "g", "b").mapInArrow(count, "path string, part_id int, counts array<long>")
    return parts.select("path", "part_id", F.posexplode("counts").alias("bin", "n")).groupBy("path", "part_id", "bin").agg(F.sum("n").alias("n"))


def tone_mapped(lines: DataFrame, exposure: float = 0.0, gamma: float = 2.2) -> DataFrame:
    """(path, part_id, y, rgba): four bytes for each pixel of a line; a missing colour is black, a missing alpha opaque."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values, there = _channels(batch, 3, 4)
            rgba = np.stack([*(to_bytes(displayed(c, exposure, gamma)) for c in values[:3]), np.where(there[3], alpha_bytes(values[3]), 255).astype(np.uint8)], 1)
            ends = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
            painted = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rgba.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], painted], names=["path", "part_id", "y", "rgba"])

    return lines.select("path", "part_id", "y", "r", "g", "b", "a").mapInArrow(paint, "path string, part_id int, y int, rgba binary")
