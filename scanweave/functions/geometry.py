"""Sampling geometry of image channels, as column expressions (one definition for all operators).

A channel is sampled every ``s`` pixels on a grid through 0; s of 0 or less
counts as 1.  Windows have inclusive bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sampling(s: Column) -> Column:
    return F.when(s <= 0, F.lit(1)).otherwise(s)


def extent(lo: Column, hi: Column) -> Column:
    """Number of pixels of a window in one direction."""
    return hi - lo + 1


def first_sample(lo: Column, s: Column) -> Column:
    """The least multiple of s that is not below lo."""
    return lo + F.pmod(-lo, sampling(s))


def sample_count(lo: Column, hi: Column, s: Column) -> Column:
    first = first_sample(lo, s)
    return F.when(hi < first, F.lit(0)).otherwise(F.floor((hi - first) / sampling(s)) + 1).cast("int")


def is_sampled(at: Column, lo: Column, s: Column) -> Column:
    first = first_sample(lo, s)
    return (at >= first) & (F.pmod(at - first, sampling(s)) == 0)


def sampled_row(at: Column, origin: Column, s: Column) -> Column:
    return F.floor((at - origin) / sampling(s)).cast("int")


def bytes_per_sample(pixel_type: Column) -> Column:
    """HALF takes 2 bytes; UINT, FLOAT and unknown kinds take 4."""
    return F.when(pixel_type == 1, 2).otherwise(4)


def chunk_count(height: Column, lines: Column) -> Column:
    return F.ceil(height / lines).cast("int")


def lines_in_chunk(chunk_y: Column, hi: Column, lines: Column) -> Column:
    return F.greatest(F.lit(0), F.least(lines, hi - chunk_y + 1))


def nearest_sample(world: Column, origin: Column, s: Column, n: Column) -> Column:
    """The sample nearest to a place; halves go up, and the ends are clamped."""
    return F.least(F.greatest(F.floor((world - origin) / sampling(s) + 0.5), F.lit(0)), n - 1).cast("int")
