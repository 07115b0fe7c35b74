"""The lossy transform scheme: cosine blocks of halves, a run-length plane for alpha, and rules that say which is which.

A chunk is a header of eleven 64-bit numbers, rules by channel name (version 2),
coefficients but for the first of each block (AC), first coefficients (DC), and
run-length planes.  Blocks are cut out of the AC stream one after the other, as
their lengths differ; what follows is done for all blocks at once.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from scanweave.operators.codecs import LEGACY_RULES, zigzag
from scanweave.sources.halves import INFINITE, half_bits
from scanweave.sources.piz import unhuffed

UINT, HALF, FLOAT = 0, 1, 2
# Fixed values of the format: schemes of channels, modes of the AC stream, marks in it, and the base of the scale beyond 1.
LOSSY, RUNS = 1, 2
HUFFMAN, DEFLATE = 0, 1
END_OF_BLOCK, SKIP = 0xFF00, 0xFF
BASE = 2.7182818**2.2

#: basis[u, x]: the weight of coefficient u at place x.
BASIS = np.array([[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
#: Place in the block of each coefficient as the stream has them.
ZIGZAG = np.array(zigzag())


def rules_of_version_1() -> list[tuple[str, int, int, int, bool]]:
    """(suffix, scheme, place in the colour triple or -1, pixel type, case aside?)."""
    kinds = {"lossy": (HALF, FLOAT), "rle": (UINT, HALF, FLOAT)}
    return [(name, LOSSY if scheme == "lossy" else RUNS, csc, kind, True) for name, scheme, csc in LEGACY_RULES for kind in kinds[scheme]]


def parsed_rules(payload: bytes, at: int) -> tuple[list[tuple[str, int, int, int, bool]], int]:
    """The rules that a chunk brings, and where they end."""
    (size,) = struct.unpack_from("<H", payload, at)
    end, at = at + size, at + 2
    if size < 2 or end > len(payload):
        raise ValueError("the rules are cut short")
    out = []
    while at < end:
        stop = payload.find(b"\0", at, end)
        if stop < 0 or stop + 3 > end:
            raise ValueError("a rule is cut short")
        flags, kind = payload[stop + 1], payload[stop + 2]
        out.append((payload[at:stop].decode("latin-1"), flags >> 2 & 3, (flags >> 4) - 1, kind, bool(flags & 1)))
        at = stop + 3
    return out, end


def matched(names: list[str], kinds: list[int], rules: list[tuple[str, int, int, int, bool]]) -> tuple[list[int], dict[int, int]]:
    """The scheme of each channel, by the first rule for its suffix and type (0: none), and the channels of the colour triple."""
    schemes, triple = [], {}
    for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        suffix = name.rpartition(".")[2]
        hit = next((r for r in rules if r[3] == kind and (r[0].lower() == suffix.lower() if r[4] else r[0] == suffix)), None)
        schemes.append(hit[1] if hit else 0)
        if hit and hit[2] >= 0:
            triple[hit[2]] = i
    return schemes, triple


def coefficients(ac: np.ndarray, at: int, dc: np.ndarray) -> tuple[np.ndarray, int]:
    """Half bits of blocks in stream order, a row of 64 each, whose first ones are dc; and where the AC stream goes on."""
    ends = np.flatnonzero(ac == END_OF_BLOCK)
    skips = (ac >> 8) == SKIP
    step = np.where(skips, ac & 0xFF, 1).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(step)])
    starts = np.empty(len(dc) + 1, np.int64)
    starts[0] = at
    for i in range(len(dc)):
        # a block is over at its mark, or once 63 coefficients are told
        mark = np.searchsorted(ends, at)
        stop = int(ends[mark]) + 1 if mark < len(ends) else len(ac) + 1
        full = int(np.searchsorted(total, total[at] + 63))
        at = min(stop, full)
        if at > len(ac) or total[at] < total[starts[i]] + 63 and stop != at:
            raise ValueError("coefficients are cut short")
        starts[i + 1] = at
    words = np.arange(starts[0], at)
    block = np.repeat(np.arange(len(dc)), np.diff(starts))
    place = 1 + total[words] - total[starts[block]]
    told = ~skips[words]
    out = np.zeros((len(dc), 64), np.uint16)
    out[:, 0] = dc
    out[block[told], place[told]] = ac[words[told]]
    return out, at


def linear(v: np.ndarray) -> np.ndarray:
    a = np.abs(v)
    return np.copysign(np.where(a <= 1, a**2.2, BASE ** (np.maximum(a, 1) - 1)), v)


def samples(blocks: np.ndarray) -> np.ndarray:
    """Values of blocks of coefficients (half bits in stream order), 8 x 8 each."""
    x = np.zeros((len(blocks), 64))
    x[:, ZIGZAG] = blocks.view(np.float16)
    return BASIS.T @ x.reshape(-1, 8, 8) @ BASIS


def laid_out(blocks: np.ndarray, rows: int, width: int, compat: bool = False) -> np.ndarray:
    """Blocks as a plane of halves, without what lies beyond its edges."""
    down, across = -(-rows // 8), -(-width // 8)
    plane = blocks.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)[:rows, :width]
    # the compat rounding has no NaN here
    return half_bits(linear(plane), compat, INFINITE).view("<f2")


def _section(payload: bytes, at: int, size: int) -> bytes:
    if size < 0 or at + size > len(payload):
        raise ValueError("a section is cut short")
    return payload[at : at + size]


def planes_of(payload: bytes, names: list[str], kinds: list[int], rows: int, width: int, unpredicted, run_lengths, compat: bool = False) -> list[np.ndarray]:
    """The samples of each channel, rows x width, as bytes of their type."""
    version, plain, plain_coded, ac_size, dc_size, rle_size, rle_runs, rle_raw, n_ac, n_dc, mode = struct.unpack_from("<11q", payload)
    at = 88
    if version not in (1, 2):
        raise ValueError(f"version {version}")
    if plain or plain_coded:
        raise ValueError("channels of unknown scheme")
    rules, at = parsed_rules(payload, at) if version == 2 else (rules_of_version_1(), at)
    schemes, triple = matched(names, kinds, rules)
    for name, kind, scheme in zip(names, kinds, schemes, strict=True):
        if scheme not in (LOSSY, RUNS) or scheme == LOSSY and kind not in (HALF, FLOAT):
            raise ValueError(f"no scheme for channel {name}")
    ac = dc = np.zeros(0, np.uint16)
    if ac_size:
        raw = _section(payload, at, ac_size)
        if mode not in (HUFFMAN, DEFLATE):
            raise ValueError(f"AC mode {mode}")
        ac = unhuffed(raw, n_ac) if mode == HUFFMAN else np.frombuffer(zlib.decompress(raw), "<u2")
        at += ac_size
    if len(ac) != n_ac:
        raise ValueError(f"{len(ac)} AC coefficients instead of {n_ac}")
    if dc_size:
        dc = np.frombuffer(unpredicted(np.frombuffer(zlib.decompress(_section(payload, at, dc_size)), np.uint8)), "<u2")
        at += dc_size
    if len(dc) != n_dc:
        raise ValueError(f"{len(dc)} DC coefficients instead of {n_dc}")
    runs = b""
    if rle_raw:
        coded = zlib.decompress(_section(payload, at, rle_size))
        if len(coded) != rle_runs:
            raise ValueError(f"{len(coded)} bytes of runs instead of {rle_runs}")
        runs = run_lengths(coded, rle_raw)
    elif rle_size or rle_runs:
        raise ValueError("runs without bytes")

    per = -(-rows // 8) * -(-width // 8)
    out: list[np.ndarray | None] = [None] * len(names)
    ac_at = dc_at = 0

    def lossy(members: list[int]) -> list[np.ndarray]:
        """The next channels: AC coefficients block by block, of each block all members; DC coefficients member by member."""
        nonlocal ac_at, dc_at
        n = len(members)
        own = dc[dc_at : dc_at + n * per]
        if len(own) < n * per:
            raise ValueError("DC coefficients are cut short")
        blocks, ac_at = coefficients(ac, ac_at, own.reshape(n, per).T.ravel())
        dc_at += n * per
        values = samples(blocks).reshape(per, n, 8, 8)
        return [values[:, i] for i in range(n)]

    def put(i: int, values: np.ndarray) -> None:
        half = laid_out(values, rows, width, compat)
        out[i] = half if kinds[i] == HALF else half.astype("<f4")

    if {0, 1, 2} <= set(triple):
        y, cb, cr = lossy([triple[0], triple[1], triple[2]])
        for i, v in enumerate((y + 1.5747 * cr, y - 0.1873 * cb - 0.4682 * cr, y + 1.8556 * cb)):
            put(triple[i], v)
    rle_at = 0
    for i, (kind, scheme) in enumerate(zip(kinds, schemes, strict=True)):
        if out[i] is not None:
            continue
        if scheme == LOSSY:
            put(i, lossy([i])[0])
            continue
        size = 2 if kind == HALF else 4
        n = rows * width
        if rle_at + n * size > len(runs):
            raise ValueError("runs are cut short")
        out[i] = np.ascontiguousarray(np.frombuffer(runs, np.uint8, n * size, rle_at).reshape(size, n).T).view("<u2" if kind == HALF else "<u4").reshape(rows, width)
        rle_at += n * size
    return out
