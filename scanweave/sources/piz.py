"""The wavelet scheme: 16-bit words through a value table, a wavelet and Huffman codes.

A chunk is the range of a bitmap of the values that occur, the bitmap, the
number of coded bytes, and the codes.  Words are decoded, the wavelet is undone
plane by plane, and each word is the number of a value that occurs.
"""

from __future__ import annotations

import struct

import numpy as np

WORDS = 1 << 16
SYMBOLS = WORDS + 1
# Fixed values of the format's table of code lengths: a length from SHORT_RUN on stands for 2 or more symbols
# without a code, LONG_RUN for 8 more bits of them.
SHORT_RUN, LONG_RUN = 59, 63
LONGEST = 58
#: Bits that are looked up at once.
WINDOW = 1 << 18
BITMAP = 8192


def values_of(bitmap: bytes, least: int = 0) -> np.ndarray:
    """The values that occur, in order, of a bitmap that begins with byte `least`; 0 always does."""
    values = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")) + 8 * least
    return (values if len(values) and values[0] == 0 else np.concatenate([[0], values])).astype(np.uint16)


class Bits:
    """Bits of a string of bytes, highest first."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> int:
        first, last = self.at // 8, (self.at + n + 7) // 8
        if last > len(self.raw):
            raise ValueError("codes are cut short")
        self.at += n
        return int.from_bytes(self.raw[first:last], "big") >> (last * 8 - self.at) & ((1 << n) - 1)


def code_lengths(raw: bytes, least: int, most: int) -> tuple[dict[int, int], int]:
    """Code length of each symbol that has a code, and the bytes that the table takes."""
    out: dict[int, int] = {}
    symbol, at, held, have, end = least, 0, 0, 0, len(raw)  # the lowest `have` bits of `held` are the next ones
    while symbol <= most:
        if have < 14:  # a length and a long run
            more = raw[at : at + 32]
            held, have, at = (held & (1 << have) - 1) << 8 * len(more) | int.from_bytes(more, "big"), have + 8 * len(more), at + len(more)
        if have < 6:
            raise ValueError("codes are cut short")
        have -= 6
        n = held >> have & 63
        if n >= SHORT_RUN:
            if n == LONG_RUN:
                if have < 8:
                    raise ValueError("codes are cut short")
                have -= 8
                symbol += (held >> have & 255) + LONG_RUN - SHORT_RUN + 2
            else:
                symbol += n - SHORT_RUN + 2
            if symbol > most + 1:
                raise ValueError("a run of code lengths is too long")
            continue
        if n:
            out[symbol] = n
        symbol += 1
    return out, min(end, at) - have // 8


#: Bits that the decode table looks at; longer codes are searched for by length.
LOOK = 16


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, length, code) of every symbol with a code: within a length codes rise with the symbol, and longer codes come first in value."""
    symbols = np.array(sorted(lengths), np.int64)
    sizes = np.array([lengths[s] for s in symbols.tolist()], np.int64)
    count = np.bincount(sizes, minlength=LONGEST + 1)
    first, code = [0] * (LONGEST + 1), 0
    for n in range(LONGEST, 0, -1):
        first[n] = code
        code = (code + int(count[n])) >> 1
    codes = np.empty(len(symbols), np.int64)
    for n in np.unique(sizes).tolist():
        own = sizes == n
        codes[own] = first[n] + np.arange(int(own.sum()))
    return symbols, sizes, codes


def _tables(symbols: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length by the next bits, and how many bits these are: LOOK, or fewer if no code is that long; length 0 where the code is longer, or none."""
    look = min(LOOK, int(sizes.max(initial=1)))
    of, length = np.zeros(1 << look, np.int64), np.zeros(1 << look, np.int64)
    short = sizes <= look
    room = look - sizes[short]
    if (codes[short] >> sizes[short]).any():
        raise ValueError("codes overflow")
    spread = np.repeat(codes[short] << room, 1 << room)
    spread += np.arange(len(spread)) - np.repeat(np.cumsum(1 << room) - (1 << room), 1 << room)
    of[spread], length[spread] = np.repeat(symbols[short], 1 << room), np.repeat(sizes[short], 1 << room)
    return of, length, look


def unhuffed(raw: bytes, n_words: int) -> np.ndarray:
    """Words of a Huffman-coded block: a header of five 32-bit numbers, the table of lengths, the codes.

    What stands at every bit, and where the next code would begin, is looked up
    for WINDOW bits at once; only the hops from code to code come one by one.
    """
    if len(raw) < 20:
        raise ValueError("codes are cut short")
    least, most, _, n_bits, _ = struct.unpack_from("<5I", raw)
    if least >= SYMBOLS or most >= SYMBOLS:
        raise ValueError("a symbol is out of range")
    lengths, taken = code_lengths(raw[20:], least, most)
    data = raw[20 + taken :]
    if n_bits > 8 * len(data):
        raise ValueError("codes are cut short")
    symbols, sizes, codes = canonical(lengths)
    of, length, look = _tables(symbols, sizes, codes)
    wide = np.frombuffer(data[: -(-n_bits // 8)] + bytes(8), np.uint8).astype(np.int64)
    three = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    longer = {(int(n), int(c)): int(s) for s, n, c in zip(symbols[sizes > LOOK], sizes[sizes > LOOK], codes[sizes > LOOK], strict=True)}
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    p = 0
    while p < n_bits:
        base, end = p, min(p + WINDOW, n_bits)
        at = np.arange(base, end)
        window = three[at >> 3] >> (24 - look - (at & 7)) & (1 << look) - 1
        symbol, size = of[window], length[window]
        # the greatest symbol repeats the word before, as often as the next 8 bits say
        repeats = (size > 0) & (symbol == most)
        hops = np.where(size > 0, at + size + 8 * repeats, -1).tolist()
        found: list[int] = []
        while p < end:
            i = p - base
            found.append(i)
            q = hops[i]
            if q < 0:
                symbol[i], size[i] = _long(longer, data, p, n_bits)
                repeats[i] = symbol[i] == most
                q = p + int(size[i]) + 8 * int(repeats[i])
            p = q
        spots = np.array(found, np.int64)
        done.append((symbol[spots], repeats[spots], spots + base + size[spots]))
    own, runs, ends = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    if p > n_bits:
        raise ValueError("codes are cut short")
    count = np.ones(len(own), np.int64)
    after = ends[runs]
    count[runs] = (wide[after >> 3] << 8 | wide[(after >> 3) + 1]) >> (8 - (after & 7)) & 0xFF
    if len(runs) and runs[0]:
        raise ValueError("a run without a word")
    if int(count.sum()) != n_words:
        raise ValueError(f"{int(count.sum())} words instead of {n_words}")
    # a run takes the last word that is no run itself
    source = np.maximum.accumulate(np.where(runs, 0, np.arange(len(own))))
    return np.repeat(own[source], count).astype(np.uint16)


def _long(longer: dict[tuple[int, int], int], data: bytes, p: int, n_bits: int) -> tuple[int, int]:
    """(symbol, size) of the code at bit p, which has more than LOOK bits."""
    bits = Bits(data)
    for n in range(LOOK + 1, LONGEST + 1):
        if p + n > n_bits:
            break
        bits.at = p
        hit = longer.get((n, bits.take(n)))
        if hit is not None:
            return hit, n
    raise ValueError("an unknown code")


def pair(low: np.ndarray, high: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two words of a mean and a difference: signed where all values are below 2**14, else modulo 2**16."""
    if narrow:
        low, high = (((x + 0x8000) & 0xFFFF) - 0x8000 for x in (low, high))
        a = low + (high & 1) + (high >> 1)
        return a & 0xFFFF, (a - high) & 0xFFFF
    b = (low - (high >> 1)) & 0xFFFF
    return (high + b - 0x8000) & 0xFFFF, b


def unwaved(plane: np.ndarray, narrow: bool) -> np.ndarray:
    """Undo the wavelet in place, from the coarsest step down; an odd last row or column has pairs in one direction only."""
    down, across = plane.shape
    step = 1
    while 2 * step <= min(down, across):
        step *= 2
    step //= 2
    while step >= 1:
        # whole pairs in each direction, and where a row or column is left over
        p2 = 2 * step
        n_y, n_x = down // p2, across // p2
        y, x, y1, x1 = slice(0, n_y * p2, p2), slice(0, n_x * p2, p2), slice(step, n_y * p2, p2), slice(step, n_x * p2, p2)
        top, low = pair(plane[y, x], plane[y1, x], narrow)
        top_right, low_right = pair(plane[y, x1], plane[y1, x1], narrow)
        plane[y, x], plane[y, x1] = pair(top, top_right, narrow)
        plane[y1, x], plane[y1, x1] = pair(low, low_right, narrow)
        if across & step and n_y:
            last = n_x * p2
            plane[y, last], plane[y1, last] = pair(plane[y, last], plane[y1, last], narrow)
        if down & step and n_x:
            last = n_y * p2
            plane[last, x], plane[last, x1] = pair(plane[last, x], plane[last, x1], narrow)
        step //= 2
    return plane


def words(payload: bytes, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Little-endian words of each plane; shapes: rows, samples a row, words a sample."""
    least, most = struct.unpack_from("<2H", payload)
    at, bitmap = 4, b""
    if least <= most:
        if most >= BITMAP or at + most - least + 1 > len(payload):
            raise ValueError("the bitmap is cut short")
        bitmap = payload[at : at + most - least + 1]
        at += most - least + 1
    values = values_of(bitmap, least)
    (size,) = struct.unpack_from("<I", payload, at)
    if at + 4 + size > len(payload):
        raise ValueError("codes are cut short")
    flat = unhuffed(payload[at + 4 : at + 4 + size], sum(r * w * k for r, w, k in shapes))
    narrow, out, at = len(values) - 1 < 1 << 14, [], 0
    for rows, width, k in shapes:
        own = flat[at : at + rows * width * k].astype(np.int64).reshape(rows, width, k)
        at += rows * width * k
        for component in range(k):
            own[:, :, component] = unwaved(own[:, :, component].copy(), narrow)
        # the number of a value that isn't there is 0
        out.append(np.where(own < len(values), values[np.minimum(own, len(values) - 1)], 0).reshape(rows, width * k).astype("<u2"))
    return out
