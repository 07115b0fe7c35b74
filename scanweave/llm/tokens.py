"""Whole-text token ids of Arrow columns, with a per-worker memo of encoded pieces.

Every id comes from the ``tokenizers`` library.  The texts of a batch stand in
one byte array and are cut into pieces at places where both pre-tokenizers that
are supported here end a pre-token, whatever stands around:

* in front of a blank or line end that stands alone between other characters
  (the byte-level pattern starts ``" word"`` there; the word-level pattern drops
  white space), and behind such a line end;
* between a letter and an ASCII mark other than an apostrophe.

So the ids of a text are the ids of its pieces, one after the other.  Arrow
finds the distinct pieces of a batch; each worker encodes a piece once and
looks it up afterwards; the ids of all texts are then gathered in one pass.
White space of other kinds is never cut, and a text with the spelling of an
added token is one piece.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one worker remembers: of two generations of at most so many each, the older one is forgotten.
MEMO_PIECES = 400_000

#: Pieces that a worker remembers from one task to the next, at most.
KEPT_PIECES = 50_000

#: Longer pieces are not remembered.
MEMO_BYTES = 64

#: Pieces encoded as one text.
RUN = 256

_BLANK, _LETTER, _MARK, _CONTROL, _LEAD = 1, 2, 4, 8, 16

#: UTF-8 of white space beyond ASCII.
_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80")


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[:32] = _CONTROL
    out[[10, 32]] = _BLANK
    for x in range(33, 127):
        c = chr(x)
        out[x] = _LETTER if c.isalpha() else 0 if c.isdigit() or c == "'" else _MARK
    out[sorted({s[0] for s in _SPACES})] = _LEAD
    return out


_KIND = _kinds()
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts - (ends - lengths)).astype(np.int32 if total + len(flat) < 1 << 31 else np.int64), lengths)
    at += np.arange(total, dtype=at.dtype)
    return flat[at]


class Encoder:
    """Ids of whole texts for one tokenizer file."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        # a blank in front is part of the first id of a piece in byte-level vocabularies
        self.leading = spec["pre_tokenizer"]["type"] == "ByteLevel"
        # case of A-Z and the white space around pieces don't matter in word-level vocabularies that lower their text
        self.lowers = not self.leading and "Lowercase" in json.dumps(spec["normalizer"])
        # what ends a piece in a run: its last id stands for nothing else there
        self.mark = "\n" if self.leading else " \x01 "
        self.mark_ids = self.whole(self.mark)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.sure = True
        self.sure = len(self.mark_ids) > 0 and self._pieces_are_independent()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _pieces_are_independent(self) -> bool:
        """Does this file behave as the cuts assume?  Otherwise every text is one piece."""
        probe = "One two's, thrée 44 five!! \x01 six\nseven (Eight-nine) x2.  Ten\n\nend. "
        return np.array_equal(self.encode([probe])[0], self.whole(probe))

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The places of cuts in texts that stand one after the other; every text starts at one, bounds hold their ends too."""
        kind = _KIND[data]
        space = (kind & (_BLANK | _CONTROL)) != 0
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            near = np.zeros((len(lead), 3), np.uint8)
            for i in range(3):
                inside = lead + i < len(data)
                near[inside, i] = data[lead[inside] + i]
            for s in _SPACES:
                for k in lead[(near[:, : len(s)] == np.frombuffer(s, np.uint8)).all(1)]:
                    space[k : k + len(s)] = True
        cut = np.zeros(len(data) + 1, bool)
        blank = (kind & _BLANK) != 0
        lone = blank[1:-1] & ~space[:-2] & ~space[2:]
        lone_at = np.flatnonzero(lone) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        lone_at = lone_at[~edge[lone_at] & ~edge[lone_at + 1]]  # white space at an end of a text is not cut
        cut[lone_at] = True
        cut[lone_at[data[lone_at] == 10] + 1] = True
        letter = (kind & _LETTER) != 0
        # à to ÿ and À to Ÿ but for × and ÷
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & ((data[1:] & 0xDF) != 0x97)
        cut[1:-1] |= letter[:-1] & ((kind[1:] & _MARK) != 0)
        return cut

    def _learn(self, pieces: list[bytes], odd: set[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces: plain ones RUN at a time as one text with a mark after each, odd ones by themselves."""
        out: dict[bytes, bytes] = {}
        plain = [p for p in pieces if p not in odd] if odd else pieces
        alone = [p for p in pieces if p in odd]
        m, size, end = len(self.mark_ids), self.dtype.itemsize, self.mark_ids[-1:]
        runs = [plain[k : k + RUN] for k in range(0, len(plain), RUN)]
        mark = self.mark.encode()
        texts = [(mark.join(run) + mark).decode("utf-8", "replace") for run in runs]
        for run, got in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            ends = np.flatnonzero(ids == end)
            if len(ends) != len(run):  # a piece has the mark's id too
                alone += run
                continue
            raw, stops = ids.tobytes(), ((ends - (m - 1)) * size).tolist()
            starts = [0, *((ends[:-1] + 1) * size).tolist()]
            out.update(zip(run, [raw[b:e] for b, e in zip(starts, stops, strict=True)], strict=True))
        for p, got in zip(alone, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in alone], add_special_tokens=False), strict=True):
            out[p] = np.array(got.ids, self.dtype).tobytes()
        return out

    def _resolved(self, pieces: list[bytes], odd: set[bytes]) -> list[bytes]:
        """The ids of each of the distinct pieces of a batch; odd ones hold white space inside, or an added token."""
        recent = self.recent
        missing = [p for p in pieces if p not in recent]
        if not missing:
            return [recent[p] for p in pieces]
        if len(recent) > MEMO_PIECES:
            self.older, self.recent = recent, {}
            recent, missing = self.recent, pieces
        older = self.older
        recent.update((p, older[p]) for p in missing if p in older)
        learnt = self._learn(list(dict.fromkeys(p for p in missing if p not in recent)), odd)
        recent.update((p, ids) for p, ids in learnt.items() if len(p) <= MEMO_BYTES)
        return [recent[p] if p in recent else learnt[p] for p in pieces]

    def forget(self, most: int = KEPT_PIECES) -> None:
        """Drop a memo of more than `most` pieces, at the end of a task: an idle worker would keep some 200 MB for it."""
        if len(self.recent) + len(self.older) > most:
            self.recent, self.older = {}, {}

    def _inner(self, data: np.ndarray, cut: np.ndarray, raw: bytes) -> np.ndarray:
        """Places of what makes a piece odd: white space and control characters but for one blank in front, and added tokens."""
        kind = _KIND[data]
        odd = ((kind & _CONTROL) != 0) | (data == 10)
        odd |= (data == 32) & ~cut[:-1]
        lead = np.flatnonzero(kind == _LEAD)
        found = [np.flatnonzero(odd), lead[[raw.startswith(_SPACES, k) for k in lead.tolist()]] if len(lead) else lead]
        for a in self.added:
            at = raw.find(a)
            while at >= 0:
                found.append(np.array([at]))
                at = raw.find(a, at + 1)
        return np.concatenate(found)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last one's end); null is an empty text."""
        column = column.fill_null("").cast(pa.binary())
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        first, last = int(bounds[0]), int(bounds[-1])
        bounds = bounds - first
        if last == first:
            return np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[first:last]
        cut = self._pieces(data, bounds) if self.sure else np.zeros(len(data) + 1, bool)
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            for b, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                if any(raw.find(a, b, e) >= 0 for a in self.added):
                    cut[b + 1 : e] = False
        cut[bounds] = True
        if self.lowers:
            # below U+0300 normalisation leaves characters as they are, so the case of A-Z can go first
            total = np.concatenate([[0], np.cumsum(data >= 0xCC, dtype=np.int64)])
            plain = total[bounds[1:]] == total[bounds[:-1]]
            data = np.where(np.repeat(plain, np.diff(bounds)), _LOWERED[data], data) if not plain.all() else _LOWERED[data]
        places = np.flatnonzero(cut)
        inner = np.searchsorted(places, self._inner(data, cut, raw), "right") - 1
        spans = pa.BinaryArray.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
        distinct = pc.dictionary_encode(spans)
        index = distinct.indices.to_numpy()
        held, ends = distinct.dictionary.buffers()[2].to_pybytes(), np.frombuffer(distinct.dictionary.buffers()[1], np.int32)[: len(distinct.dictionary) + 1].tolist()
        pieces = [held[b:e] for b, e in zip(ends, ends[1:], strict=False)]
        odd = {pieces[i] for i in np.unique(index[inner])}
        if self.lowers:
            pieces = [p[1:] if p[0] == 32 and len(p) > 1 and p not in odd else p for p in pieces]
        odd.add(b" ")
        ids = self._resolved(pieces, odd)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        lengths = sizes[index]
        flat = ragged(np.frombuffer(b"".join(ids), self.dtype), (np.cumsum(sizes) - sizes)[index], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return flat, before[np.searchsorted(places, bounds)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; no ids for None and for an empty text."""
        flat, at = self.encode_column(pa.array(texts, pa.string()))
        return [flat[b:e] for b, e in zip(at[:-1], at[1:], strict=True)]


def with_end(flat: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as encode_column gives them, with the id `end` after each."""
    out = np.full(len(flat) + len(at) - 1, end, flat.dtype)
    own = np.ones(len(out), bool)
    own[at[1:] + np.arange(len(at) - 1)] = False
    out[own] = flat
    return out, at + np.arange(len(at))


@cache
def encoder(file: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(file)
