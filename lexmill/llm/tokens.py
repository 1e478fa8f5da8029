"""Byte-level BPE ids for whole batches, by the tokenizers library on distinct pre-tokens.

The library spends most of its time on per-token bookkeeping, and running text repeats its
pre-tokens. So a batch is cut into pre-tokens with numpy (the byte-level BPE pattern:
contractions, letters, digits, other signs, each with one space before, and white space),
only pre-tokens that this worker hasn't met are given to the library's BPE model, and the ids are
put together by look-up. The worker's table has a fixed number of slots and keeps the first
pre-token of each slot, with its bytes, which a look-up compares; others, and pre-tokens of
more than 24 bytes, are encoded again when they come back. Texts with
characters outside the ranges below, whose class may differ between Unicode versions, are
encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from lexmill.llm import wordhash as wh

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLOT_BITS = 20
#: bytes of a pre-token that the table can hold, in integers of 8
HELD = 3
_LETTER, _DIGIT, _OTHER, _BLANK, _SPACE, _RARE = range(6)
_BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
#: contractions of the pre-token pattern (fixed values)
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _classes() -> np.ndarray:
    """The class of each code point below 0x2C00; beyond, and in ranges that aren't trusted, _RARE."""
    kinds = np.full(0x2C01, _RARE, np.uint8)
    for c in [*range(0x0530), *range(0x2000, 0x2C00)]:
        kind = unicodedata.category(chr(c))
        kinds[c] = _RARE if kind == "Cn" else _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _OTHER
    kinds[list(_BLANKS)] = _BLANK
    kinds[0x20] = _SPACE
    return kinds


def _byte_letters() -> np.ndarray:
    """The printable code point that a byte-level vocabulary writes for each byte: itself if printable Latin-1, else the next from 256."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
    out = np.arange(256, dtype=np.uint32)
    out[np.setdiff1d(np.arange(256), plain)] = 256 + np.arange(256 - len(plain))
    return out


class BatchEncoder:
    """Ids of the texts of a batch, by one tokenizer file; keeps its table for the life of the worker.

    With special, the string of an added token in a text is that token, as the library has it
    by default; else it is ordinary text.
    """

    _made: dict[tuple[str, bool], "BatchEncoder"] = {}

    @classmethod
    def of(cls, path: str, special: bool = False) -> "BatchEncoder":
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.kinds = _classes()
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.bytes = np.zeros((HELD, 1 << SLOT_BITS), np.uint64)
        self.length = np.zeros(1 << SLOT_BITS, np.uint8)  # 0: a free slot
        self.at = np.zeros(1 << SLOT_BITS, np.int32)
        self.n = np.zeros(1 << SLOT_BITS, np.uint8)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where pre-tokens start, and the texts that the library must encode whole."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80) if len(points) != len(data) else np.arange(len(data))
        kind = self.kinds[np.minimum(points, 0x2C00)]
        heads = np.searchsorted(lead, off)  # text boundaries in code points
        rare = np.diff(np.searchsorted(np.flatnonzero(kind == _RARE), heads)) > 0
        n = len(points)
        white = kind >= _BLANK
        group = np.where(white, np.uint8(_BLANK), kind)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = group[1:] != group[:-1]
        begin[heads] = True
        begin[n] = True
        edge = np.zeros(n + 1, bool)
        edge[heads] = True
        starts = np.flatnonzero(begin)[:-1] if n else np.zeros(0, np.int64)
        ends = np.append(starts[1:], n)
        # white space before something: its last character stands alone, or with what follows if it is a space
        before = white[starts] & ~edge[ends] if n else np.zeros(0, bool)
        last = ends[before] - 1
        begin[last] = True
        joined = last[kind[last] == _SPACE] + 1
        begin[joined] = False
        # contractions: a lone ' that has no space joined to it
        lone = starts[(points[starts] == 39) & (ends - starts == 1)] if n else starts
        lone = lone[begin[lone] & (lone + 1 < n)]
        lone = lone[(kind[lone + 1] == _LETTER) & ~edge[lone + 1]]
        if len(lone):
            one = points[lone + 1]
            two = np.where((lone + 2 < n), points[np.minimum(lone + 2, n - 1)], 0)
            two[edge[np.minimum(lone + 2, n)]] = 0
            size = np.zeros(len(lone), np.int64)
            for c in _CONTRACTIONS:
                hit = (one == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True)
                size[hit & (size == 0)] = len(c) - 1
            lone, size = lone[size > 0], size[size > 0]
            begin[lone + 1] = False
            begin[lone + 1 + size] = True
        lead = np.append(lead, len(data))
        return lead[np.flatnonzero(begin)], rare

    def _ids(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, sizes) of the ids of pre-tokens, which are put at the end of the pool."""
        letters, at, split = self.letters, 0, self.tokenizer.model.tokenize
        text = letters[np.frombuffer(b"".join(pretokens), np.uint8)].tobytes().decode("utf-32-le")
        ids = []
        for p in pretokens:
            ids.append([t.id for t in split(text[at : at + len(p)])])
            at += len(p)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + total] = np.fromiter((x for i in ids for x in i), np.int32, total)
        place = self.used + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else size
        self.used += total
        return place, size

    def _look_up(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, sizes) in the pool of the ids of pre-tokens, and where what the table doesn't keep begins in the pool."""
        length, view = ends - starts, wh.eights(data)
        chunks = []
        for k in range(HELD):
            left = np.clip(length - 8 * k, 0, 8)
            chunks.append(view[np.where(left > 0, starts + 8 * k, 0)] & wh.MASKS[left])
        slot = (wh.span_hashes(data, starts, ends) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.length[slot] == length
        for k in range(HELD):
            hit &= self.bytes[k, slot] == chunks[k]
        place, size = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        lost = np.flatnonzero(~hit & ~skip)
        # the first pre-token of each free slot moves in
        new = lost[(self.length[slot[lost]] == 0) & (length[lost] <= 8 * HELD)]
        new = new[np.unique(slot[new], return_index=True)[1]]
        kept_place, kept_size = self._ids([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        free = self.used
        fits = kept_size < 256
        new, own = new[fits], slot[new[fits]]
        self.length[own], self.at[own], self.n[own] = length[new], kept_place[fits], kept_size[fits]
        for k in range(HELD):
            self.bytes[k, own] = chunks[k][new]
        hit = self.length[slot[lost]] == length[lost]
        for k in range(HELD):
            hit &= self.bytes[k, slot[lost]] == chunks[k][lost]
        done = lost[hit]
        place[done], size[done] = self.at[slot[done]], self.n[slot[done]]
        rest = lost[~hit]
        if len(rest):
            found: dict[bytes, int] = {}
            number = [found.setdefault(raw[a:b], len(found)) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            own_place, own_size = self._ids(list(found))
            place[rest], size[rest] = own_place[number], own_size[number]
        return place, size, free

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of the texts in data; end_id is put after each text."""
        cut, rare = self._pretokens(data, off)
        starts, ends = cut[:-1], cut[1:]
        doc = np.searchsorted(starts, off)
        raw = data.tobytes()
        for token in self.added:  # texts that hold an added token go to the library whole
            p = raw.find(token)
            while p >= 0:
                d = int(np.searchsorted(off, p, side="right")) - 1
                rare[d] |= p + len(token) <= off[d + 1]
                p = raw.find(token, p + 1)
        whole = np.flatnonzero(rare)
        place, size, kept = self._look_up(data, raw, starts, ends, np.repeat(rare, np.diff(doc)))
        per_doc = np.diff(np.concatenate(([0], np.cumsum(size)))[doc])
        if len(whole):
            own = self._library([raw[off[d] : off[d + 1]].decode("utf-8") for d in whole])
            for d in whole:
                size[doc[d] : doc[d + 1]] = 0
            per_doc[whole] = [len(x) for x in own]
        tail = int(end_id is not None)
        bounds = np.concatenate(([0], np.cumsum(per_doc + tail)))
        out = np.empty(bounds[-1], np.int32)
        if end_id is not None:
            out[bounds[1:] - 1] = end_id
        flat = np.repeat(place - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else np.zeros(0, np.int64)
        flat += np.arange(len(flat))
        if len(whole) or tail:
            body = np.ones(len(out), bool)
            if tail:
                body[bounds[1:] - 1] = False
            for d, ids in zip(whole, own if len(whole) else [], strict=True):
                out[bounds[d] : bounds[d] + len(ids)] = ids
                body[bounds[d] : bounds[d] + len(ids)] = False
            out[body] = self.pool[flat]
        else:
            out[:] = self.pool[flat]
        self.used = kept
        return out, bounds
