"""Vectorised words, word hashes and n-gram hashes over the UTF-8 bytes of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur
inside a multi-byte UTF-8 character, so byte positions give the same words as a regular
expression over code points, and whole batches are cut with a handful of numpy passes.

Hashes are 64-bit and mixed word by word of 8 bytes: each step is a bijection of the state
that depends on the bytes in a non-linear way, so byte ranges of one length up to 8 bytes
never share a hash and longer ones only by chance. Long ranges are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_STEP = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    h = h ^ (h >> U64(30))
    h *= _M1
    h ^= h >> U64(27)
    h *= _M2
    h ^= h >> U64(31)
    return h


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * _STEP)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ranges of more bytes are hashed one by one
LONG = 512
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """start, end: byte range of each word; first: index of each document's first word, then the number of words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, off: np.ndarray) -> Words:
    solid = ~SPACE[data]
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    heads, tails = off[:-1][full], off[1:][full] - 1
    begin[heads] = solid[heads]
    finish[tails] = solid[tails]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(finish) + 1, np.searchsorted(start, off))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position of data on as one integer; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end]."""
    size = end - start
    h = mix(size.astype(U64) * _STEP + U64(seed))
    if not len(h):
        return h
    view = eights(data)
    h ^= view[start] & MASKS[np.minimum(size, 8)]
    h = mix(h)
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = start[live] + 8, size[live] - 8
    while len(live):
        h[live] = mix(h[live] ^ (view[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[start[k] : end[k]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        h[k] = mix(h[k : k + 1] ^ np.frombuffer(digest, "<u8"))[0]
    return h


def fresh_key() -> int:
    """A secret of one run: drawn on the driver and sent along with the work, so a task that runs again hashes as before, and no text can be written to collide."""
    return int.from_bytes(os.urandom(8), "little") >> 2


PRIME = U64((1 << 61) - 1)
_LOW29, _LOW32 = U64((1 << 29) - 1), U64((1 << 32) - 1)


#: values that are hashed at a time
_CHUNK = 1 << 13


def _times(a: np.ndarray, r: int) -> np.ndarray:
    """a * r modulo 2**61 - 1, for values below 2**62 and r below 2**61; the result is below 2**61 + 8."""
    high, low = U64(r >> 32), U64(r & 0xFFFFFFFF)
    a_high, a_low = a >> U64(32), a & _LOW32
    middle = a_high * low
    middle += a_low * high
    a_low *= low
    a_high *= high
    a_high <<= U64(3)
    a_high += middle >> U64(29)
    middle &= _LOW29
    middle <<= U64(32)
    a_high += middle
    a_high += a_low >> U64(61)
    a_low &= PRIME
    a_high += a_low
    return _folded(a_high)


def _folded(a: np.ndarray) -> np.ndarray:
    """The same modulo 2**61 - 1, below 2**61 + 8."""
    return (a & PRIME) + (a >> U64(61))


def run_point(salt: int, key: int) -> int:
    digest = hashlib.blake2b(b"%d:%d" % (salt, key), digest_size=8).digest()
    return int.from_bytes(digest, "little") % (int(PRIME) - 2) + 2


def gram_hashes(h: np.ndarray, width: int, salt: int = 0, key: int = 0) -> np.ndarray:
    """A hash of each run of `width` consecutive values of h, whatever documents they come from.

    A polynomial in a point that depends on the key, modulo the prime 2**61 - 1, of the upper
    61 bits of the values, then mixed: two different runs agree for at most width - 1 of all
    points. Runs of twice the length are made of two of half of it, so the work grows with
    the logarithm of the width.
    """
    n, point = len(h) - width + 1, run_point(salt, key)
    if n <= 0:
        return np.zeros(0, U64)
    if n > _CHUNK:  # what stays in a core's cache is done many times faster
        return np.concatenate([gram_hashes(h[k : min(k + _CHUNK, n) + width - 1], width, salt, key) for k in range(0, n, _CHUNK)])
    power, run, size = point, h >> U64(3), 1  # run: hashes of all runs of `size`, power: point to the `size`
    out, done = None, 0
    while True:
        if width & size:
            # what is done so far lies before the next `size` values
            part = run[done : done + n]
            out = part if out is None else _folded(_times(out, power) + part)
            done += size
        if done == width:
            break
        run = _folded(_times(run[:-size], power) + run[size:])
        power, size = power * power % int(PRIME), 2 * size
    out = _folded(out)
    return mix(np.where(out >= PRIME, out - PRIME, out) ^ (U64(width & 7) << U64(61)))


def gram_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, document) of each run of `width` words inside one document."""
    per = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    shift = first[:-1] - np.concatenate(([0], np.cumsum(per)[:-1])) if len(per) else first[:-1]
    return np.arange(per.sum()) + np.repeat(shift, per), doc


def pieces(off: np.ndarray, most_bytes: int, most_docs: int) -> list[tuple[int, int]]:
    """Ranges of documents of at most so many bytes and documents; a longer document stands alone."""
    cuts, at, n = [], 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1
        to = max(at + 1, min(to, at + most_docs, n))
        cuts.append((at, to))
        at = to
    return cuts


SHINGLE_BITS = 54
MOST_DOCS = 1 << (64 - SHINGLE_BITS)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles as 54-bit hashes under the key, document of each, first index by document) of at most 1024 documents.

    A-Z are lower-cased. A document of fewer than `width` words has its whole word sequence
    as one shingle; one without words has none.
    """
    data = LOWER[data]
    w = words(data, off)
    h = span_hashes(data, w.start, w.end, 11 + key)
    at, doc = gram_starts(w.first, width)
    grams = gram_hashes(h, width, key=key)[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        own = np.array([gram_hashes(h[w.first[d] : w.first[d + 1]], int(w.counts[d]), salt=1, key=key)[0] for d in short], dtype=U64)
        grams, doc = np.concatenate((grams, own)), np.concatenate((doc, short))
    key = np.sort((doc.astype(U64) << U64(SHINGLE_BITS)) | (grams >> U64(64 - SHINGLE_BITS)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> U64(SHINGLE_BITS)).astype(np.int64)
    return key & U64((1 << SHINGLE_BITS) - 1), doc, np.searchsorted(doc, np.arange(len(off)))
