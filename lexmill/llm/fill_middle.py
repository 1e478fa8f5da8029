"""Fill-in-the-middle documents: a text is cut at two characters and its middle moved to the end.

Where characters start in the UTF-8 bytes of a batch is a packed bitvector with a directory
of ranks: per block of 512 bits the number of starts before it, per word of 64 those before
it in its block. The rank of a text's ends gives its number of characters, a select on two
ranks the bytes to cut at; no text is decoded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import small_batches

#: before the prefix, the suffix and the middle
MARKS = ("<P>", "<S>", "<M>")
PERCENT_CUT, PERCENT_SUFFIX_FIRST = 90, 20
_WORDS = 8  # of a block


class CharacterStarts:
    """Rank and select over the bytes at which UTF-8 characters start."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        room = (len(data) // (64 * _WORDS) + 1) * 8 * _WORDS  # a block more, so that the end has a word
        self.words = np.concatenate((bits, np.zeros(room - len(bits), np.uint8))).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(-1, _WORDS)
        self.within = np.cumsum(ones, axis=1) - ones
        self.blocks = np.concatenate(([0], np.cumsum(ones.sum(axis=1))))
        self.total = int(self.blocks[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Characters that start before byte `at`, 0 <= at <= size."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.blocks[word // _WORDS] + self.within[word // _WORDS, word % _WORDS] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte at which character k starts, k from 0; the number of bytes for k = total."""
        inside = k < self.total
        k = np.where(inside, k, 0)
        block = np.searchsorted(self.blocks[:-1], k, side="right") - 1
        left = k - self.blocks[block]
        word = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, word]
        bits, at = self.words[block * _WORDS + word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # towards the bit that has `left` ones before it
            low = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            over = left >= ones
            left, at = np.where(over, left - ones, left), at + half * over
            bits = np.where(over, bits >> np.uint64(half), low)
        return np.where(inside & (self.total > 0), (block * _WORDS + word) * 64 + at, self.size)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four 32-bit integers that depend on the seed and the document's id, a null one written `-`."""
    digest = hashlib.sha256(f"{seed}:{'-' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def _rearranged(seed: int, percent: int, suffix_first: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def run(batches):
        for batch in batches:
            data, off = wh.utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in wh.pieces(off, 1 << 20, 1 << 16):
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts = CharacterStarts(own)
                heads = starts.rank(at)
                n = np.diff(heads)
                h = np.array([draws(i, seed) for i in ids[a:b]], np.int64).reshape(-1, 4)
                ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                cuts = starts.select((heads[:-1, None] + ranks).ravel()).reshape(-1, 2)
                raw = own.tobytes()
                forms, texts = [], []
                for k, (x, y, z, w) in enumerate(zip(at[:-1].tolist(), cuts[:, 0].tolist(), cuts[:, 1].tolist(), at[1:].tolist(), strict=True)):
                    text = raw[x:w]
                    if not text or p in text or s in text or m in text or h[k, 2] % 100 >= percent:
                        forms.append("plain")
                        texts.append(text)
                    elif h[k, 3] % 100 < suffix_first:
                        forms.append("spm")
                        texts.append(b"".join((s, raw[z:w], p, raw[x:y], m, raw[y:z])))
                    else:
                        forms.append("psm")
                        texts.append(b"".join((p, raw[x:y], s, raw[z:w], m, raw[y:z])))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(ranks[:, 0], pa.int64(), mask=plain), "middle_chars": pa.array(ranks[:, 1] - ranks[:, 0], pa.int64(), mask=plain), "output": pa.array(texts, pa.binary()).cast(pa.string())})

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = PERCENT_CUT, suffix_first: int = PERCENT_SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (characters), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    `percent` of the documents are cut, `suffix_first` percent of these have their suffix
    first. A text that is empty or holds a mark stays plain. Everything depends on the seed
    and doc_id alone: repeated rows are cut alike, and so are all of one doc_id at their own
    lengths; a null doc_id is drawn for as `-`. Null text: empty. Other columns are ignored.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rearranged(seed, percent, suffix_first, marks), ddl)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from, found by its marks alone."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        x = F.locate(second, output, len(first) + 1)
        y = x + F.locate(marks[2], F.substr(output, x + len(second))) + len(second) - 1
        return F.substr(output, F.lit(len(first) + 1), x - len(first) - 1), F.substr(output, x + len(second), y - x - len(second)), F.substr(output, y + len(marks[2]))

    prefix, suffix, middle = between(marks[0], marks[1])
    last, head, centre = between(marks[1], marks[0])
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, centre, last)).otherwise(output)


def fill_in_middle_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(docs)
    whole = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(whole.cast("binary"), 256).alias("restored_sha256"))
