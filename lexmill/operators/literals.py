"""Literals inside texts: leftmost-longest matches of a table of strings by an automaton over whole batches.

The literals are cut into lots of a bounded size. Each lot's automaton is built once per
worker and run over all texts, a character a step however many literals there are; what it
finds is added to the row. What all lots found is settled at the end, so the number of literals has
no limit.
"""

from __future__ import annotations

import uuid
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.ngrams import small_batches, utf8

#: characters of the literals of one automaton
LOT_CHARS = 4 << 20
_MADE: dict[str, object] = {}


def automaton(name: str, literals: list[tuple[str, int]]):
    """Of (literal, id) pairs; of equal literals the smallest id holds. The worker keeps the last one."""
    if name not in _MADE:
        _MADE.clear()
        made = ahocorasick.Automaton()
        for text, number in sorted(literals, key=lambda x: (x[0], -x[1])):
            if text:
                made.add_word(text, (len(text), number))
        made.make_automaton()
        _MADE[name] = made
    return _MADE[name]


def longest_by_start(found) -> list[tuple[int, int, int]]:
    """(start, length, id) of the longest match at each start, ascending, from (end, (length, id))."""
    best: dict[int, tuple[int, int]] = {}
    for end, (length, number) in found:
        start = end - length + 1
        if start not in best or length > best[start][0]:
            best[start] = length, number
    return [(start, *best[start]) for start in sorted(best)]


def leftmost(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those that stay when each, from left to right, rules out what overlaps it."""
    out, free = [], 0
    for start, length, number in matches:
        if start >= free:
            out.append((start, length, number))
            free = start + length
    return out


def _lots(literals: DataFrame) -> tuple[DataFrame, int]:
    size = literals.agg(F.sum(F.length("literal") + 8)).first()[0] or 0
    n = max(1, -(-size // LOT_CHARS))
    return literals.withColumn("lot", F.pmod(F.xxhash64("literal"), F.lit(n)).cast("int")), n


_MATCHES = "array<struct<start: int, length: int, id: long>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("id", pa.int64())]))


def _only_lot(name: str, shipped):
    """Leftmost-longest matches straight from the automaton, by number; what a number stands for is looked up for a whole batch."""

    def run(batches):
        own, lengths, ids = _numbered(name, shipped.value)
        for batch in batches:
            per_row, found = [], []
            for text in batch.column("text").to_pylist():
                flat = np.fromiter(chain.from_iterable(own.iter_long(text)), np.int64) if text and len(own) else _NOTHING
                per_row.append(len(flat) // 2)
                found.append(flat)
            ends, numbers = np.concatenate([_NOTHING, *found]).reshape(-1, 2).T
            offsets = pa.array(np.append(0, np.cumsum(per_row)), pa.int32())
            fields = [pa.array(ends - lengths[numbers] + 1, pa.int32()), pa.array(lengths[numbers], pa.int32()), pa.array(ids[numbers], pa.int64())]
            matches = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "id"])).cast(_ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("row"), matches], names=["row", "matches"])

    return run


_NOTHING = np.zeros(0, np.int64)


def _numbered(name: str, literals: list[tuple[str, int]]):
    """(automaton of numbers, length of each, id of each)."""
    if name not in _MADE:
        _MADE.clear()
        made, held = ahocorasick.Automaton(), sorted((x for x in literals if x[0]), key=lambda x: (x[0], -x[1]))
        for k, (text, _) in enumerate(held):
            made.add_word(text, k)
        made.make_automaton()
        _MADE[name] = made, np.array([len(t) for t, _ in held], np.int64), np.array([i for _, i in held], np.int64)
    return _MADE[name]


def _one_of_lots(name: str, shipped):
    """Adds the matches of one lot, the longest at each start, to those that rows (row, text, matches) bring along."""

    def run(batches):
        own = automaton(name, shipped.value)
        for batch in batches:
            out = []
            for text, held in zip(batch.column("text").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                found = longest_by_start(own.iter(text)) if text and len(own) else []
                out.append(held + [{"start": s, "length": m, "id": k} for s, m, k in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(out, _ARROW)], names=["row", "text", "matches"])

    return run


def _settled(batches):
    for batch in batches:
        out = []
        for held in batch.column("matches").to_pylist():
            every = longest_by_start((m["start"] + m["length"] - 1, (m["length"], m["id"])) for m in held)
            out.append([{"start": s, "length": m, "id": k} for s, m, k in leftmost(every)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _ARROW)], names=["row", "matches"])


def literal_matches(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """docs (any columns) with matches: start (from 0, in characters), length and id of the literals (literal, id) in `text`.

    At each place the leftmost match counts, of these the longest, and none overlaps another.
    Empty literals match nothing, equal literals count as the one of the smallest id. Null or
    empty texts have no match. A column named matches is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop("matches").select(F.struct("*").alias("row"), F.col("text"), F.array().cast(_MATCHES).alias("matches"))
    kind = rows.schema["row"].dataType.simpleString()
    dealt, n = _lots(literals.select(F.col("literal"), F.col("id").cast("long").alias("id")).where("literal is not null and id is not null"))
    for lot in range(n):
        held = [(r["literal"], r["id"]) for r in dealt.where(F.col("lot") == lot).collect()]  # LOT_CHARS at most, on average
        name, shipped = uuid.uuid4().hex, spark.sparkContext.broadcast(held)
        if n == 1:
            return rows.mapInArrow(_only_lot(name, shipped), f"row {kind}, matches {_MATCHES}").select("row.*", "matches")
        rows = rows.mapInArrow(_one_of_lots(name, shipped), f"row {kind}, text string, matches {_MATCHES}")
    return rows.select("row", "matches").mapInArrow(_settled, f"row {kind}, matches {_MATCHES}").select("row.*", "matches")


def _pieces(batches):
    """The text of each row cut at its matches; put together the pieces are the texts, so only offsets are made."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each character
        first = np.searchsorted(lead, off)  # character at which each text begins
        matches = batch.column("matches")
        flat = matches.flatten()
        row = np.repeat(np.arange(len(batch)), np.asarray(pc.fill_null(pc.list_value_length(matches), 0)))
        start = first[row] + np.asarray(flat.field("start"), np.int64)
        end = start + np.asarray(flat.field("length"), np.int64)
        cuts = np.unique(np.concatenate([first, start, end]))  # the ends of texts among them
        head = cuts[:-1] if len(cuts) else cuts
        at = np.searchsorted(start, head)
        hit = np.append(start, -1)[at] == head
        ids = pa.array(np.append(np.asarray(flat.field("id"), np.int64), 0)[at], pa.int64(), mask=~hit)
        pieces = pa.StringArray.from_buffers(len(head), pa.py_buffer(lead[cuts].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        per_row = pa.array(np.searchsorted(head, first), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(per_row, pa.StructArray.from_arrays([pieces, ids], names=["piece", "id"]))], names=["row", "pieces"])


def split_at_literals(docs: DataFrame, literals: DataFrame) -> DataFrame:
    """docs with pieces: the text cut at its literals, in order, as (piece, id); id is null for what lies between, which is never empty. Columns named matches or pieces are replaced."""
    found = literal_matches(docs.drop("pieces"), literals)
    rows = found.select(F.struct(*[c for c in found.columns if c != "matches"]).alias("row"), "text", "matches")
    return rows.mapInArrow(_pieces, f"row {rows.schema['row'].dataType.simpleString()}, pieces array<struct<piece: string, id: long>>").select("row.*", "pieces")


def literals_of(rows: DataFrame) -> DataFrame:
    """literal, id of an added-token list (content, id, special) as readers of such files take it: entries without a string or an id are left out, as are bracketed specials; of equal contents the last entry holds."""
    kept = rows.where("content is not null and content <> '' and id is not null").where(~(F.col("content").rlike("^<.*>$") & F.coalesce("special", F.lit(True))))
    last = F.row_number().over(Window.partitionBy("content").orderBy(F.desc("id")))
    return kept.withColumn("r", last).where("r = 1").select(F.col("content").alias("literal"), F.col("id").cast("long").alias("id"))
