"""Best-fit decreasing packing of token pieces into windows.

Documents longer than a window are first cut into full windows, the rest left over. Then, from
long to short, each piece goes into the tightest open window that still has room for it; a
segment tree over remaining capacities finds that window. Pieces of one length are
interchangeable, so the plan is made of (windows filled alike, how many) from the histogram
of at most `room` lengths, however large the corpus, and is the one that piece-by-piece
best fit decreasing gives.

If that leaves more padding than asked for (say, when most documents are a little over half a
window), the emptiest windows are taken apart and their pieces cut to fill the widest gaps of
the others, as few windows as it takes.

Pieces take their places by joins: those of one length are numbered without gaps (salted),
and a table of number ranges says which window, offset and cut each number has.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import numbered, scratch, small_batches
from lexmill.llm.tokens import BatchEncoder

ROOM, END_ID = 2048, 1
#: padding that is put up with before documents are cut for it, by the size of all tokens
PADDING = 0.002
#: pieces of one length that are numbered together
SALTED_ROWS = 50_000


class OpenWindows:
    """How many windows are open at each remaining capacity, in a segment tree."""

    def __init__(self, room: int):
        self.width = 1 << room.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = self.width + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that has a window."""
        at = self.width + need
        if need >= self.width:
            return None
        while not self.count[at]:
            while at & 1:  # right children have nothing more to their right below the same parent
                at >>= 1
            if at == 0:
                return None
            at += 1
        return self._lowest(at)

    def widest(self) -> int | None:
        if not self.count[1]:
            return None
        at = 1
        while at < self.width:
            at = 2 * at + bool(self.count[2 * at + 1])
        return at - self.width

    def _lowest(self, at: int) -> int:
        while at < self.width:
            at = 2 * at + (not self.count[2 * at])
        return at - self.width


class Plan:
    """Windows by remaining capacity: lists of [items, how many windows]; an item is (piece length, lowest number, cut start, cut length).

    Window j of a list's entry holds, of each item, the piece with the item's lowest number plus j.
    """

    def __init__(self, room: int):
        self.room, self.open, self.by = room, OpenWindows(room), defaultdict(list)

    def put(self, capacity: int, items: list[tuple], n: int) -> None:
        self.by[capacity].append((items, n))
        self.open.add(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[list[tuple], int]:
        """Up to `most` like windows of a capacity."""
        items, n = self.by[capacity].pop()
        k = min(n, most)
        if k < n:
            self.by[capacity].append(([(v, low + k, a, l) for v, low, a, l in items], n - k))
        self.open.add(capacity, -k)
        return items, k

    def windows(self) -> list[tuple[int, list[tuple], int]]:
        return [(c, items, n) for c in sorted(self.by) for items, n in self.by[c]]


def best_fit_decreasing(histogram: np.ndarray, room: int) -> Plan:
    """The windows of best fit decreasing over histogram[length] pieces of lengths 1..room."""
    plan = Plan(room)
    if histogram[room]:
        plan.put(0, [(room, 0, 0, room)], int(histogram[room]))
    for v in range(room - 1, 0, -1):
        used, left = 0, int(histogram[v])
        while left:
            capacity = plan.open.tightest(v)
            # one by one, a window that has just got a piece is the tightest for the next as long as it has room
            each = (capacity or room) // v
            k, m = (left // each, each) if left >= each else (1, left)
            items, k = ([], k) if capacity is None else plan.take(capacity, k)
            capacity = capacity or room
            plan.put(capacity - m * v, items + [(v, used + j * k, 0, v) for j in range(m)], k)
            used, left = used + k * m, left - k * m
    return plan


def padding(plan: Plan) -> int:
    """Tokens of padding; a window that ends at a power of two needs none."""
    return sum(c * n for c, _, n in plan.windows() if (plan.room - c) & (plan.room - c - 1))


def fill_gaps(plan: Plan, most_padding: int) -> Plan:
    """The plan with the emptiest windows taken apart and cut into the widest gaps of the others until most_padding is met."""
    room, rows = plan.room, plan.windows()
    gaps = sum(c * n for c, _, n in rows)
    spare = min(gaps // room, -(-(padding(plan) - most_padding) // room))
    if spare <= 0:
        return plan
    out, heap = Plan(room), []
    for c, items, n in reversed(rows):
        k = min(n, spare)
        spare -= k
        for v, low, a, l in items if k else []:
            heapq.heappush(heap, (-l, v, low, a, k))
        if k < n:
            out.put(c, [(v, low + k, a, l) for v, low, a, l in items], n - k)
    while heap:
        l, v, low, a, n = heapq.heappop(heap)
        l = -l
        capacity = out.open.tightest(l)
        size = l if capacity is not None else out.open.widest()
        items, k = out.take(capacity if capacity is not None else size, n)
        out.put((capacity if capacity is not None else size) - size, items + [(v, low, a, size)], k)
        if size < l:
            heapq.heappush(heap, (size - l, v, low, a + size, k))
        if k < n:
            heapq.heappush(heap, (-l, v, low + k, a, n - k))
    return out


def _pieces(tokenizer: str, room: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, key = BatchEncoder.of(tokenizer, special=True), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = wh.utf8(batch.column(1))
            for a, b in wh.pieces(off, 1 << 20, 1 << 20):
                ids, bounds = encoder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                size = np.diff(bounds)
                n = -(-size // room)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * room
                length = np.minimum(size[doc] - start, room)
                at = bounds[:-1][doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield from pa.table({
                    "key": pa.array(key + np.arange(len(doc)), pa.int64()),
                    "doc_id": batch.column(0).slice(a, b - a).take(pa.array(doc)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "doc_tokens": pa.array(size[doc], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids)),
                }).to_batches()
                key += len(doc)

    return run


_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _cut(batches):
    """Rows with the ids of whole pieces: those from `from` on, `length` of them, and their checksum."""
    for batch in batches:
        t = {n: batch.column(n) for n in batch.schema.names}
        flat, bounds = np.asarray(t["ids"].flatten()), np.concatenate(([0], np.cumsum(np.asarray(t["ids"].value_lengths()))))
        low = bounds[:-1] + np.asarray(t["from"])
        parts = [flat[x:y] for x, y in zip(low.tolist(), (low + np.asarray(t["length"])).tolist(), strict=True)]
        sums = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
        own = pa.array(parts, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict({n: t[n] for n in ("doc_id", "start", "length")} | {"ids_crc32": pa.array(sums, pa.int64())} | {n: t[n] for n in ("doc_tokens", "sequence_id", "offset")} | {"ids": own})


def pack_windows(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID, most_padding: float = PADDING, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece of docs (doc_id, text).

    most_padding: the part of all tokens that padding may come to before pieces are cut to
    avoid it (0: as little as can be, by cuts; 1: cut overlong documents alone).

    Null or empty text: the end id alone. Null doc_id: packed like any other. Repeated rows
    are packed once each. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "windows")
    ddl = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, room, end_id), ddl).write.parquet(path)
    pieces = spark.read.parquet(path)
    histogram = np.zeros(room + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `room` rows
        histogram[row["length"]] = row["count"]
    plan = fill_gaps(best_fit_decreasing(histogram, room), int(most_padding * int(histogram @ np.arange(room + 1))))

    first, places = 0, []
    for _, items, n in plan.windows():
        offset = 0
        for v, low, a, size in items:
            places.append((v, low, low + n, first, offset, a, size))
            offset += size
        first += n
    names = ("length", "low", "high", "first", "offset", "from", "size")
    columns = zip(*places, strict=True) if places else [[]] * len(names)
    table = spark.createDataFrame(pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(names, columns, strict=True)}))
    most = int(histogram.max())
    salt = max(1, min(64, most // 50), most // SALTED_ROWS)
    ranked = numbered(pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salt)).cast("int")), "length", "salt", ["key"], "number")
    out = ranked.join(F.broadcast(table), "length").where("number >= low and number < high")
    out = out.withColumn("sequence_id", F.col("first") + F.col("number") - F.col("low")).withColumn("start", F.col("start") + F.col("from"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    was_cut = F.col("size") < F.col("length")
    cuts = any(size < v for v, *_, size in places)
    if with_ids:
        held = out.withColumn("length", F.col("size")).join(pieces.select("key", "ids"), "key")
        return held.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "from", "ids").mapInArrow(_cut, _CUT)
    if not cuts:
        return out.select(*names)
    again = out.where(was_cut).withColumn("length", F.col("size")).join(pieces.select("key", "ids"), "key")
    again = again.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "from", "ids").mapInArrow(_cut, _CUT)
    return out.where(~was_cut).select(*names).unionByName(again.select(*names))
