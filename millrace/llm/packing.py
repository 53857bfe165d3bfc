"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter for packing, and there are at most ``size`` of them: the plan is made
on their counts, a table that the sequence size bounds whatever the corpus. One index holds
the available lengths by their sums: single ones, pairs and triples. For each length, longest
first, the gap it leaves is looked up there; combinations that fill it exactly are consumed
as often as the counts allow, which also takes them out of the index where a length is used
up. Of combinations of one kind those of the most even lengths come first, so the short
pieces, which fit anywhere, are spared. What is left is packed best fit, decreasing. The plan
is a list of patterns, each with how many sequences follow it.

Pieces then find their places by their rank among the pieces of their length. Ranks come
from counts per (length, bucket) and an order within each, so a length that holds a third
of all pieces is still dealt over all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, written
from .tokens import encoder, with_end

SIZE = 1024


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``.

    Documents longer than ``size`` are cut into pieces of ``size``, the first of which may
    be shorter. Null text is empty: the end id alone."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = with_end(*encoder(vocabulary).encode(batch.column(1)), end_id)
        total = np.diff(at)
        pieces = -(-total // size)
        row = np.repeat(np.arange(len(total)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = (total[row] - 1) % size + 1
        start = np.where(piece == 0, 0, head + (piece - 1) * size)
        length = np.where(piece == 0, head, size)
        raw = memoryview(ids.view(np.uint8))
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip((at[row] + start).tolist(), (at[row] + start + length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Available lengths by the sums of one, two and three of them.

    Counts only fall, so a combination that is gone stays gone: each sum keeps its combinations
    as a sequence that is generated once, from even ones to uneven ones, and whose head is
    dropped when a length of it is used up."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.live = [n for n, c in enumerate(counts) if n and c]
        self.heads: dict[tuple[int, int], tuple[int, ...] | None] = {}
        self.rest: dict[tuple[int, int], Iterator[tuple[int, ...]]] = {}

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """(larger, smaller), no length above ``most``, from even to uneven."""
        live, counts = self.live, self.counts
        for i in range(bisect_left(live, (total + 1) // 2), bisect_left(live, min(most, total - 1) + 1)):
            a = live[i]
            if counts[a] and counts[total - a]:
                yield a, total - a

    def _combinations(self, many: int, total: int) -> Iterator[tuple[int, ...]]:
        if many == 1:
            yield (total,)
        elif many == 2:
            yield from self._pairs(total, total)
        else:
            live, counts = self.live, self.counts
            for i in range(bisect_left(live, -(-total // 3)), bisect_left(live, total - 1)):
                if counts[a := live[i]]:
                    for pair in self._pairs(total - a, a):
                        yield a, *pair

    def _available(self, lengths: tuple[int, ...], beside: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) + (x == beside) for x in lengths)

    def fill(self, gap: int, beside: int) -> tuple[int, ...] | None:
        """Lengths that sum to ``gap``, available beside one of length ``beside``."""
        for many in (1, 2, 3):
            key = (many, gap)
            if key not in self.rest:
                self.rest[key] = self._combinations(many, gap)
                self.heads[key] = next(self.rest[key], None)
            while (head := self.heads[key]) is not None:
                if self._available(head, beside):
                    return head
                self.heads[key] = next(self.rest[key], None)
        return None


def pack_plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); every piece is in exactly one.

    Exact fills of short lengths' gaps use up short pieces that larger residuals may need.
    So the plan is made for several least lengths whose gaps are filled, and the one with
    the fewest sequences is taken, of equal ones the one that fills the most."""
    plans = [_plan(histogram, size, size * part // 8 + 1) for part in (0, 2, 4, 6, 7)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], size: int, down_to: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan whose exact fills are for gaps of lengths from ``down_to``."""
    counts = [0] * (size + 1)
    for n, c in histogram.items():
        counts[n] += c
    plan = [((size,), counts[size])] if counts[size] else []
    counts[size] = 0
    index = SumIndex(counts)
    for n in range(size - 1, down_to - 1, -1):
        while counts[n] and (fill := index.fill(size - n, n)):
            whole = (n, *fill)
            times = min(counts[x] // whole.count(x) for x in whole)
            for x in whole:
                counts[x] -= times
            plan.append((whole, times))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if gap not in open_bins:
                open_bins[gap] = []
                gaps.insert(bisect_left(gaps, gap), gap)
            open_bins[gap].append((pattern, times))

    for n in range(size - 1, 0, -1):
        while left := counts[n]:
            i = bisect_left(gaps, n)
            gap, pattern, times = size, (), left
            if i < len(gaps):
                gap = gaps[i]
                pattern, times = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap]
                    gaps.pop(i)
            each = min(gap // n, left)  # best fit goes on with the bin it has just narrowed
            used = min(times, left // each)
            put(gap - each * n, (*pattern, *[n] * each), used)
            if pattern:
                put(gap, pattern, times - used)
            counts[n] -= used * each
    return plan + [x for bins in open_bins.values() for x in bins]


class Places:
    """Where the piece of a length and rank goes: sequence and offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        at: dict[int, int] = {}
        rows, base = [], 0
        for pattern, times in plan:
            offset = 0
            for n in pattern:
                rows.append((n, at.get(n, 0), base, offset))
                at[n] = at.get(n, 0) + times
                offset += n
            base += times
        rows.sort()
        table = np.array(rows or [(0, 0, 0, 0)], np.int64)
        self.key, self.base, self.offset, self.sequences = (table[:, 0] << 48) | table[:, 1], table[:, 2], table[:, 3], base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) | rank, "right") - 1
        return self.base[i] + rank - (self.key[i] & ((1 << 48) - 1)), self.offset[i]


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    Pieces of the full size are sequences of their own. An empty table gives no rows."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = written(short.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    plan = pack_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    places = Places(plan)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # ``first`` grows with the number of buckets; the ranks need their rows dealt like this anyway
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = short.join(first.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(order) - 1)
    names = [f.name for f in pieces.schema]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
        sequence, offset = places.find(number("length"), number("rank"))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked.select(*names, "rank"), run, f"{fields}, sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and packs as its end id. Repeated rows are documents of their own.
    An empty table gives no rows. Columns other than the two named are ignored."""
    return place(written(pieces_of(docs, vocabulary, end_id, size, doc_id, text), "pieces"), size)
