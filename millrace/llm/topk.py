"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer components; a component's position is its term. Queries
and candidates are packed into blocks of postings: for each term, the rows that hold it and
their weights. Each pair of a query block and a candidate block is scored by walking the
terms: every query row that holds the term adds its weight times the term's postings to a
dense score array. A term that many rows of a block hold is read as a row with zeros instead,
which needs no scatter. The k best of a query block are kept from one candidate block to the
next, so only scores that reach a query's k-th best are sorted; a ranking merges the tasks.

Every query meets every candidate. Blocks are dealt over a grid: query blocks are copied
to the grid's columns, candidate blocks to its rows. A cell holds a bounded number of
either, whatever the tables' size, and neither side is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: ``terms``: where each term's postings start, and the end; ``rows``: who holds it; ``weights``,
#: ``kinds``: the types of these two.
_BLOCK = "cell int, ids binary, terms binary, rows binary, weights binary, kinds string"
_LONG = np.iinfo(np.int64)
#: Components of a block at most, beyond one row, and blocks of candidates and queries in a cell of the grid, about.
_COMPONENTS, _CELL = 1 << 18, (8, 256)
#: A term of which a block's rows hold this share is a row with zeros.
_DENSE = 0.25


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each component x as floor(scale * x), at most what a long holds. Vectors that are null, or
    hold a null or a non-finite component, or have no id, drop out."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), v * scale))).cast("long")
    return df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if x.min(initial=0) >= np.iinfo(kind).min and x.max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _blocks(df: DataFrame, rows: int, cells: int) -> DataFrame:
    """Postings of at most ``rows`` vectors each, dealt over ``cells`` cells in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # tasks begin at different cells, spread evenly over them
        cell = int(TaskContext.get().partitionId() * 0.6180339887498949 % 1 * cells)
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * _COMPONENTS // max(1, len(batch.column(1).flatten()))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                vectors = part.column(1).take(pa.array(order))
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row = np.repeat(np.arange(len(ids)), sizes)
                there = np.flatnonzero(flat)
                by_term = there[np.argsort(term[there], kind="stable")]
                starts = np.searchsorted(term[by_term], np.arange(int(sizes.max(initial=0)) + 1))
                held, weights = _narrow(row[by_term]), _narrow(flat[by_term])
                arrays = (ids[order].astype(np.int64), starts.astype(np.int64), held, weights)
                yield pa.RecordBatch.from_arrays([pa.array([cell % cells], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays), pa.array([f"{held.dtype} {weights.dtype}"])], names=["cell", "ids", "terms", "rows", "weights", "kinds"])
                cell += 1

    return df.mapInArrow(run, _BLOCK)


Term = tuple[np.ndarray, np.ndarray] | tuple[None, np.ndarray] | None


class Block:
    """A block's ids and, for each term, who holds it and the weights; None and a weight for each
    row where many do; None where nobody does. ``largest``: the largest absolute weight of each."""

    def __init__(self, ids: bytes, terms: bytes, rows: bytes, weights: bytes, kinds: str):
        self.ids, starts = np.frombuffer(ids, np.int64), np.frombuffer(terms, np.int64)
        held, w = (np.frombuffer(x, kind) for x, kind in zip((rows, weights), kinds.split(), strict=True))
        self.terms: list[Term] = []
        self.largest: list[int] = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            self.largest.append(max(-int(w[a:b].min(initial=0)), int(w[a:b].max(initial=0))))
            if b - a < _DENSE * len(self.ids):
                self.terms.append((held[a:b].astype(np.int64), w[a:b]) if b > a else None)
            else:
                row = np.zeros(len(self.ids), w.dtype)
                row[held[a:b]] = w[a:b]
                self.terms.append((None, row))
        self.as_kind: dict[type, list[Term]] = {}

    def of_kind(self, kind: type) -> list[Term]:
        if kind not in self.as_kind:
            self.as_kind[kind] = [t and (t[0], t[1].astype(kind)) for t in self.terms]
        return self.as_kind[kind]


def _loaded(blocks: pa.Table) -> Iterator[Block]:
    for i in range(blocks.num_rows):
        yield Block(*(blocks.column(x)[i].as_py() for x in ("ids", "terms", "rows", "weights", "kinds")))


def accumulate(q: Block, c: Block) -> np.ndarray:
    """Scores of all queries against all candidates of two blocks.

    Sums that a long might not hold are made of whole numbers of any size and end at its limits."""
    bound = sum(x * y for x, y in zip(q.largest, c.largest, strict=False))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < _LONG.max else object
    scores = np.zeros((len(q.ids), len(c.ids)), kind)
    gains = np.empty_like(scores)
    for a, b in zip(q.of_kind(kind), c.of_kind(kind), strict=False):
        if a is None or b is None:
            continue
        (i, x), (j, y) = a, b
        if i is None and j is None:
            np.multiply(x[:, None], y, out=gains)
            scores += gains
        elif j is None:
            scores[i] += x[:, None] * y
        elif i is None:
            scores[:, j] += x[:, None] * y
        else:
            scores[i[:, None], j] += x[:, None] * y
    return scores if kind is not object else np.clip(scores, _LONG.min + 1, _LONG.max).astype(np.int64)


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the positions of its k best candidates, ties to the earlier, without its own row.

    Returns (query positions, candidate positions)."""
    low = np.iinfo(np.int64).min
    n = scores.shape[1]
    k = min(k, n)
    key = scores.astype(np.int64)
    key[own] = low
    part = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), key.shape)
    least = np.take_along_axis(key, part, 1).min(1)
    q, c = np.nonzero((key >= least[:, None]) & (key > low))  # all ties at the border
    order = np.lexsort((c, -key[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], c[keep]


def best_of(q: Block, candidates: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of the k best of each query of a block, ties to the smaller id."""
    low = _LONG.min
    at, ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.full(len(q.ids), low)  # what a candidate must reach
    for c in candidates:
        scores = accumulate(q, c)
        if (least == low).any():
            x, y = select(scores, q.ids[:, None] == c.ids, k)
        else:
            x, y = np.nonzero(scores >= least[:, None])
            other = q.ids[x] != c.ids[y]
            x, y = x[other], y[other]
        if not len(x):
            continue
        at, ids, best = np.r_[at, x], np.r_[ids, c.ids[y]], np.r_[best, scores[x, y].astype(np.int64)]
        order = np.lexsort((ids, -best, at))
        at, ids, best = at[order], ids[order], best[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == k - 1
        least[at[last]] = best[last]
        at, ids, best = at[place < k], ids[place < k], best[place < k]
    return q.ids[at], ids, best


def _grid(vectors: DataFrame, queries: DataFrame, query_rows: int, block_rows: int) -> tuple[int, int]:
    """(columns, rows) of the grid: cells of a bounded number of blocks, and enough of them for all cores."""
    sizes = [df.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).head() for df in (vectors, queries)]
    blocks = [max(1, math.ceil(n / rows), math.ceil(total / most)) for (n, total), rows, most in zip(sizes, (block_rows, query_rows), (_COMPONENTS, _COMPONENTS // 64), strict=True)]
    wanted = 8 * vectors.sparkSession.sparkContext.defaultParallelism
    across = max(math.ceil(blocks[0] / _CELL[0]), min(blocks[0], wanted))
    return across, max(math.ceil(blocks[1] / _CELL[1]), min(blocks[1], wanted // across))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = 64, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products over all rows of
    ``vectors`` but the one with its own id; ties go to the smaller id.

    Both inputs come from :func:`integer_vectors`. Vectors of unequal length count zeros
    beyond their end. Rows repeated under one id are one candidate each, but never
    candidates of a query with that id; of queries with one id the least vector counts. A
    query with fewer than k candidates returns all of them, an empty table nothing. Scores
    end at the limits of a long. Columns other than id and v are ignored, whatever their names.
    """
    vectors = written(vectors.select("id", "v"), "vectors")
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    across, down = _grid(vectors, queries, query_rows, block_rows)
    q = _blocks(queries, query_rows, down).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    c = _blocks(vectors, block_rows, across).withColumnRenamed("cell", "column").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        candidates = list(_loaded(right)) if left.num_rows else []
        found = [best_of(x, candidates, k) for x in _loaded(left)] if candidates else []
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    best = q.groupBy("cell", "column").cogroup(c.groupBy("cell", "column")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
