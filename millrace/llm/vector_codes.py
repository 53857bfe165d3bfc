"""Product codes of integer vectors, with codebooks from rounds of integer means.

A vector's components become whole numbers and its positions are cut into consecutive parts.
Each part position has a codebook; a part's code is the index of its nearest entry.

*Segment-mean lower bounds.* For a segment of m components of x and y with means p and q and
norms r and s of what is left without the means, the squared distance is at least
m (p - q)^2 + (r - s)^2. Bounds are taken over coarse segments first, then over finer ones.
The exact distance to the entry of the least coarse bound tells which entries may still be
nearest; a margin beyond the rounding of doubles keeps the filter conservative. Only survivors
get exact integer distances, and of equal ones the lower index counts.

Each round is one pass over the table: a task adds up its parts by entry, so what it sends
is as large as the codebooks, and so is what the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Segments a part is cut into, coarse to fine.
SEGMENTS = (1, 2, 4)
_LONG = np.iinfo(np.int64)


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): each component x as floor(scale * x), at most what a long holds, of vectors
    that are not null and hold no null or non-finite component."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), v * scale))).cast("long")
    return df.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.transform(x, whole).alias("v"))


def _segments(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and norm of the rest of each row's segments that start at ``cuts``."""
    sizes = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / sizes
    rest = x - np.repeat(mean, sizes, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, cuts, axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index; exact."""
    n, width = x.shape
    peak = max((max(-int(a.min(initial=0)), int(a.max(initial=0))) for a in (x, entries)), default=0)
    if 4 * peak * peak * max(width, 1) > _LONG.max:  # whole numbers of any size, without a filter
        d = np.stack([((x.astype(object) - e.astype(object)) ** 2).sum(axis=1) for e in entries], axis=1)
        best = np.array([min(range(len(entries)), key=lambda j: row[j]) for row in d], np.int64)
        return best, d[np.arange(n), best]
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    xs, es = x.astype(float), entries.astype(float)
    row, col = np.repeat(np.arange(n), len(entries)), np.tile(np.arange(len(entries)), n)
    top = None
    for count in sorted({min(s, width) for s in SEGMENTS}):
        cuts = np.arange(count) * width // count
        sizes = np.diff(np.append(cuts, width))
        (xm, xr), (em, er) = _segments(xs, cuts), _segments(es, cuts)
        low = (sizes * (xm[row] - em[col]) ** 2 + (xr[row] - er[col]) ** 2).sum(axis=1)
        if top is None:
            guess = low.reshape(n, -1).argmin(axis=1)
            top = ((x - entries[guess]) ** 2).sum(axis=1)
            margin = 1 + 1e-7 * width * (np.abs(xs).max(initial=0) + np.abs(es).max(initial=0)) ** 2
        stays = low <= top[row] + margin
        row, col = row[stays], col[stays]
    d = ((x[row] - entries[col]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(d, starts)
    hit = np.flatnonzero(d == least[row])
    first = hit[np.searchsorted(row[hit], np.arange(n))]
    return col[first], least


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, at, n, high, low): number and sums (high * 2^32 + low) of the parts nearest to
    each entry, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((*b.shape, 2), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = _matrix(batch.column(0).slice(at, 2048))
                start = 0
                for part, book in enumerate(books):
                    own = x[:, start : start + book.shape[1]]
                    start += book.shape[1]
                    index, _ = nearest(own, book)
                    counts[part] += np.bincount(index, minlength=len(book))
                    for entry in np.unique(index):
                        mine = own[index == entry]
                        sums[part][entry, :, 0] += (mine >> 32).sum(axis=0)
                        sums[part][entry, :, 1] += (mine & 0xFFFFFFFF).sum(axis=0)
        for part, book in enumerate(books):
            entry, at = (i.ravel() for i in np.indices(book.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(book.size, part, np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[part][entry]), *(pa.array(sums[part][..., i].ravel()) for i in (0, 1))], names=["part", "entry", "at", "n", "high", "low"])

    rows = vectors.select("v").mapInArrow(run, "part int, entry int, at int, n long, high long, low long")
    return rows.groupBy("part", "entry", "at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))


def learn(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook (entries x width) for each part: the vectors of the least ids, then rounds of means.

    ``vectors`` (id, v) are of one width. Of rows with one id the least vector counts; rows
    without an id start no entry. The driver holds entries x width numbers."""
    ids = vectors.where("id is not null").select("id").distinct().orderBy("id").limit(entries)
    seeds = vectors.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    start = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), width)
    cuts = [part * width // parts for part in range(parts + 1)]
    books = [start[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)]
    for _ in range(rounds if len(start) else 0):
        found = _sums(vectors, books).where("n > 0").collect()
        for r in found:
            books[r["part"]][r["entry"], r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of vectors (id, label, v): two hex digits a part; squared distances summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                x = _matrix(rows.column(2))
                codes, error, start = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object), 0
                for part, book in enumerate(books):
                    codes[:, part], d = nearest(x[:, start : start + book.shape[1]], book)
                    error += d.astype(object)
                    start += book.shape[1]
                texts = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([min(int(e), _LONG.max) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("id", "label", "v").mapInArrow(run, f"id long, label {kind}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all numbers by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per vector: vec_id, code (two hex digits a part), error (squared distance to what the code
    stands for), label_error (errors summed over equal labels, nulls together) and codebooks_sha256.

    Vectors that are null or hold a null or non-finite component drop out, and so do those of
    another length than the one of the least id (the least vector's, where that id is repeated). Parts are equal where their number divides the
    length, else they differ by one. Of equally near entries the lower index counts. Repeated
    rows count as often as they occur, in means and sums, but start one entry only. Rows with a
    null id start none and are coded like others; with no id at all nothing is coded. With fewer
    ids than entries there are fewer entries. Sums of squares end at a long's limit. At most 256
    ``entries``. An empty table gives no rows. Other columns are ignored, whatever their names."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    vectors = whole_vectors(df, scale, id_col, vector, label)
    first = vectors.where("id is not null").orderBy("id", "v").select(F.size("v").alias("width")).head()
    vectors = vectors.where(F.size("v") == (first["width"] if first else -1))
    books = learn(vectors, first["width"], parts, entries, rounds) if first else []
    coded = written(encode(vectors, books), "codes")
    limit = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG.max).cast("decimal(38,0)")).cast("long")
    by_label = small(written(coded.groupBy(F.col("label").alias("of")).agg(limit.alias("label_error")), "label-errors"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
