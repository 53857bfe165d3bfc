"""Importance resampling: documents drawn by how much likelier their n-grams are in a target.

Features are word n-grams, hashed into buckets. A bucket's gain is the logarithm of its
smoothed share in the target over that in the documents; a document's weight is its
features' mean gain. Noise of a Gumbel distribution, made of a hash of the id, turns the
highest sums into a draw without replacement.

*Suffix arrays.* A block of a partition's texts becomes one sequence of word ids. Its suffixes
are sorted, as deep as the longest n-gram; neighbours' common prefixes (LCP) cut the order
into runs, and a run of prefixes of n words is one n-gram with all its occurrences. An n-gram is
hashed once a run, from the hash of the run of n - 1 words that holds it, and its bucket is
scattered back to the occurrences, from which documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small, written
from .shingles import _INVERSE, _LETTER, _power_tables, mix

_U = np.uint64
#: Fixed by the contract: a word is a run of digits, a-z and whatever is beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that share one suffix array.
BLOCK = 4 << 20


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row) of the words of a block of texts, in order."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    raw = _LOWER[raw]
    inside, cut = _IN_WORD[raw], np.zeros(len(raw) + 1, bool)
    cut[offsets] = True  # texts meet here
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return raw, start, end, np.searchsorted(offsets, start, "right") - 1


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each word's id within the block, told apart by 64-bit hashes, and the words by id."""
    if not len(start):
        return np.zeros(0, np.int64), []
    power, inverse = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_LETTER[raw] * power[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    data = raw.tobytes()
    return ids.astype(np.int64), [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): positions in the order of the ``depth`` words from there on, and the number of
    words that each has in common with the one before it. ``left``: words to a text's end."""
    n, rank = len(ids), ids
    for k in range(1, depth):
        after = np.zeros(n, np.int64)
        after[: n - k] = ids[k:] + 1
        rank = np.unique(rank * (int(ids.max(initial=0)) + 2) + np.where(left > k, after, 0), return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    lcp, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        same &= (left[a] > k) & (left[b] > k)
        same &= ids[np.minimum(a + k, n - 1)] == ids[np.minimum(b + k, n - 1)]
        lcp[1:] += same
    return order, lcp


def bucket_ids(column: pa.Array, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every occurrence of an n-gram in a block of texts, and the words of each row."""
    raw, start, end, row = words_of(column)
    n_words = np.bincount(row, minlength=len(column))
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    ids, words = word_ids(raw, start, end)
    left = np.cumsum(n_words)[row] - np.arange(n)
    order, lcp = suffix_array(ids, left, longest)
    spaced = [b" " + w for w in words]
    rows, found, above = [], [], None
    for k in range(1, longest + 1):
        full = left[order] >= k
        fresh = full & (lcp < k)
        run = np.cumsum(fresh) - 1  # of full positions; others have no run
        lead = np.flatnonzero(fresh)
        last_word = ids[order[lead] + k - 1].tolist()
        if above is None:
            hashes = np.fromiter((zlib.crc32(words[w]) for w in last_word), np.int64, len(lead))
        else:
            hashes = np.fromiter((zlib.crc32(spaced[w], h) for w, h in zip(last_word, above[lead].tolist(), strict=True)), np.int64, len(lead))
        above = hashes[run] if len(hashes) else np.zeros(n, np.int64)
        if k >= shortest:
            at = np.flatnonzero(full)
            rows.append(row[order[at]])
            found.append(above[at] % buckets)
    return np.concatenate(rows), np.concatenate(found), n_words


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) of all n-grams of ``texts`` (text). A task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20, BLOCK):
                total += np.bincount(bucket_ids(part.column(0), shortest, longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(total[there])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts (bucket, n) of the source and the target."""
    source, target = written(source, "source-buckets"), written(target, "target-buckets")
    sums = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n")).head()["n"] for df in (source, target)]
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    ratio = ((t + 1.0) * F.lit(sums[0] + buckets)) / ((s + 1.0) * F.lit(sums[1] + buckets))
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20, BLOCK):
                row, bucket, n_words = bucket_ids(part.column(1), shortest, longest, len(gain))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1)))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, eligible: F.Column, percent: int) -> DataFrame:
    """``scored`` with the rank (from 1) of the ``percent`` highest scores of eligible rows, else null.

    Scores are whole numbers in a range that doubles bound, so a table of their counts is small;
    a row's rank is the number of higher scores and its place among equal ones."""
    levels = written(scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    draws = (levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"] * percent) // 100
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = levels.select(F.col("score").alias("level"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before")).where(F.col("before") < draws)
    open_rows = scored.join(small(written(before, "score-ranks")), eligible & (F.col("score") == F.col("level")), "left")
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    rank = (F.col("before") + F.row_number().over(place)).cast("long")
    inside = open_rows.where("level is not null").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return open_rows.where("level is null").withColumn("rank", F.lit(None).cast("long")).unionByName(inside)


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 2, buckets: int = 10_000, seed: int = 7, least_words: int = 20, percent: int = 25, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Words are runs of ASCII letters (A-Z lower-cased) and digits and anything beyond ASCII;
    features are all runs of ``shortest`` to ``longest`` words with their repeats. The
    ``percent`` highest scores of documents of ``least_words`` words or more are drawn, ties to
    the smaller doc_id, then fewer features. Null and empty texts have no features and weight 0.
    Whole texts count, however long. Repeated rows are documents of their own: they have one
    score and follow each other in rank. A null id is hashed as the word null and comes last
    among equal scores. An empty table gives no rows; an empty target leaves gains to the
    documents' shares. Other columns are ignored, whatever their names.

    The gains, a number a bucket, are sent to every task; words within a block are told apart
    by 64-bit hashes."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = bucket_counts(docs.select("text"), shortest, longest, buckets)
    table = gains(source, bucket_counts(target.select(F.col(target_text).alias("text")), shortest, longest, buckets), buckets).collect()
    gain = np.zeros(buckets, np.int64)
    for r in table:
        gain[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed(docs, gain, shortest, longest).withColumn("score", F.col("weight") + noise), "scored")
    return _ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
