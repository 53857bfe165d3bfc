"""Near duplicates by MinHash, with sequential Bayesian verification of candidates.

Documents with one shingle set are one set. A set's signature holds the least value of each of
``BANDS * ROWS`` hash functions over its shingles; sets that agree in all values of a band share
that band's bucket and are candidates.

*Sequential verification.* Signatures of a pair are compared batch by batch. After n values of
which m agree, the similarity has, from a uniform prior, a Beta(m + 1, n - m + 1) posterior; a pair
goes as soon as its chance to reach the threshold is below ``MISS``. What survives all batches
is verified on whole shingle sets.

*Buckets without all their pairs.* Sets of a bucket are compared with a hub, the one of them that
shares most buckets with others, so that families of copies of one text take one comparison a
copy; links merge components. A second round takes a hub among the sets outside the first
hub's component. In buckets that still hold several components, sets outside the first hub's
are paired with all others where that makes at most ``PAIRED`` pairs. Larger ones take an exact
way: their sets are described by how they differ from one of the hubs of their hub's component,
and only those with enough common differences become candidates. All of these pass the same sequential and exact verification. No
bucket is capped.

A pair at the threshold has none of the bands with a chance of (1 - t^ROWS)^BANDS: for 0.85, 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .jaccard_join import Scheme, differing_pairs, joined, named_components, set_ids, shingle_arrays, shingled, similar
from .shingles import _BASE, Sets, mix, shingle_sets

_U = np.uint64
ROWS, BANDS = 7, 36
#: Signature values that are compared before the next look at the posterior.
BATCH = 28
#: The chance of being similar below which a pair is given up.
MISS = 1e-6
#: Buckets with up to so many pairs left after the hub rounds list them.
PAIRED = 256
_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=_U)) | _U(1)


def signatures(s: Sets, rows: np.ndarray) -> np.ndarray:
    """The least of each hash function (rows x functions) over the sets of ``rows``, none empty."""
    take = np.zeros(len(s.count), bool)
    take[rows] = True
    x = s.hash[take[s.doc]]
    starts = np.cumsum(s.count[rows]) - s.count[rows]
    out, buffer = np.empty((len(rows), len(_FACTORS)), np.uint32), np.empty_like(x)
    for k, factor in enumerate(_FACTORS):
        np.multiply(x, factor, out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts) >> _U(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets x BANDS) hashes of each band's values."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(_U)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), values.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix(keys * _U(_BASE) + values[:, :, i])
    return keys.view(np.int64)


def least_matches(percent: int) -> np.ndarray:
    """For each number n of compared values, the fewest matches with which a pair stays.

    Of a Beta(m + 1, n - m + 1), the part above t is the chance of at most m hits in n + 1 trials of t."""
    t, out = percent / 100, []
    for n in range(len(_FACTORS) + 1):
        chance, m = 0.0, -1
        while chance < MISS and m < n:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def passing(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the pairs (rows of a and b) that no batch gives up."""
    least, left, matches = least_matches(percent), np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], BATCH):
        end = min(at + BATCH, a.shape[1])
        matches = matches + (a[left, at:end] == b[left, at:end]).sum(axis=1)
        stays = matches >= least[end]
        left, matches = left[stays], matches[stays]
    return left


def _signed(docs: DataFrame, size: int, least: int) -> DataFrame:
    """(set_id, n, signature, keys) of each set that is large enough to have a similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096, 1 << 19):
                s = shingle_sets(part.column(0), size)
                ids = set_ids(s)
                _, first = np.unique(ids, return_index=True)
                rows = np.sort(first[s.count[first] > least])
                if not len(rows):
                    continue
                signature = signatures(s, rows)
                keys = band_keys(signature)
                short = (signature ^ (signature >> np.uint32(16))).astype(np.uint16)  # enough to tell values apart
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(s.count[rows].astype(np.int32)), pa.array([x.tobytes() for x in short], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["set_id", "n", "signature", "keys"])

    return docs.select("text").mapInArrow(run, "set_id long, n int, signature binary, keys array<long>")


def _sequential(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of the (a, b) that the posterior doesn't give up, each once."""
    ends = [signed.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"of_{x}")) for x in ("a", "b")]
    both = pairs.select("a", "b").where("a <> b").distinct().join(ends[0], "a").join(ends[1], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = [np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:]]
                left = pa.array(passing(*of, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(left), batch.column(1).take(left)], names=["a", "b"])

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _hubs(rows: DataFrame) -> DataFrame:
    """(key, hub): of each bucket's sets the one that shares most buckets with others."""
    weight = rows.groupBy("key").agg(F.count("*").alias("k"))
    central = written(rows.join(weight, "key").groupBy("set_id").agg(F.sum("k").alias("central")), "central")
    return written(rows.join(central, "set_id").groupBy("key").agg(F.max_by("set_id", F.struct("central", "set_id")).alias("hub")), "hubs")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The (key, set_id, root) of buckets that hold several components."""
    rows = rows.select("key", "set_id").join(labels, "set_id")
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return written(rows.join(written(several, "open-keys"), "key").select("key", "set_id", "root"), "open-buckets")


def _beside(rows: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with their bucket's hub, and whether they are outside its component."""
    roots = labels.select(F.col("set_id").alias("hub"), F.col("root").alias("hub_root"))
    return rows.join(written(hubs.join(roots, "hub"), "hub-roots"), "key").withColumn("outside", F.col("root") != F.col("hub_root"))


def _rest(rows: DataFrame, hubs: DataFrame, arrays: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among sets of different components of open buckets, other than with hubs."""
    dealt = written(_beside(rows, hubs, labels).select("key", "set_id", "root", "hub", "hub_root", "outside"), "rest")
    few = (F.count_if("outside") * F.count("*") <= PAIRED).alias("few")
    dealt = dealt.join(written(dealt.groupBy("key").agg(few), "bucket-sizes"), "key")
    ends = [dealt.where("few").select("key", F.col("set_id").alias(x), F.col("root").alias(f"root_{x}"), F.col("outside").alias(f"outside_{x}")) for x in ("a", "b")]
    pairs = ends[0].where("outside_a").join(ends[1], "key").where("root_a <> root_b and (a < b or not outside_b)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # hubs of one component are one group, described from the hub of most buckets
    large = written(dealt.where("not few").groupBy("set_id", "hub", "hub_root").agg(F.count("*").alias("c")), "large")
    named = large.groupBy("hub_root", "hub").agg(F.sum("c").alias("c")).groupBy("hub_root").agg(F.max_by("hub", F.struct("c", "hub")).alias("grp"))
    opened = large.select("set_id", "hub_root").distinct().join(written(named, "group-hubs"), "hub_root").select("set_id", "grp", F.lit(True).alias("home"))
    return pairs.unionByName(differing_pairs(opened, arrays, labels, percent))


def linked(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, root) of all sets that share a bucket with another."""
    signed = written(_signed(docs, size, int(Scheme(percent).bounds[0])).dropDuplicates(["set_id"]), "signatures")
    keys = signed.select(F.explode("keys").alias("key"), "set_id")
    shared = written(keys.groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("key"), "shared-keys")
    rows = written(keys.join(shared, "key"), "buckets")
    ids = written(rows.select("set_id").distinct(), "in-buckets")
    signed = written(signed.drop("keys").join(ids, "set_id"), "candidates-signed")
    arrays = shingle_arrays(docs, sets, ids, size)
    labels = ids.select("set_id", F.col("set_id").alias("root"))

    def merged(pairs: DataFrame) -> DataFrame:
        return joined(labels, similar(written(_sequential(pairs, signed, percent), "candidates"), arrays, percent))

    def with_hubs(hubs: DataFrame) -> DataFrame:
        return _beside(rows, hubs, labels).where("outside").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))

    rows = _open(rows, labels)
    hubs = _hubs(rows)
    labels = merged(with_hubs(hubs))
    rows = _open(rows, labels)
    if rows.isEmpty():
        return labels
    others = _hubs(_beside(rows, hubs, labels).where("outside").select("key", "set_id"))
    labels = merged(with_hubs(others))
    rows = _open(rows, labels)
    if rows.isEmpty():
        return labels
    return merged(_rest(rows, hubs, arrays, labels, percent))


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct
    ``size``-word shingles (words: runs of anything but ASCII white space, A-Z lower-cased;
    fewer words than ``size`` are one shingle). Links are confirmed on whole sets. Null, empty
    and blank texts have an empty set, no link, and are their own component. Repeated rows are
    copies of each other; rows with a null id take part like any other, but a null can't name
    a component, and ``kept`` (doc_id = component_id) is null for them. Whole texts count,
    however long. Other columns are ignored, whatever their names. An empty table gives no rows.

    A link is lost only if its pair shares no band, or is given up by its signatures."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = written(shingled(docs, size), "sets")
    found = named_components(sets, linked(docs, sets, size, percent))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
