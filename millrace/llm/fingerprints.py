"""SimHash fingerprints: weighted term hashes vote on signed bits.

Terms are words (weight 1) and pairs of neighbouring words (weight 2), A-Z lower-cased,
each as often as it occurs. Every term's 64-bit hash votes with its weight for or against
each bit. Texts without words have fingerprint 0.

All fingerprints within a Hamming radius are found by permuted block tables: the bits are
cut into blocks, and for every choice of blocks that a pair within the radius must leave
untouched there is a table keyed by those blocks; only fingerprints that meet in a table
are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import _BASE, mix, words_of

_U = np.uint64
BITS = 64


def _votes(h: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """For each row and bit: ayes less noes of the hashes; ``doc`` ascends."""
    out = np.zeros((rows, BITS), np.int64)
    if len(h):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ayes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[doc[starts]] = 2 * ayes - np.diff(np.r_[starts, len(h)])[:, None]
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    w = words_of(column)
    votes = _votes(mix(w.hash), w.doc, w.rows)
    if len(w.hash) > 1:
        inside = w.doc[1:] == w.doc[:-1]
        pairs = mix(w.hash[:-1] * _U(_BASE) + w.hash[1:])[inside]
        votes += 2 * _votes(pairs, w.doc[1:][inside], w.rows)
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").reshape(-1).astype(_U)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    x = (a ^ b).astype("<u8").view(np.uint8).reshape(-1, 8)
    return 1 - np.unpackbits(x, axis=1).sum(1) / BITS


def in_chain(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Rows (part, key, doc_id, text, border) dealt so that, within a part, each row's next in
    descending id stands after it; ``border`` rows only close their part.

    Parts are ranges of ids between quantiles. The first document of each part is copied to
    the part before it, that of the first part to the last, so texts are shuffled once and
    no order over all documents is made in one place. What the driver sees is two numbers a
    part."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = keyed.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).head()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    heads = {r["part"]: r["head"] for r in keyed.select(part.alias("part"), "key").groupBy("part").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # for the first part that is the last
    copies = F.create_map(*(F.lit(x) for k, p in before.items() for x in (k, p))) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    second = F.element_at(copies, F.col("key"))
    places = F.filter(F.array(F.struct(part.alias("part"), F.lit(False).alias("border")), F.struct(second.alias("part"), F.lit(True).alias("border"))), lambda x: x["part"].isNotNull())
    rows = keyed.select("*", F.explode(places).alias("p")).select(F.col("p.part").alias("part"), F.col("p.border").alias("border"), "key", "doc_id", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "border", F.desc("key"), F.xxhash64("text")), parts


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex
    digits), near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's, in descending doc_id, after the last the first.
    Null text is empty; null ids come last; rows of one id follow each other in the order of
    a hash of their texts. The only document is its own next. Long texts count whole. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows, _ = in_chain(docs, doc_id, text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(ids: list, texts: list[str], prints: np.ndarray, follow: list[str], follow_prints: np.ndarray) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, follow, strict=True)]
        other = fingerprints(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa_kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([f"{int(x):016x}" for x in prints]), pa.array([f"{int(x):016x}" for x in other]), pa.array(likeness(prints, other)), pa.array(likeness(prints, follow_prints)),
            ],
            names=names,
        )

    pa_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept = None  # the last row so far: part, id, text, fingerprint, position; its next has not come
        for batch in batches:
            for piece in slices(batch, 2048, 1 << 19):
                part, border, ids, texts = (piece.column(c).to_pylist() for c in ("part", "border", "doc_id", "text"))
                prints = fingerprints(piece.column("text"))
                out_i, out_n = [], []  # positions of rows and of their next; -1 is the held row
                for i in range(len(ids)):
                    if held is not None and held[0] == part[i]:
                        out_i.append(held[4])
                        out_n.append(i)
                    held = None if border[i] else (part[i], ids[i], texts[i], prints[i], i)
                if out_i:
                    at = lambda xs, old, k: [old if i < 0 else xs[i] for i in k]
                    yield results(at(ids, kept and kept[1], out_i), at(texts, kept and kept[2], out_i), np.array(at(prints, kept and kept[3], out_i), _U), [texts[i] for i in out_n], prints[out_n])
                held = held and (*held[:4], -1)
                kept = held

        # every part ends with a border row, so nothing is left

    return rows.select("part", "border", "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int | None = None, column: str = "fingerprint") -> DataFrame:
    """(a, b, distance) of all distinct fingerprints (longs) a < b at most ``radius`` bits apart.

    Equal fingerprints are one. Nulls drop out. Of a pair that meets in several tables, the
    first table reports it, so no duplicates are made and none need a shuffle."""
    blocks = blocks or 2 * radius
    blocks = max(blocks, radius + 1)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        m = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept)
        masks.append(m - (1 << 64) if m >> 63 else m)
    one = prints.select(F.col(column).cast("long").alias("x")).where("x is not null").distinct()
    table = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks))))
    rows = one.select("x", table.alias("k")).select("x", F.col("k.t").alias("t"), F.col("x").bitwiseAND(F.col("k.m")).alias("key"))
    pairs = rows.withColumnRenamed("x", "a").join(rows.withColumnRenamed("x", "b"), ["t", "key"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.least(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks))) if len(masks) > 1 else F.lit(0)
    return pairs.select("a", "b", "t", F.bit_count(differ).alias("distance"), first.alias("first")).where((F.col("distance") <= radius) & (F.col("t") == F.col("first"))).select("a", "b", "distance")
