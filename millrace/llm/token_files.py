"""Token ids in binary files: patched frame-of-reference blocks.

A document is one frame. Its ids are cut into blocks of 128. A block stores its minimum,
the differences from it packed at a width that 90% of them fit, and for the others an
exception list of positions and high bits. Each frame indexes where its blocks start, so a
block can be read without those before it.

Frame, little-endian: ``MPF1``, flags u8 (1: null id), doc id i64, number of ids u64,
number of blocks u32, block starts u32 each and the end, counted from the first block,
blocks, line feed. Block: minimum u32, width u8, exceptions u8, packed differences
(16 * width bytes), positions u8 each, high bits u32 each. The last block is filled up with
its minimum.

Documents are dealt over files by quantiles of their ids, weighted by the size of their texts,
and sorted in them, so the files in order hold the documents in order of id and about
``FILE_BYTES`` of text each: one shuffle, of packed frames. Documents of one id that is spread
over several quantiles are dealt over all their files. Files are written and read through
Spark, thus in any store, and a repeated task replaces its file.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, written
from .tokens import encoder, with_end

BLOCK = 128
_HEAD = struct.Struct("<4sBqQI")
_MAGIC = b"MPF1"
FRAMES_PER_FILE = 20_000
#: A file is read as one value, so it must stay well below 2 GB.
FILE_BYTES = 128 << 20
_WEIGHT = 64 << 10


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def encode_frames(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], percentile: float = 0.9) -> list[bytes]:
    """One frame per document, whose ids lie between its start and the next; all blocks are
    packed together, width by width."""
    lengths = np.diff(starts)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    first = np.cumsum(np.r_[0, blocks])
    wide = np.zeros((total, BLOCK), np.int64)
    slot = np.repeat(first[:-1] * BLOCK, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = wide.reshape(-1)
    flat[slot] = ids
    used = np.zeros(total * BLOCK, bool)
    used[slot] = True
    used = used.reshape(total, BLOCK)
    low = np.where(used, wide, np.iinfo(np.int64).max).min(1) if total else np.zeros(0, np.int64)
    delta = np.where(used, wide - low[:, None], 0)
    width = _bit_length(np.sort(delta, 1)[:, int(BLOCK * percentile)]) if total else low
    high = delta >> width[:, None]
    b, pos = np.nonzero(high)
    n_exc = np.bincount(b, minlength=total)
    size = 6 + 16 * width + 5 * n_exc
    at = np.cumsum(np.r_[0, size])
    buffer = np.zeros(int(at[-1]), np.uint8)
    start = at[:-1]
    buffer[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    buffer[start + 4], buffer[start + 5] = width, n_exc
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = ((delta[rows][:, :, None] >> np.arange(w)) & 1).astype(np.uint8).reshape(len(rows), -1)
        buffer[start[rows][:, None] + 6 + np.arange(16 * w)] = np.packbits(bits, 1, "little")
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    body = start[b] + 6 + 16 * width[b]
    buffer[body + nth] = pos
    buffer[(body + n_exc[b] + 4 * nth)[:, None] + np.arange(4)] = high[b, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    raw, out = buffer.tobytes(), []
    for i, d in enumerate(doc_ids):
        a, z = int(first[i]), int(first[i + 1])
        starts = (at[a : z + 1] - at[a]).astype("<u4").tobytes()
        out.append(_HEAD.pack(_MAGIC, d is None, d or 0, int(lengths[i]), z - a) + starts + raw[at[a] : at[z]])
    return out


def decode_frames(raw: bytes, blocks: int = 4096) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, token ids, starts) of a file's frames in order, about so many blocks at
    a time, so memory doesn't grow with the file."""
    data = np.frombuffer(raw, np.uint8)
    pos = 0
    while pos < len(raw):
        doc_ids, lengths, counts, starts, n_blocks = [], [], [], [], 0
        while pos < len(raw) and n_blocks < blocks:
            magic, flags, d, n, k = _HEAD.unpack_from(raw, pos)
            if magic != _MAGIC:
                raise ValueError(f"no frame at byte {pos}")
            at = np.frombuffer(raw, "<u4", k + 1, pos + _HEAD.size).astype(np.int64)
            body = pos + _HEAD.size + 4 * (k + 1)
            doc_ids.append(None if flags & 1 else d)
            lengths.append(n)
            counts.append(k)
            starts.append(body + at[:-1])
            pos = body + int(at[-1]) + 1
            n_blocks += k
        lengths, used = np.array(lengths, np.int64), np.array(counts, np.int64) * BLOCK
        inside = np.arange(int(used.sum())) - np.repeat(np.cumsum(used) - used, used) < np.repeat(lengths, used)
        yield doc_ids, _unpack(data, np.concatenate(starts)).reshape(-1)[inside], np.concatenate([[0], np.cumsum(lengths)])


def _unpack(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The 128 ids of each block that starts at one of the places."""
    low = data[start[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
    width, n_exc = data[start + 4].astype(np.int64), data[start + 5].astype(np.int64)
    wide = np.zeros((len(start), BLOCK), np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(data[start[rows][:, None] + 6 + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        value = bits[:, :, w - 1].astype(np.int64)
        for bit in range(w - 2, -1, -1):
            value = (value << 1) | bits[:, :, bit]
        wide[rows] = value
    b = np.repeat(np.arange(len(start)), n_exc)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    body = start[b] + 6 + 16 * width[b]
    high = data[(body + n_exc[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
    wide[b, data[body + nth]] |= high << width[b]
    return (wide + low[:, None]).astype("<u4")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, write the files under ``path``.

    Null text is empty: the end id alone. Null ids come first. Rows with one id, in one or
    several files, follow each other in any order. Long texts are one frame. Other columns are
    ignored, whatever their names. An empty table writes no frame."""
    spark = docs.sparkSession
    # a document counts once, and once more for each 64 KB of its text
    weight = F.expr(f"1 + coalesce(octet_length({text}), 0) div {_WEIGHT}")
    weighed = docs.select(F.col(doc_id).cast("long").alias("id"), weight.cast("int").alias("weight"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((docs.agg(F.sum(F.expr(f"octet_length({text})"))).head()[0] or 0) / FILE_BYTES))
    cuts = weighed.select("id", F.explode(F.array_repeat(F.lit(0), F.col("weight")))).agg(F.percentile_approx("id", [i / files for i in range(1, files)], 100 * files)).head()[0] or []
    cuts = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in (part for whole in batches for part in slices(whole)):
            ids, starts = with_end(*encoder(vocabulary).encode(batch.column(1)), end_id)
            keys = batch.column(0).to_pylist()
            flat = np.array([np.iinfo(np.int64).min if k is None else k for k in keys], np.int64)
            # an id between equal cuts may go to any of the files they bound
            first, last = np.searchsorted(cuts, flat, "left"), np.searchsorted(cuts, flat, "right")
            part = first + (n + np.arange(len(flat))) % (last - first + 1)
            n += len(flat)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(keys, pa.int64()), pa.array(encode_frames(ids, starts, keys), pa.binary())], names=["part", "doc_id", "frame"])

    frames = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "part int, doc_id long, frame binary")
    dealt = frames.repartitionById(files, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.select(F.col("frame").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``.

    ``start`` counts the ids of all documents before it: those in its file are summed as
    the file is read, those in earlier files from one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, before = batch.column(0)[i].as_py(), 0
                for keys, ids, at in decode_frames(batch.column(1)[i].as_py()):
                    raw = memoryview(ids.view(np.uint8))
                    crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(before + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["file", "doc_id", "local", "n_tokens", "ids_crc32"])
                    before += int(at[-1])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = written(content.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids_crc32 long"), "read-ids")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids"), F.min(F.coalesce(F.struct(F.col("doc_id").isNotNull(), "doc_id"))).alias("least"))
    before = Window.orderBy("least", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the token files (into the shared folder unless ``path`` is given) and read them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
