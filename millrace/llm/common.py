"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none a temporary folder is made and set. On a cluster executors
    would not see it, so there a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("millrace.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a step's rows as Parquet into the shared folder and read them back.

    This cuts the lineage: a lost executor costs the running tasks only, and a table
    that several later steps read is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many rows, of a few numbers each, is sent to every task.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if a count shows it small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of rows that go to a Python worker at once, about; a row is never cut.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES``, unless the session says otherwise.

    Spark's own bound lets a whole input partition of texts be one batch, which each task holds
    in the executor's direct memory, while its buffers double, and again in its Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, cut into slices that bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``rows`` rows and, beyond one row, about ``size`` bytes."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(rows, int(n * size / max(batch.get_total_buffer_size(), 1)) or 1))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def word_count(text: str) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
