"""Index tables in a shared folder: upsert, delete, rebuild.

A table is a folder of Parquet files, one sub-folder a change (``change=<n>``), each cut by
knowledge base. An upsert appends rows, a delete appends marks; a read takes the latest row
of each key, so a change costs its own rows only, a lost task is run again, and readers never
see half a change. ``rebuild`` writes the rows that count into a new folder.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session
    without one gets a temporary folder; on a cluster that would be seen by one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("millrace.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written once into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class IndexTable:
    """A table keyed by chunk_id within kb_id."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = ("kb_id", "chunk_id")):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.schema = f"{schema}, _gone boolean, change long"

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _file(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self) -> bool:
        fs, path = self._file()
        return fs.exists(path)

    def _claim(self) -> int:
        """The number of a new change. Writers claim numbers by creating a file that must not be there,
        as sure as the file system's create is; of two that write the same key the greater
        number counts. A number whose writer stopped stays unused."""
        fs, folder = self._file("/_claims")
        stored = self._stored().agg(F.max("change")).head()[0]
        claimed = [int(f.getPath().getName()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        change = max([-1 if stored is None else stored, *claimed]) + 1
        while True:
            fs, path = self._file(f"/_claims/{change}")
            try:
                fs.create(path, False).close()
                return change
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                change += 1

    def read(self) -> DataFrame:
        """The latest row of each key that has not been deleted since."""
        whole = F.struct("_gone", *self.columns)
        last = self._stored().groupBy(*(F.col(k).alias(f"_{k}") for k in self.key)).agg(F.max_by(whole, "change").alias("_row"))
        return last.where("not _row._gone").select("_row.*").drop("_gone")

    def _append(self, rows: DataFrame, gone: bool) -> None:
        rows.select(*self.columns, F.lit(gone).alias("_gone")).write.partitionBy("kb_id").parquet(f"{self.path}/change={self._claim()}")

    def upsert(self, rows: DataFrame) -> None:
        """Insert rows, or replace those of the same key. Of rows that repeat a key in one change
        one is taken, the greatest."""
        rest = [c for c in self.columns if c not in self.key]
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.key, "_r.*")
        self._append(one, gone=False)

    def delete(self, ids: DataFrame | None = None, kbs: list[str] | None = None, documents: list[int] | None = None) -> None:
        """Delete by keys (a DataFrame of them), by knowledge base, or by document."""
        rows = self.read()
        if ids is not None:
            rows = rows.join(ids.select(*self.key).distinct(), list(self.key), "left_semi")
        if kbs is not None:
            rows = rows.where(F.col("kb_id").isin(kbs))
        if documents is not None:
            rows = rows.where(F.col("document_id").isin(documents))
        if ids is None and kbs is None and documents is None:
            raise ValueError("say what to delete")
        self._append(kept(rows, "deleted"), gone=True)

    def rebuild(self, path: str) -> IndexTable:
        """A new table of the rows that count."""
        fresh = IndexTable(self.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.read().schema), self.key)
        fresh._append(self.read(), gone=False)
        return fresh


VECTORS = "kb_id string, chunk_id long, document_id long, model string, vector array<double>"
LEXICAL = "kb_id string, chunk_id long, document_id long, dl int, words array<string>"


def vector_rows(chunks: DataFrame, model: str, dim: int | None = None) -> DataFrame:
    """Rows for a table of vectors, of chunks that have them. Vectors of one knowledge base and model
    have one length: ``dim``, or else that of the first; others are an error."""
    size = F.size("vector")
    rows = chunks.select(F.col("kb_id").cast("string").alias("kb_id"), "chunk_id", "document_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = rows.withColumn("_right", F.lit(dim)) if dim else rows.join(rows.groupBy("kb_id").agg(F.min(size).alias("_right")), "kb_id")
    wrong = F.raise_error(F.concat(F.lit("vector of "), size.cast("string"), F.lit(" components in "), F.col("kb_id")))
    return rows.select("kb_id", "chunk_id", "document_id", F.lit(model).alias("model"), F.when(size == F.col("_right"), F.col("vector")).otherwise(wrong).alias("vector"))


def lexical_rows(chunks: DataFrame) -> DataFrame:
    """Rows for a lexical index: a chunk's words, lower-cased, in order."""
    return chunks.select(F.col("kb_id").cast("string").alias("kb_id"), "chunk_id", "document_id", tokens(F.col("text")).alias("words")).withColumn("dl", F.size("words"))
