"""Ingest: files of a folder to chunks to index tables, with the status of every document.

A file source finds new files; each trigger parses, chunks and indexes its files as one
Spark job a step. Status rows are appended: ``processing`` before a trigger's work, then
``completed`` or ``failed`` by document. The last row of a document is its status; one whose
last row is ``processing`` was interrupted, and is taken up again with its trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import get
from ..sources.parsers import parse_files
from ..sources.tables import IndexTable, kept, lexical_rows

STATUS = "document_id long, path string, batch long, step int, status string, n_chunks long, error string"


def document_id(path: F.Column) -> F.Column:
    return F.xxhash64(path)


def ingest(spark: SparkSession, folder: str, index: IndexTable, status: str, checkpoint: str, kb_id: str, chunker: str = "recursive", every: str | None = None, files_per_trigger: int = 1000, **params) -> StreamingQuery:
    """Index every file of ``folder`` (and of its sub-folders) under ``kb_id``. Without ``every``
    the stream ends when all there is has been read. A trigger that is run again replaces
    its own chunks and status rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def work(batch: DataFrame, number: int) -> None:
        def say(rows: DataFrame, step: int) -> None:
            rows.write.mode("overwrite").parquet(f"{status}/batch={number}/step={step}")

        names = batch.select("path")
        say(names.select(document_id(F.col("path")).alias("document_id"), "path", F.lit("processing").alias("status"), F.lit(None).cast("long").alias("n_chunks"), F.lit(None).cast("string").alias("error")), 0)
        parsed = kept(parse_files(batch).withColumn("document_id", document_id(F.col("path"))), "parsed")
        docs = parsed.where("error is null and length(content) > 0").select("document_id", "path", F.col("content").alias("text"))
        chunks = kept(get("chunker", chunker)(docs, **params), "chunks")
        rows = chunks.select(F.lit(kb_id).alias("kb_id"), F.xxhash64("document_id", "chunk_index").alias("chunk_id"), "document_id", "text")
        index.upsert(lexical_rows(rows).select(*index.columns))
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
        done = parsed.join(counts, "document_id", "left").select("document_id", "path", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "error")
        say(done, 1)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def document_status(spark: SparkSession, status: str) -> DataFrame:
    """(document_id, path, status, n_chunks, error): the last word on each document; one that is
    still processing counts as interrupted."""
    rows = spark.read.schema(STATUS).parquet(status)
    last = rows.groupBy("document_id").agg(F.max_by(F.struct("path", "status", "n_chunks", "error"), F.struct("batch", "step")).alias("r"))
    named = F.when(F.col("r.status") == "processing", "interrupted").otherwise(F.col("r.status"))
    return last.select("document_id", "r.path", named.alias("status"), "r.n_chunks", "r.error")


def retry_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(success, failed, skipped) of retried chunks (ok, retry_count before the attempt): a failure
    that was the last allowed is skipped from then on."""
    spent = F.col("retry_count") + 1 >= most
    return attempts.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok") & ~spent).alias("failed"), F.count_if(~F.col("ok") & spent).alias("skipped"))
