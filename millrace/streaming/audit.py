"""Streams of requests: windows with a watermark, an append log, a limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import audit_action


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New files of Parquet, so many a trigger. ``path`` is a folder, or a pattern of files' names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_stats(requests: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "action") -> DataFrame:
    """(start, end, by, total, errors, mean_ms) of each window of a stream or table of (ts, action,
    status_code, duration_ms). Events later than ``late`` behind the newest are dropped by a
    stream. The sums are partial before their shuffle."""
    timed = requests.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", size, slide) if slide else F.window("_at", size)
    sums = timed.groupBy(window.alias("w"), by).agg(F.count("*").alias("total"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "total", "errors", "mean_ms")


def session_stats(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "api_key_id") -> DataFrame:
    """(key, start, end, requests): runs of a key's requests without a pause of ``gap``."""
    timed = requests.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    runs = timed.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count("*").alias("requests"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def followed(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "10 minutes", key: str = "api_key_id") -> DataFrame:
    """(key, event_id, then_id, waited_ms): requests of a stream ``first`` and those of a stream ``then`` of the same
    key, not before them and at most ``within`` after.

    Both sides have watermarks, so each side's state is what the other may still meet: a request of
    ``first`` is kept for ``within`` and the lateness, one of ``then`` for the lateness. What comes later
    than ``late`` behind the newest of its side is dropped by a stream. Null keys and times meet nothing."""
    side = lambda df, suffix: df.select(F.col(key).alias(f"_key{suffix}"), F.col("event_id").alias(f"_id{suffix}"), F.col("ts").cast("timestamp").alias(f"_at{suffix}")).withWatermark(f"_at{suffix}", late)
    near = F.expr(f"_key1 = _key2 AND _at2 >= _at1 AND _at2 <= _at1 + INTERVAL {within}")
    waited = F.floor((F.unix_micros("_at2") - F.unix_micros("_at1")) / 1000)
    return side(first, 1).join(side(then, 2), near).select(F.col("_key1").alias(key), F.col("_id1").alias("event_id"), F.col("_id2").alias("then_id"), waited.alias("waited_ms"))


def append_log(requests: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream of (request_id, ts, method, path, status_code, duration_ms) to a log, with the
    action of each; requests that are not recorded are left out. Without ``every`` the
    stream ends when all there is has been read. A restart goes on from the checkpoint."""
    rows = requests.withColumn("action", audit_action(F.col("method"), F.col("path"))).where("action is not null")
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def limited(requests: DataFrame, most: int = 120, seconds: int = 60, key: str = "api_key_id", late: str = "10 minutes") -> DataFrame:
    """(key, event_id, allowed) of a stream of requests: a request is allowed if fewer than ``most``
    of its key's allowed requests lie in the seconds before it. Refused ones don't count.

    The state of a key is the times of its last ``most`` allowed requests; what a trigger brings is
    taken in order of time. A key whose last request is out of every window is forgotten."""
    span = seconds * 1_000_000
    timed = requests.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    micros = timed.withColumn("at", F.unix_micros("ts"))

    def allow(who: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        allowed = list(state.get[0]) if state.exists else []
        new = pd.concat([p[["at", "event_id"]] for p in parts]).sort_values(["at", "event_id"])
        verdicts, oldest = [], 0
        for at in new["at"]:
            while oldest < len(allowed) and allowed[oldest] < at - span:
                oldest += 1
            verdicts.append(len(allowed) - oldest < most)
            if verdicts[-1]:
                allowed.append(int(at))
        state.update((allowed[-most:],))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, allowed[-1] // 1000 + seconds * 1000))
        yield pd.DataFrame({"key": who[0], "event_id": new["event_id"].to_numpy(), "allowed": verdicts})

    kind = requests.schema[key].dataType.simpleString()
    return micros.groupBy("key").applyInPandasWithState(allow, f"key {kind}, event_id long, allowed boolean", "times array<long>", "append", "EventTimeTimeout").withColumnRenamed("key", key)


def gathered(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read what it gave: every row in append mode, the last
    result in complete mode. ``path``: a new folder that executors share."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'last' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    found = spark.read.schema(stream.schema).option("recursiveFileLookup", "true")
    return found.parquet(f"{path}/out")
