"""Structured Streaming jobs. The column code is the batch code; only sources, state and sinks differ."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators import labeling
from riskweave.sources.files import parse_messages

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB: it may outgrow the heap, and timers need it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over what has arrived, appends its rows to Parquet files in ``out`` and stops. Called again with the
    same checkpoint it goes on where it stopped; nothing is taken twice or written twice."""
    with keyed_state(stream.sparkSession):
        started = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    started.awaitTermination()  # raises what the stream raised


def stream_messages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON-lines files as messages; malformed lines drop out."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def stream_label(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Labels whatever has arrived and stops; a restart continues after the last file. Stateless, exactly once."""
    labelled = labeling.label_spans(messages.drop("spans", "labels"))
    kept = labelled.select("msg_id", "channel", "spans", "labels")
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_dedup_results(results: DataFrame, key: str = "custom_id", ts: str = "ts", delay: str = "24 hours") -> DataFrame:
    """Each result once. State is kept for the delay only."""
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_throughput(events: DataFrame, ts: str = "ts", delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Records, active and completed counts per hour."""
    timed = events.withWatermark(ts, delay) if events.isStreaming else events
    return (
        timed.groupBy(F.window(ts, width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "in_progress").alias("active"),
            F.count_if(F.col("status") == "completed").alias("completed"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "active", "completed")
    )
