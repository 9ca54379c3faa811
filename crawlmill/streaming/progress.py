"""Structured Streaming over delivered files: first sightings, progress, windows, status, idempotent commits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crawlmill.operators.frontier import MAX_ATTEMPTS, TRANSITIONS
from crawlmill.functions.urls import RETRY_STATUSES


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_sightings(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once; a key is forgotten ``lateness`` after its time, which bounds the state."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events per key and tumbling window, late ones up to ``lateness`` included."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions of a key: bursts of events with no pause longer than ``gap``."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def attempt_states(stream: DataFrame, key: str) -> DataFrame:
    """State of each key after every batch of its attempts (``attempt, status_code``), kept across batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        attempt, status = state.get if state.exists else (0, 0)
        for part in batches:
            for a, s in zip(part["attempt"], part["status_code"].fillna(0)):
                if a >= attempt:
                    attempt, status = int(a), int(s)
        state.update((attempt, status))
        done = 200 <= status < 400
        again = status in RETRY_STATUSES and attempt < MAX_ATTEMPTS
        yield pd.DataFrame({key: [k[0]], "attempt": [attempt], "state": ["analysed" if done else "retry_wait" if again else "failed"]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, attempt int, state string", "attempt int, status int", "update", "NoTimeout")


def allowed_transition(before: str, after: str) -> bool:
    """Whether a crawl may change from one state to another."""
    return after in TRANSITIONS.get(before, ())


def commit_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch to its own partition, so that a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
