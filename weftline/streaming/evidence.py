"""Structured Streaming versions of the evidence aggregates: growing folders, checkpoints, resume.

State is a count per key or the hashes seen within the watermark; both are bounded by the keys and
the allowed lateness, never by the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.files import append_rows, replace_table, unseen


def folder_stream(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """A growing folder of Parquet shards; files that do not match the pattern (partial ones) are not read."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def run_counts(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Counts per key over all that has arrived; after every batch the whole table replaces the last in the folder
    ``out``, so nothing is gathered on the driver. A restart resumes from the checkpoint."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: replace_table(df, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_dedup(stream: DataFrame, key: str, out: str, checkpoint: str, event_time: str, lateness: str = "1 hour") -> StreamingQuery:
    """First arrival per key, appended to Parquet; the state holds the keys within the watermark only."""
    unique = stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])
    return unique.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_resumable(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each new record once through ``work``, which keeps the key; records whose key the result holds already are
    skipped, so a batch that is run again after a failure adds nothing twice. Only the key buckets at hand are read."""

    def batch(df: DataFrame, _: int) -> None:
        append_rows(work(unseen(df, key, out).drop("key_bucket")), key, out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_windows(stream: DataFrame, at: str, key: str, width: str, lateness: str, out: str, checkpoint: str) -> StreamingQuery:
    """``windowed_counts`` appended to Parquet as windows close."""
    return windowed_counts(stream, at, key, width, lateness).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, lateness: str) -> DataFrame:
    """Counts per key and tumbling window of event time; late rows beyond the watermark are left out (an extension)."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
