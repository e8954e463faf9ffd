"""The lookup cache over a stream: entries are taken once and the last of each key is kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarspark.operators.lookup_cache import latest
from cellarspark.plans.lineage import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream; a single file is read through its folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    probe = spark.read.parquet(f"{folder}/{name}.parquet").inputFiles()
    one_file = len(probe) == 1 and probe[0].endswith(f"/{name}.parquet")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one_file else reader.parquet(f"{folder}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder."""
    root = checkpoint_dir(spark)
    fresh = tempfile.mktemp(prefix=f"{name}-", dir="/")[1:]
    return f"{root}/{fresh}"


def deduplicated(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Every event once: repeats within the watermark are dropped, state older than it is let go."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def cache_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All lookups streamed into a sink, then the last entry of each key: what the cache holds after the stream."""
    entries = stream_table(spark, folder, "external_cache").withColumn("at", F.timestamp_seconds(F.coalesce("cached_at", F.lit(0.0))))
    out = work_dir(spark, "lookups")
    run = entries.select("cache_id", "cache_key", "status", "cached_at", "at").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return latest(spark.read.parquet(f"{out}/rows").drop("at"), "cache_key", "cached_at", "cache_id")


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by kind and day after a stream that lets each event through once, waiting three days for late repeats."""
    timed = stream_table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = work_dir(spark, "events")
    run = deduplicated(timed, ["event_id"], "ts", "3 days").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
