"""Trends of an event stream: the batch query, and the same with watermarks as the events arrive."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def daily(events: DataFrame) -> DataFrame:
    """Events and users of each type and day."""
    return events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def windowed(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The same of a stream: days close once the watermark has passed them, users are estimated."""
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each user's runs of events with no gap of that length."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="trend-")


def streamed(schema: StructType, spark: SparkSession, path: str) -> DataFrame:
    """What :func:`windowed` has given once all files at ``path`` are read: each batch appends the windows that it
    changed to files, and the last change of a window counts."""
    where = f"{folder(spark)}/trend-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("w.start").alias("day"), "events", "users").write.mode("overwrite").parquet(f"{where}/changes/batch={number}")  # a repeated batch replaces itself

    parent, _, leaf = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(parent).withColumn("ts", F.col("ts").cast("timestamp"))
    query = windowed(source).writeStream.outputMode("update").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{where}/changes")
    last = changes.groupBy("event_type", "day").agg(F.max_by(F.struct("events", "users"), "batch").alias("v"))
    return last.select("event_type", "day", "v.*")
