"""Answers as a stream: windowed counts with a watermark, and a running calibration kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.lineage import ensure_checkpoint_dir


def read_events(spark: SparkSession, sf_dir: str, schema) -> DataFrame:
    """The event table as a file stream; the schema is declared, so no file is read to infer it."""
    return spark.readStream.schema(schema).parquet(sf_dir, pathGlobFilter="events.parquet")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by window and type. In append mode a window comes out once, when the newest event is more than ``late`` past
    it; its state is dropped then, and what arrives for it later is too."""
    by = F.window("ts", window)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(by, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("since"), "event_type", "n", "value")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """The result of a stream over what is there now, appended to files in the checkpoint folder, where its state is kept too."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    where = f"{spark.sparkContext.getCheckpointDir()}/stream-{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
