"""Structured Streaming ingest: a watched folder of messages feeds an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.sources.mail import gated

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingest new .eml files of a folder batch by batch; a replayed batch changes nothing."""
    files = engine.spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").endswith(".eml"))

    def put(batch: DataFrame, _id: int) -> None:
        engine._ingest(gated(batch))

    w = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def event_counts(spark: SparkSession, folder: str, schema: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums of a stream of events per window and type, with a watermark for late ones."""
    e = spark.readStream.schema(schema).parquet(folder)
    return e.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
