"""Incremental intake: deliveries as a stream, kept as the latest row of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troupe.operators.facts import latest_by


def deliveries(spark: SparkSession, path: str, schema) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """Each delivery of a key once, as long as it isn't later than the watermark; the state of older keys is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = 16):
    """A query that keeps the latest row of every key in a folder of parquet tables, one version per micro-batch. A batch reads the
    last version, adds its rows and writes the next one, so that a batch that is run again gives the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{target}/version={number - 1}").unionByName(batch)
        latest_by(rows, keys, order).repartition(buckets, *keys).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per window and group; late events within the delay still count."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
