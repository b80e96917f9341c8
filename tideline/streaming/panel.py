"""The sparse panel kept up to date from a stream: hourly means behind a watermark, then the batch fill on what is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import dense


def hourly_means(stream: DataFrame, series: str = "event_type", ts: str = "ts", value: str = "value", lateness: str = "2 hours") -> DataFrame:
    """(series, date, total, n) of each hour that the watermark has closed; exact sums, so that hours read the same as in batch."""
    timed = stream.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", lateness)
    hours = timed.groupBy(F.window("t", "1 hour").alias("w"), F.col(series).alias("series"))
    out = hours.agg(F.sum(F.col(value).cast("decimal(20,2)")).alias("total"), F.count(F.col(value)).alias("n"))
    return out.select("series", F.col("w.start").cast("timestamp_ntz").alias("date"), "total", "n")


def run_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes the closed hours of everything available to Parquet, exactly once, and returns."""
    query = hourly_means(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def panel(spark: SparkSession, path: str) -> DataFrame:
    """The dense panel of the hours written so far."""
    hours = spark.read.parquet(path).select("series", "date", (F.col("total").cast("double") / F.col("n")).alias("value"))
    return dense(hours, "hour", unfilled="drop")
