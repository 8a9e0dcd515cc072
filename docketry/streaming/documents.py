"""Streams of documents (an extension): files as they arrive, each text once, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_tables(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(folder)


def once(stream: DataFrame, text_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each text within the watermark's delay; state older than that is dropped."""
    keyed = stream.withColumn("sha", F.sha2(F.col(text_col), 256)).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["sha"])


def windowed_counts(stream: DataFrame, time_col: str, by: list[str], window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per window and key; late rows within the delay still count."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    counted = stream.withWatermark(time_col, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; files are written exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
