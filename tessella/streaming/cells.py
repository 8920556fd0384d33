"""Daily cells (date, symbol, value) aggregated from a stream, appended once the watermark has passed their day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def daily_cells(events: DataFrame, symbol: str, value: str, at: str = "ts", late: str = "2 hours") -> DataFrame:
    """Sums by day and symbol; events later than `late` are left out. Works on static frames as well, where nothing is late."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp"))  # a watermark needs instants
    timed = stamped.withWatermark(at, late) if events.isStreaming else stamped
    summed = timed.groupBy(F.window(at, "1 day").alias("w"), F.col(symbol).alias("symbol")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    return summed.select(F.col("w.start").cast("date").alias("date"), "symbol", "value")
