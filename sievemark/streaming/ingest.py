"""Detection over arriving passages, and running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemark.operators.detect import detect


def passages_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def detect_stream(passages: DataFrame, time_col: str, id_cols: list[str], delay: str = "10 minutes") -> DataFrame:
    """Elements of passages as they arrive; a passage that comes again within ``delay`` is met once."""
    return detect(passages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(id_cols))


def counts_by_window(elements: DataFrame, time_col: str, window: str = "5 minutes") -> DataFrame:
    """Elements per time window, type and status, late ones within the watermark included."""
    return elements.groupBy(F.window(time_col, window).alias("span"), "element_type", "validation_status").agg(F.count(F.lit(1)).alias("n"))
