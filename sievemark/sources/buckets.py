"""Parquet tables in folders by a hash of their key, so that a few keys are read and replaced without the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a table.
BUCKETS = 64


class BucketTable:
    """A table under ``path`` whose rows lie by ``key``, which is never null, in ``buckets`` folders.

    ``read(keys)`` reads the folders of these keys alone: their numbers, ``buckets`` at
    most, are known to the driver before the scan is planned, so Spark prunes the others.
    ``replace(keys, rows)`` writes these folders anew and no other; the job puts them in
    place when all its tasks are done, so a failed job leaves the table as it was. A hot
    key's folder is written by several tasks, as Spark rebalances them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, numbers: DataFrame) -> None:
        """``rows`` become the content of the folders of ``numbers``; a row without a key keeps an emptied folder in place."""
        rows = rows.select(*self.schema.names).withColumn("_bucket", self.bucket(self.key))
        marks = numbers.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], "_bucket")
        out = rows.unionByName(marks).hint("rebalance", "_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """All rows anew, in all folders."""
        self._put(rows, self.spark.range(self.buckets).select(F.col("id").cast("int").alias("_bucket")))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("_bucket", "integer")).parquet(self.path).where(F.col(f"`{self.key}`").isNotNull())

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those whose key is in the first column of ``keys``."""
        if keys is None:
            return self._all().drop("_bucket")
        keys = keys.select(F.col(keys.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        met = [r[0] for r in keys.select(self.bucket(self.key)).distinct().collect()]  # `buckets` numbers at most
        return self._all().where(F.col("_bucket").isin(met)).drop("_bucket").join(keys, self.key, "left_semi").select(*self.schema.names)

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """The rows of these keys are ``rows`` from now on, whose keys are among them; keys without rows are gone."""
        keys = keys.select(F.col(keys.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        numbers = keys.select(self.bucket(self.key).alias("_bucket")).distinct()
        met = [r[0] for r in numbers.collect()]
        kept = self._all().where(F.col("_bucket").isin(met)).drop("_bucket").join(keys, self.key, "left_anti")
        self._put(kept.unionByName(rows.select(*self.schema.names)), numbers)
