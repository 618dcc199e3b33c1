"""Originals by the hash of their content, and the tables of runs, of which a whole run is replaced at once."""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import Scratch


class ContentStore:
    """Originals under ``path``, in folders by the first two digits of their SHA-256."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _all(self) -> DataFrame:
        return self.spark.read.schema("sha256 string, size long, content binary, shard string").option("basePath", self.path).parquet(self.path)

    @staticmethod
    def shard(sha256: Column | str) -> Column:
        return F.substring(sha256, 1, 2)

    def _held(self, wanted: DataFrame) -> DataFrame:
        """Rows of the folders in which the hashes of ``wanted`` lie: 256 at most, so the driver names them before the scan."""
        shards = [r[0] for r in wanted.select(self.shard("sha256")).distinct().collect()]
        try:
            return self._all().where(F.col("shard").isin(shards))
        except AnalysisException:  # nothing stored yet
            return self.spark.createDataFrame([], "sha256 string, size long, content binary, shard string")

    def put(self, files: DataFrame, content_col: str = "content", key: str = "path") -> DataFrame:
        """Stores each content that is not there, once; returns ``(key, sha256, stored)``, ``stored`` marking the row whose content was written.

        ``key`` tells rows apart. Of equal contents in one batch the row with the least key is
        written. Contents are read to be hashed; only those that are new are moved. Hashes
        held are read from the folders of the batch's own hashes, without contents. A
        batch put twice adds nothing; a failed write leaves nothing behind. A null content
        has a null hash and is not stored; an empty one is; an empty batch gives no rows.
        """
        scratch = Scratch(self.spark)
        hashed = scratch.keep(files.select(key, F.sha2(F.col(content_col), 256).alias("sha256")), "store-hashed")
        known = self._held(hashed).select("sha256")
        first = hashed.where("sha256 is not null").groupBy("sha256").agg(F.min(key).alias(key)).join(known, "sha256", "left_anti")
        first = scratch.keep(first, "store-first")
        new = files.select(key, F.col(content_col).alias("content")).join(first, key)
        rows = new.select("sha256", F.octet_length("content").cast("long").alias("size"), "content", self.shard("sha256").alias("shard"))
        if not first.isEmpty():
            rows.hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)
        marked = first.select(key, F.lit(True).alias("stored"))
        return hashed.join(marked, key, "left").withColumn("stored", F.coalesce("stored", F.lit(False)))

    def get(self, wanted: DataFrame) -> DataFrame:
        """``(sha256, size, content)`` of the hashes in ``wanted (sha256)`` that are held, each once, from their folders alone."""
        wanted = wanted.select("sha256").where("sha256 is not null").distinct()
        return self._held(wanted).join(wanted, "sha256", "left_semi").select("sha256", "size", "content").dropDuplicates(["sha256"])

    def damaged(self) -> DataFrame:
        """Hashes of rows whose content is not theirs; must be empty."""
        return self._all().where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


class RunStore:
    """Tables of runs under ``path``: a run is written whole as an attempt, and one small append makes it the one that is read.

    Until that append the run before it is read, whatever fails, and all its tables
    change together. Attempts are never written again, so a reader is not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, table: str, run_id: str, attempt: str) -> str:
        return f"{self.path}/{quote(table, safe='')}/run_id={quote(run_id, safe='')}/attempt={attempt}"

    def _attempts(self) -> DataFrame:
        try:
            return self.spark.read.schema("run_id string, attempt string, tables array<string>, at long").parquet(f"{self.path}/attempts")
        except AnalysisException:  # no run yet
            return self.spark.createDataFrame([], "run_id string, attempt string, tables array<string>, at long")

    def runs(self) -> DataFrame:
        """``(run_id, attempt, tables, at)`` of the attempt that each run is read from."""
        return self._attempts().groupBy("run_id").agg(F.max_by(F.struct("attempt", "tables", "at"), F.struct("at", "attempt")).alias("m")).select("run_id", "m.*")

    def replace(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        """The run's tables are these from now on; then what older attempts left is deleted."""
        attempt = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(self._place(name, run_id, attempt))
        last = self._attempts().where(F.col("run_id") == run_id).agg(F.max("at")).first()[0] or 0
        done = [(run_id, attempt, sorted(tables), max(time.time_ns(), last + 1))]
        self.spark.createDataFrame(done, "run_id string, attempt string, tables array<string>, at long").coalesce(1).write.mode("append").parquet(f"{self.path}/attempts")
        for row in self._attempts().where((F.col("run_id") == run_id) & (F.col("attempt") != attempt)).collect():  # a run's own attempts
            for name in row.tables:
                self._delete(self._place(name, run_id, row.attempt))

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """A table of one run, from its folder alone, or of all runs with ``run_id``; a run or table that is not there raises ValueError."""
        runs = self.runs().where(F.array_contains("tables", table))
        if run_id is not None:
            runs = runs.where(F.col("run_id") == run_id)
        found = [(r.run_id, r.attempt) for r in runs.collect()]  # one short row a run
        if not found:
            raise ValueError(f"no {table} of {'any run' if run_id is None else run_id}")
        return self.spark.read.option("basePath", f"{self.path}/{quote(table, safe='')}").option("recursiveFileLookup", "false").parquet(*[self._place(table, *f) for f in found]).withColumn("run_id", F.col("run_id").cast("string")).drop("attempt")

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
