"""Session helpers shared by all operators: where to cut lineage, and how wide to deal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one machine, a temporary folder
    stands in for the absent setting; on a cluster the setting is required.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sievemark-")
    return _LOCAL[app]


def _write(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation,
    and so that several consumers share one evaluation.
    """
    return _write(df, label)[1]


class Scratch:
    """Tables written on the way to one result, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``materialize`` under a name; a table of the same name that was there before is deleted afterwards."""
        before = self.paths.get(label)
        self.paths[label], out = _write(df, label)
        if before:
            self._delete(before)
        return out

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._delete(self.paths.pop(label))

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
