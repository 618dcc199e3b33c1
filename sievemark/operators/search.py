"""Search indexes: trigrams of names for patterns, and elements by type and value."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemark.sources.buckets import BUCKETS, BucketTable

#: Letters of a gram, and grams of a pattern that are looked up, the rarest first.
GRAM, LOOKED_UP = 3, 4


def _grams(text: Column) -> Column:
    """Distinct grams of the lower-case text."""
    low = F.lower(text)
    n = F.length(low) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(low, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def pattern_grams(spark: SparkSession, search: str) -> list[str]:
    """Grams that every text which ``ILIKE '%search%'`` finds must hold: those of its parts between ``%``, ``_`` and escapes."""
    parts = [p for p in re.split(r"%|_|\\.?", search, flags=re.DOTALL) if len(p) >= GRAM]
    rows = spark.createDataFrame([(p,) for p in parts], "part string").select(F.explode(_grams(F.col("part"))).alias("gram")).distinct()
    return sorted(r.gram for r in rows.collect())  # a pattern's own


class NameIndex:
    """Persons by the grams of their best name and of their aliases, for ``ILIKE`` patterns.

    Three tables in folders: grams with their persons, grams with their number, and the
    persons. A pattern with a part of three letters reads the folders of its rarest
    grams and of the persons that hold them all, who are then matched by the pattern
    itself; a pattern without one scans the persons. Rows are those of a scan.
    """

    def __init__(self, spark: SparkSession, path: str, persons: DataFrame | None = None, buckets: int = BUCKETS):
        """Opens the index at ``path``, or with ``persons (person_id, best_name, aliases, ...)`` builds it; ids are distinct and not null."""
        self.spark = spark
        rows = persons if persons is not None else spark.read.parquet(f"{path}/persons").drop("_bucket")
        kind = rows.schema["person_id"].dataType
        self.persons = BucketTable(spark, f"{path}/persons", "person_id", rows.schema, buckets)
        self.postings = BucketTable(spark, f"{path}/postings", "gram", StructType().add("gram", "string").add("person_id", kind), buckets)
        self.counts = BucketTable(spark, f"{path}/counts", "gram", StructType().add("gram", "string").add("n", "long"), buckets)
        if persons is not None:
            self.persons.create(persons)
            held = self.persons.read().select("person_id", F.explode(F.array_union(_grams(F.coalesce("best_name", F.lit(""))), _grams(F.coalesce(self.aliases_text(), F.lit(""))))).alias("gram"))
            self.postings.create(held)
            self.counts.create(self.postings.read().groupBy("gram").agg(F.count(F.lit(1)).alias("n")))

    @staticmethod
    def aliases_text() -> Column:
        """Aliases as the text that a search sees, kinds and all."""
        return F.to_json("aliases")

    def candidates(self, search: str) -> DataFrame | None:
        """``person_id`` of those that hold the pattern's rarest grams; None if it has no gram."""
        grams = pattern_grams(self.spark, search)
        if not grams:
            return None
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        known = {r.gram: r.n for r in self.counts.read(asked).collect()}  # a pattern's own grams
        rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
        found = self.postings.read(self.spark.createDataFrame([(g,) for g in rarest], "gram string"))
        return found.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("person_id")

    def search(self, search: str) -> DataFrame:
        """Persons whose best name or aliases match ``%search%`` without regard to case; ``%`` and ``_`` in it are wildcards."""
        met = self.candidates(search)
        pattern = f"%{search}%"
        return self.persons.read(met).where(F.col("best_name").ilike(pattern) | self.aliases_text().ilike(pattern))


class ElementIndex:
    """Elements in folders by type and normal value, so that an exact search reads one folder."""

    def __init__(self, spark: SparkSession, path: str, elements: DataFrame | None = None, buckets: int = BUCKETS):
        """Opens the index at ``path``, or with ``elements (element_id, element_type, value_normalized, ...)`` builds it."""
        self.spark = spark
        rows = spark.read.parquet(path).drop("_bucket") if elements is None else elements.withColumn("lookup", self._lookup(F.col("element_type"), F.col("value_normalized")))
        self.table = BucketTable(spark, path, "lookup", rows.schema, buckets)
        if elements is not None:
            self.table.create(rows.where("lookup is not null"))

    @staticmethod
    def _lookup(kind: Column, value: Column) -> Column:
        return F.concat(kind, F.lit(":"), value)

    def find(self, element_type: str, value: str, limit: int = 50) -> DataFrame:
        """Elements of the type with exactly this normal value, by id, ``limit`` or 50 at most (the feature's own bound)."""
        return self.find_all([(element_type, value)]).orderBy("element_id").limit(min(limit, 50))

    def find_all(self, wanted: list[tuple[str, str]]) -> DataFrame:
        """All elements of each of these types and values."""
        asked = self.spark.createDataFrame(wanted, "kind string, value string").select(self._lookup(F.col("kind"), F.col("value")).alias("lookup"))
        return self.table.read(asked).drop("lookup")
