"""Ground truth from a manifest: identities, plantings, expected categories, trap forms, and persons as predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.names import normal_value
from sievemark.operators.accuracy import MATCH_TYPES
from sievemark.operators.casework import linked_elements, usable
from sievemark.operators.exposure import category_of

#: A manifest file (fixed values).
MANIFEST = (
    "identities array<struct<person_uid:string,canonical_name:string,dob:string,elements:map<string,string>,name_variants:array<struct<value:string>>>>, "
    "documents array<struct<filename:string,plantings:array<struct<person_uid:string,element_type:string,value:string>>>>"
)
#: Types under whose normal form a leaked trap value may stand (fixed values).
VALUE_TYPES = ("name", "dob", "ssn", "ssn_last4", "drivers_license", "passport", "financial_account", "credit_card", "medical", "credential", "address", "phone", "email")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files below ``path``, one row each."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def identities(manifest: DataFrame) -> DataFrame:
    """``uid, name, dob, names``: the canonical name, and all names with the variants, sorted."""
    rows = manifest.select(F.explode("identities").alias("i")).select("i.*")
    names = F.array_sort(F.array_distinct(F.array_prepend(F.coalesce(F.transform("name_variants", lambda v: v["value"]), F.array().cast("array<string>")), F.col("canonical_name"))))
    return rows.select(F.col("person_uid").alias("uid"), F.col("canonical_name").alias("name"), F.to_date("dob").alias("dob"), names.alias("names"))


def true_identifiers(manifest: DataFrame) -> DataFrame:
    """``uid, id_type, value`` in normal form, of the types by which persons are matched."""
    rows = manifest.select(F.explode("identities").alias("i")).select("i.person_uid", F.explode("i.elements").alias("id_type", "raw")).where(F.col("id_type").isin(*MATCH_TYPES))
    return rows.select(F.col("person_uid").alias("uid"), "id_type", normal_value(F.col("id_type"), F.col("raw")).alias("value")).where("value <> ''")


def plantings(manifest: DataFrame) -> DataFrame:
    """``doc, uid, element_type, raw, place``; a trap has no uid."""
    docs = manifest.select(F.explode("documents").alias("d")).select(F.col("d.filename").alias("doc"), F.posexplode("d.plantings").alias("place", "p"))
    return docs.select("doc", F.col("p.person_uid").alias("uid"), F.col("p.element_type").alias("element_type"), F.col("p.value").alias("raw"), "place")


def expected_categories(planted: DataFrame) -> DataFrame:
    """``uid, category`` of what is planted as no trap; types outside the categories expect nothing."""
    return planted.where("uid is not null").select("uid", category_of(F.col("element_type")).alias("category")).where("category is not null").distinct()


def planted_values(planted: DataFrame) -> DataFrame:
    """Planted values of persons in normal form: ``uid, doc, id_type, value, place``."""
    rows = planted.where("uid is not null")
    return rows.select("uid", "doc", F.col("element_type").alias("id_type"), normal_value(F.col("element_type"), F.col("raw")).alias("value"), "place")


def trap_values(planted: DataFrame) -> DataFrame:
    """``doc, value``: every form that a trap's value takes under any type, as a leak may stand under any."""
    forms = F.array(*[normal_value(F.lit(t), F.col("raw")) for t in VALUE_TYPES])
    return planted.where("uid is null").select("doc", F.explode(F.array_compact(forms)).alias("value")).where("value <> ''").distinct()


def all_images(planted: DataFrame, documents: DataFrame) -> DataFrame:
    """``uid, all_images``: whether every document of the run that holds something of the person is image-based."""
    docs = planted.where("uid is not null").select("uid", "doc").distinct().join(documents.select("doc", "is_image_based"), "doc")
    return docs.groupBy("uid").agg(F.bool_and("is_image_based").alias("all_images"))


def predicted_identifiers(links: DataFrame, elements: DataFrame) -> DataFrame:
    """``person_id, id_type, value``: usable linked elements of the types by which persons are matched."""
    own = usable(linked_elements(links, elements)).where(F.col("element_type").isin(*MATCH_TYPES))
    return own.select("person_id", F.col("element_type").alias("id_type"), F.col("value_normalized").alias("value")).distinct()


def imported(old: DataFrame, new: DataFrame, key: str = "uid") -> tuple[DataFrame, DataFrame]:
    """An import over what was there: rows of ``new`` replace those of their keys, all others stay.

    Returns the table after it, and the conflicts: rows of keys in both whose other columns differ.
    """
    others = [c for c in old.columns if c != key]
    after = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))
    was, now = old.select(key, F.struct(*others).alias("was")), new.select(key, F.struct(*others).alias("now"))
    return after, was.join(now, key).where(~F.col("was").eqNullSafe(F.col("now")))
