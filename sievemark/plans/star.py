"""The engine's tables as read from the star schema: mentions, persons, flags, costs and documents derived by keys.

Each derivation is a projection of one table, so plans keep their pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.session import table

GIVEN = ("Robert", "Bob", "William", "Liz", "Margaret", "Jim", "John", "Mike", "Katherine", "Jennifer")
SURNAMES = ("Fournier", "Ellison", "Chen", "Nguyen", "Okafor", "Lam", "Petrov", "Garcia", "Novak", "Silva", "Tanaka", "Weber", "Rossi")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention per customer: names, telephones and dates of birth by remainders of the key, so that some agree."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    given = F.element_at(F.array(*map(F.lit, GIVEN)), (k % len(GIVEN) + 1).cast("int"))
    surname = F.element_at(F.array(*map(F.lit, SURNAMES)), (k % len(SURNAMES) + 1).cast("int"))
    raw = F.when(k % 7 == 0, F.concat(surname, F.lit(", "), given)).otherwise(F.concat(given, F.lit(" "), surname))
    phone = F.concat(F.lit("212555"), F.lpad((k % 997).cast("string"), 4, "0"))
    dob = F.when(k % 3 == 0, F.concat(F.lit("19"), F.lpad((k % 60 + 40).cast("string"), 2, "0"), F.lit("-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    email = F.when(k % 11 == 0, F.concat(F.lit("user"), (k % 130).cast("string"), F.lit("@example.org")))
    elements = F.map_filter(F.create_map(F.lit("phone"), F.array(phone), F.lit("email"), F.array_compact(F.array(email))), lambda _, v: F.size(v) > 0)
    return c.select(k.alias("mention_id"), (k % 200).alias("doc_id"), raw.alias("name_raw"), dob.alias("dob"), elements.alias("elements"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    alias = F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("nickname").alias("kind")))
    return c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("best_name"), alias.alias("aliases"), F.lit(None).cast("string").alias("dob"), F.lit(1.0).alias("er_confidence"), F.when(F.col("c_acctbal") < 0, "needs_review").otherwise("auto").alias("review_status"), (F.col("c_custkey") % 4).alias("mention_count"), F.lit(1).cast("long").alias("document_count"))


CATEGORY_OF_PRIORITY = {"1": "ssn", "2": "dob", "3": "credit_card", "4": "phone", "5": "email"}


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag per customer and order priority: confidence grows with the dearest order."""
    o = table(spark, sf_dir, "orders")
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_OF_PRIORITY.items() for x in pair])
    category = F.coalesce(F.try_element_at(names, F.substring("o_orderpriority", 1, 1)), F.lit("address"))
    return o.groupBy(F.col("o_custkey").alias("person_id"), category.alias("category")).agg(F.lit(True).alias("exposed"), F.round(F.least(F.max("o_totalprice") / 500000, F.lit(1.0)), 4).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"))


def cost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call per line item; tokens and cost are whole numbers, so that sums do not depend on their order."""
    li = table(spark, sf_dir, "lineitem")
    purpose = F.when(F.col("l_returnflag") == "A", "tier1").when(F.col("l_returnflag") == "N", "tier2_text").otherwise("agent_auditor")
    return li.select(
        (F.col("l_orderkey") % 10).alias("run_id"), purpose.alias("purpose"), F.col("l_linestatus").alias("model"),
        F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("document_id"), F.col("l_linenumber").alias("seq"), F.col("l_orderkey").alias("order"),
        F.col("l_quantity").cast("long").alias("input_tokens"), (F.col("l_quantity") / 2).cast("long").alias("output_tokens"), (F.col("l_quantity") / 4).cast("long").alias("cached_input_tokens"),
        F.floor(F.col("l_extendedprice")).cast("double").alias("cost_usd"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order, with class and status by its own columns."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "quarantined").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 10).alias("run_id"), F.col("o_orderpriority").alias("file_class"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("person_id"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element per line item; those of returned lines have no mention, and some of these a signal."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    loose = F.col("l_returnflag") == "R"
    signal = F.when(loose, F.struct(F.when(k % 50 == 0, F.col("l_suppkey") % 40).alias("reviewer_attached_person_id"), F.when(k % 30 == 0, k % 40).alias("er_join_person_id")))
    return li.select(
        (F.col("l_orderkey") * 10_000_000 + k * 10 + F.col("l_linenumber")).alias("element_id"), F.when(~loose, F.col("l_suppkey")).alias("mention_id"), F.col("l_orderkey").alias("document_id"), F.col("l_orderkey").alias("passage_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "ssn").when(F.col("l_linenumber") % 3 == 1, "email").otherwise("medical").alias("element_type"), (k % 90).cast("string").alias("value_normalized"),
        F.when(F.col("l_quantity") > 25, "valid").otherwise("format_only").alias("validation_status"), F.when(F.col("l_tax") > 0.06, "test_record").alias("trap_reason"),
        F.lit("regex").alias("detector"), F.lit(None).cast("double").alias("confidence"), signal.alias("signals"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 40).alias("person_id"), k.alias("mention_id"), F.lit("rule").alias("method"), (k % 7 != 0).alias("active"))


def linked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("mention_id"), F.col("s_name").alias("name_raw"), (F.col("s_suppkey") * 3).alias("document_id"))
