"""The corpus pipeline: five operators in a row, each on all that the one before it kept.

Toxic documents go; one document of each near-duplicate group stays; personal data is
replaced by its kind; sources are mixed to their targets; the mix is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import pii_crf, toxicity
from sievemark.llm.mixing import mix
from sievemark.llm.ngram_join import ngram_components
from sievemark.llm.packing import pack
from sievemark.llm.piece_ids import public_path
from sievemark.operators.positions import repeat_rows, with_position
from sievemark.session import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, one row: that with the smallest doc_id, null last, then by its place.

    Rows without words are linked with nothing and stay. Rows are told apart by their
    place in the files, so repeated and null ids are rows like others.
    """
    placed = with_position(docs)
    ranked = placed.withColumn("_rank", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_position"))
    groups = ngram_components(ranked, id_col="_rank")
    kept = groups.select("_rank._position", (F.col("_rank") == F.col("component_id")).cast("int").alias("n"))
    return repeat_rows(placed, kept)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii_crf.redact(docs, pii_crf.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix begins it; rows without words, or not reached, are not taken."""
    placed = with_position(docs)
    return repeat_rows(placed, mix(placed, carry="_position").select("_position", F.col("copies").alias("n")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can express neither the fitted models nor the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next; a stage's rows go once the next is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
