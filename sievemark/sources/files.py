"""Corpus files: inventory, content hash, type by content, routing, quarantine, attachments."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# MIME types by extension, and file classes by type.
#: Bytes that the type of a file is judged by.
SNIFFED = 16_384
MIME_BY_EXTENSION = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv", "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "html": "text/html", "htm": "text/html", "txt": "text/plain", "png": "image/png",
}
CLASS_BY_EXTENSION = {"pdf": "pdf_digital", "docx": "docx", "xlsx": "xlsx", "csv": "csv", "eml": "eml", "msg": "msg", "html": "html", "htm": "html", "txt": "txt", "png": "png"}


def inventory(spark: SparkSession, directory: str) -> DataFrame:
    """All files below ``directory`` but hidden ones: path, name, extension, size, sha256, content, declared and sniffed type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "content")
    files = files.unionByName(_empty_files(spark, directory))
    name = F.element_at(F.split("path", "/"), -1)
    return describe(files.withColumn("name", name).where(~F.col("name").startswith(".")).select("path", "name", "content"))


def _empty_files(spark: SparkSession, directory: str) -> DataFrame:
    """Files without content, which the reader leaves out; the driver lists them as it lists the others."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(), bytearray()))
    return spark.createDataFrame(found, "path string, content binary")


def describe(files: DataFrame) -> DataFrame:
    """Hash, size, extension and types of rows ``path, name, content``."""
    declared = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return files.withColumns({
        "extension": F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)), "byte_size": F.length("content"), "sha256": F.sha2("content", 256),
    }).withColumns({"declared_mime": F.try_element_at(declared, F.col("extension")), "sniffed_mime": sniff(F.col("content"))})


def sniff(content: Column) -> Column:
    """Type by the first ``SNIFFED`` bytes; text by what a plain decoder accepts of them and how it begins.

    A character that the cut goes through, three bytes at most, is left out.
    """
    head = F.substring(content, 1, SNIFFED)
    whole = lambda cut: F.try_validate_utf8(F.substring(head, 1, SNIFFED - cut).cast("string"))
    text = F.when(F.length(content) > SNIFFED, F.coalesce(*map(whole, range(4)))).otherwise(whole(0))
    begins = lambda *codes: F.hex(F.substring(content, 1, 8)).rlike("^(" + "|".join(codes) + ")")
    lead = F.lower(F.ltrim(F.substring(text, 1, 512)))
    return (
        F.when(F.length(content) == 0, "inode/x-empty").when(begins("25504446"), "application/pdf").when(begins("89504E470D0A1A0A"), "image/png")
        .when(begins("504B0304", "504B0506"), "application/zip").when(begins("D0CF11E0A1B11AE1"), "application/x-ole-storage")
        .when(text.isNull() | F.contains(text, F.lit("\x00")), "application/octet-stream")
        .when(lead.rlike(r"^(<!doctype html|<html|<head|<body)"), "text/html")
        .when(lead.rlike(r"^(from|to|subject|date|received|return-path|message-id|mime-version|delivered-to): "), "message/rfc822").otherwise("text/plain")
    )


@F.pandas_udf(StringType())
def zip_kind(content: pd.Series) -> pd.Series:
    """docx or xlsx by the members of a container; broken for one that cannot be opened, other otherwise."""

    def one(data: bytes) -> str:
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return "broken"
        return next((k for k, lead in (("docx", "word/"), ("xlsx", "xl/")) if any(n.startswith(lead) for n in names)), "other")

    return content.map(one)


def route(files: DataFrame) -> DataFrame:
    """Adds ``file_class``, ``reason`` (null: to be parsed) and ``note``.

    In order: empty; the class its content shows, where a parser exists, noting another
    extension; an encrypted or broken PDF; a message container without parser; an
    extension that the content belies; unsupported.
    """
    zips = files.where("sniffed_mime = 'application/zip'").withColumn("inner", zip_kind("content"))
    rest = files.where("sniffed_mime <> 'application/zip'").withColumn("inner", F.lit(None).cast("string"))
    by_extension = F.try_element_at(F.create_map(*[F.lit(x) for pair in CLASS_BY_EXTENSION.items() for x in pair]), F.col("extension"))
    mime = F.col("sniffed_mime")
    shown = (
        F.when(mime == "application/pdf", "pdf_digital").when(mime == "image/png", "png").when(F.col("inner").isin("docx", "xlsx"), F.col("inner"))
        .when((F.col("inner") == "broken") & by_extension.isin("docx", "xlsx"), by_extension)
        .when(mime.isin("text/plain", "text/html", "message/rfc822") & by_extension.isin("txt", "csv", "eml", "html"), by_extension)
        .when(mime == "text/html", "html").when(mime == "message/rfc822", "eml").when((mime == "text/plain") & (F.col("extension") == ""), "txt")
    )
    encrypted = F.contains("content", F.lit(bytearray(b"/Encrypt")))
    whole = F.contains(F.substring("content", -1024, 1024), F.lit(bytearray(b"%%EOF")))
    routed = zips.unionByName(rest).withColumn("shown", shown).withColumn("by_extension", by_extension)
    reason = (
        F.when(F.col("byte_size") == 0, "zero_byte").when((F.col("shown") == "pdf_digital") & encrypted, "password_protected").when((F.col("shown") == "pdf_digital") & ~whole, "corrupt")
        .when(F.col("inner") == "broken", "corrupt").when(F.col("shown").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("by_extension") == "msg", "unsupported").when(F.col("by_extension").isNotNull(), "wrong_extension").otherwise("unsupported")
    )
    other = F.col("shown").isNotNull() & F.col("by_extension").isNotNull() & (F.col("shown") != F.col("by_extension"))
    return routed.withColumns({
        "reason": reason, "file_class": F.coalesce("shown", "by_extension", F.lit("unknown")), "note": F.when(other, F.concat(F.lit("reclassified-from="), "by_extension")),
    }).drop("inner", "shown", "by_extension")


def dedup_within_run(files: DataFrame, run_col: str = "run_id") -> DataFrame:
    """The first file by path of each content in a run, with how many copies were left out."""
    per = files.groupBy(run_col, "sha256").agg(F.min_by(F.struct(*files.columns), "path").alias("_first"), (F.count(F.lit(1)) - 1).alias("copies"))
    return per.select("_first.*", "copies")


def split_quarantine(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse, and the dead letters with stage and reason; no file is in neither."""
    return routed.where("reason is null"), routed.where("reason is not null").withColumn("stage", F.lit("ingest"))
