"""Files of a folder by their extension: what is admitted, what is turned away and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by kind of source, and the largest file.
KINDS = {"docx": "docx", "md": "markdown", "txt": "txt", "text": "txt"}
MAX_UPLOAD = 20 * 2**20


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path with its extension; contents are read only where a plan asks for them."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)))


def admitted(spark: SparkSession, path: str, extensions: tuple[str, ...] = tuple(KINDS), most: int = MAX_UPLOAD) -> tuple[DataFrame, DataFrame]:
    """(path, extension, content) of the files with these extensions up to that size; (path, extension, error) of
    all others, by their metadata alone."""
    x = listed(spark, path)
    error = (
        F.when(F.col("extension") == "docm", "documents with macros are not supported").when(~F.col("extension").isin(*extensions), F.concat(F.lit("format not supported: ."), "extension"))
        .when(F.col("length") > most, F.format_string("file of %d bytes, at most %d are admitted", "length", F.lit(most)))
    )
    good = x.where(F.col("extension").isin(*extensions) & (F.col("length") <= most)).select("path", "extension", "content")
    return good, x.select("path", "extension", error.alias("error")).where("error is not null")


def texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kind, text) of the text and Markdown files below a path, without their byte-order mark; and what
    was turned away."""
    good, bad = admitted(spark, path, tuple(k for k in KINDS if k != "docx"))
    kind = F.when(F.col("extension") == "md", "markdown").otherwise("txt")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    return good.select(F.col("path").alias("doc_id"), kind.alias("kind"), F.regexp_replace(text, "\r\n?", "\n").alias("text")), bad.where("extension <> 'docx'")
