"""The audit of texts as they arrive: rules that look at one text are exact in every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators import rules as R
from docaudit.sources import paragraphs as P


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Stream of documents (doc_id, text) from Parquet files landing below a path."""
    return spark.readStream.schema("doc_id long, text string").parquet(path)


def local_findings(docs: DataFrame, options: set[str], kind: str = "txt") -> DataFrame:
    """Findings of the local rules, without state."""
    rows = P.elements(docs, kind).withColumns({"section": F.lit(P.FIRST_SECTION), "id": F.col("ord").cast("string")})
    return R.local(rows, options, kind)


def latest_status(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Review events (doc_id, finding_id, status, ts timestamp) -> each finding's latest status, so that
    repeated events change nothing; events later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy("doc_id", "finding_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
