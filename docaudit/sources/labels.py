"""Label files: CSV with quoted fields, checked before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.operators.evaluation import invalid

# Columns of a label file; all but the note must be filled.
COLUMNS = ("document_id", "version_id", "rule_id", "finding_id", "location_key", "predicted_confidence", "label", "rule_version", "reviewer", "note")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows as text, with their number among the records of all files, in the order of the files' parts. One pass counts the
    records of each part, the next numbers them from where the part begins, so no task sees them all."""
    x = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema=", ".join(f"{c} string" for c in COLUMNS), enforceSchema=False)
    x = x.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each part
    starts = starts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    line = F.col("_start") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 2
    return x.join(starts, "_part").select(*COLUMNS, line.alias("line"))


def checked(labels: DataFrame) -> DataFrame:
    """Typed labels; raises with every bad field if there is any."""
    bad = invalid(labels, tuple(c for c in COLUMNS if c != "note")).orderBy("line", "field").collect()
    if bad:
        raise ValueError("; ".join(f"line {r['line']}: {r['field']} = {r['value']!r}" for r in bad))
    return labels.select("rule_id", F.col("label").cast("int").alias("label"), F.col("predicted_confidence").cast("double").alias("confidence"), "rule_version", "document_id", "finding_id")
