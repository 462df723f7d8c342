"""Session and input helpers of the llm operators; those of the shared folder are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.sources.shared import drop_path as drop_path
from docaudit.sources.shared import new_path as new_path
from docaudit.sources.shared import persisted as persisted
from docaudit.sources.shared import removed as removed

#: Word separators of every contract: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out


#: Rows of a batch between the JVM and Python. Texts are long, and a batch lies in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to BATCH_ROWS; a session that asks for fewer keeps its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(doc_id: str, mod: int):
    """crc32(doc_id as text) mod m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
