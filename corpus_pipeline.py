"""From raw documents to token ids: toxicity, near duplicates, benchmark passages, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. Null and repeated ids, null and empty texts, extra
columns and empty tables pass as the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docaudit.llm import decontamination, jaccard, mixing, tokens, toxicity
from docaudit.llm.common import persisted, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, doesn't call toxic. Null and empty texts are scored as empty ones
    and stay unless the threshold says otherwise; repeated ids are judged row by row; without labels of both kinds all stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id. Documents without words stand alone and stay;
    of rows with equal id and text one stays; a component without any id keeps its rows."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands within its budget of edits. Null texts hold nothing and stay; items without
    text match nothing; an empty benchmark drops nothing."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights come near to the target marginals of source, language and topic. A null source or language
    counts as an empty one; rows without text weigh nothing; repeated rows are drawn each on its own."""
    return mixing.sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all that is left, read back from the store: rows in ascending doc_id, null first;
    a null text has its end id alone."""
    import public_tokenizers

    return tokens.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", token_ids),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
