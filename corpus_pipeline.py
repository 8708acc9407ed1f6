"""From raw documents to token ids: each stage takes what the one before kept, written as Parquet and read again.

Every stage takes documents (doc_id, text, lang, source, n_chars, and any other columns) and gives the same columns, but for the last. Null ids
and nulls in other columns are kept as they are; an empty table gives an empty one; what each does with null and empty texts and with
repeated rows, it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, jaccard_join, pieces, pii, quality
from lamina.llm.common import scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and trees keep. Null and empty texts, as any of under ten words, go; repeated rows stay or go together."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, one row of it. Texts without words, null or not, are in no group and stay."""
    return jaccard_join.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; repeated rows stay or go together."""
    return decontaminate.drop_hits(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data redacted in their texts. Null texts stay null, and every row stays."""
    return pii.redact(docs)


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether they decode to its text. A null text is as an empty one, without ids; every row gives one."""
    return pieces.encoded(docs)


STAGES = [("quality rules", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", clean), ("PII", private), ("SentencePiece encoding and decoding", ids)]

#: The trees' verdicts and the field's spans are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote for itself is removed when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
