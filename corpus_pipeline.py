"""Corpus pipeline: language ID, near-dedup, secret scans, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the columns of
documents. run() applies them to the documents table, each stage's result written as Parquet and read back by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.langid import keep_identified, train
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_without
from tessera.llm.packing import pack_documents
from tessera.llm.q_mixing import TARGETS
from tessera.llm.q_packing import tokenizer_path
from tessera.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from the table; undetermined ones and texts of no clear language go.

    So null texts and those without letters go. Rows that repeat go or stay together; null ids and other columns come through.
    """
    return keep_identified(docs, train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at a similarity of 0.8 of five-word shingles.

    Documents without an id can't be told from others and stay; null, empty and blank texts are near nothing and stay. Rows that
    share an id count as documents of their own, each kept or not by its text. An empty table gives an empty one; other columns
    come through, whatever their names.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows, key = plain.where(F.col(doc_id).isNotNull()), doc_id
    if not rows.groupBy(doc_id).count().where("count > 1").isEmpty():
        rows, key = rows.orderBy(doc_id, F.xxhash64(text)), "row"  # numbered in the order of ids
        rows = materialize(rows.withColumn(key, F.monotonically_increasing_id()), "rows")
    keep = near_duplicates(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).where("kept").select(F.col("doc_id").alias(key)).distinct()
    kept = rows.join(keep, key, "left_semi").select(plain.columns)
    return kept.union(plain.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; null and empty texts as they are."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic ones, each of the others in one copy or more, so that tokens have the target shares of op9.

    Texts without words have the posteriors of unknown ones; rows that repeat go or stay together.
    """
    return mix_without(docs, table(spark, sf_dir, "labels"), TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens; a null or empty text is its end alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing to target weights", mixing), ("best-fit packing", packing)]

#: SQL expresses neither the trained classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
