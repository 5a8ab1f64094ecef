"""op1: MinHash near-dedup of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.minhash import near_duplicates


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=40, rows=8)


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
