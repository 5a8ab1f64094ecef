"""op10: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import narrow, table
from tessera.llm.langid import predict, train


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    net = train(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
