"""op8: all documents packed into sequences of at most 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.packing import pack_documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capacities for documents and attention cost are those that 4096 tokens imply, so that tokens alone bind here."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
