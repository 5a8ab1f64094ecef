"""op9: document rates for target weights of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.mixing import mix

TARGETS = {"high": 0.7, "low": 0.3, "toxic": 0.0}


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


QUERIES = {"op9_mixing_sources": op9_mixing_sources}
