"""op7: every document text as a media payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.media import media_columns


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op7_media_columns": op7_media_columns}
