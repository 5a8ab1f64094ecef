"""op2: licence scans of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.license import oracle_sql, scan


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE_SQL = {"op2_license_scan": oracle_sql()}
