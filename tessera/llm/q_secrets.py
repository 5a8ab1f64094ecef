"""op6: secret scans of documents over a blob ledger, empty at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.secrets import report, scan


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = scan(table(spark, sf_dir, "documents"))
    return report(findings)


QUERIES = {"op6_secret_scan": op6_secret_scan}
