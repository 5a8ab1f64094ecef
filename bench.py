"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs once to warm up and then $BENCH_RUNS times; the median counts."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

QUERIES = (
    "q_flagship",
    "q_line_metrics",
    "q_line_metrics_by_lang",
    "q_detect_path",
    "q_detect_shebang",
    "q_json_data",
    "q_json_roundtrip",
    "q_csv_roundtrip",
    "q_yaml_roundtrip",
    "q_xml_roundtrip",
    "q_html_comments",
    "q_chunk_cover",
    "q_py_structure",
    "q_py_symbols",
    "q_node_metrics",
    "q_next_sibling",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.registry import QUERIES as own

    out = {}
    for name in QUERIES:
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            own[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        out[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
