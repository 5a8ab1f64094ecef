"""The operators over streams: they keep no state for a document, so a stream of documents takes the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.process import ProcessConfig, extract_data, process
from tessera.sources.files import scratch


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that come to a folder, with the schema of those there; of one file, if the path is that."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def process_stream(docs: DataFrame, config: ProcessConfig) -> DataFrame:
    return process(docs, config)


def dedup_stream(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """docs without contents seen before within the delay; the one stateful operator, bounded by the watermark."""
    return docs.withColumn(time, F.col(time).cast("timestamp")).withColumn("_h", F.sha2("content", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def event_keys(events: DataFrame) -> DataFrame:
    """Counts of property keys, and of those with a value."""
    docs = events.select(F.col("event_id").alias("doc_id"), F.col("props").alias("content"), F.lit("json").alias("language"))
    keys = extract_data(docs).where("parent_id is not null").groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNotNull()).alias("n_values"))
    return keys


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def run_to_end(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """The result of a stream over the files there now. Each batch replaces a Parquet table in the shared folder, where the stream's
    state is too, so nothing of the result passes through the driver."""
    root = scratch(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result-{number}")
        held["last"] = number

    held: dict[str, int] = {}
    stream = transform(read_files(spark, path))
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = [held["last"]] if mode == "complete" else range(held["last"] + 1)
    return spark.read.schema(stream.schema).parquet(*[f"{root}/result-{n}" for n in numbers])
