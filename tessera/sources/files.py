"""Source files as documents."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ChecksumMismatchError, ConfigError
from tessera.functions.detect import from_path
from tessera.operators.catalog import Catalog


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; deleted when the driver's Python ends.

    Only in local mode, where they are one, it may be a temporary folder of the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(drop)
    return path


def read_sources(spark: SparkSession, path: str, catalog: Catalog | None = None, glob: str | None = None) -> DataFrame:
    """(doc_id, path, content, language, error) of all files below a path; invalid UTF-8 gives an error and no content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("content"), from_path(F.col("path"), catalog).alias("language"), F.when(text.isNull(), "invalid UTF-8").alias("error"))


def read_text(spark: SparkSession, text: str, language: str) -> DataFrame:
    return spark.createDataFrame([(0, text, language)], "doc_id long, content string, language string")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """A document for each line that is not blank. Ids follow the order of lines; they are the same as long as files and the size of
    splits are."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("content"), F.lit("json").alias("language"))


def unchanged(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs whose content is not among those of `before`, to process what changed alone."""
    seen = before.select(F.sha2("content", 256).alias("_h")).distinct()
    return docs.withColumn("_h", F.sha2("content", 256)).join(seen, "_h", "left_anti").drop("_h")


def verify_sha256(files: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """files(name, content) joined to expected(name, sha256), with ok; strict: a digest that differs raises."""
    out = files.select("name", F.sha2("content", 256).alias("_got")).join(expected, "name", "left").select("name", (F.col("_got") == F.lower("sha256")).alias("ok"))
    if strict and (bad := [r.name for r in out.where("not ok").orderBy("name").limit(5).collect()]):
        raise ChecksumMismatchError(f"digest differs: {', '.join(bad)}")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, group, url, sha256, size) of a local manifest: a JSON array, or JSON lines, of such objects."""
    return spark.read.schema("name string, `group` string, url string, sha256 string, size long").option("multiLine", "true").json(path)


def read_archives(spark: SparkSession, path: str, names: list[str] | None = None, catalog: Catalog | None = None) -> DataFrame:
    """(path, name, content, language) of the regular members of the tar archives (plain, gzip, bzip2 or xz) below a path; names:
    those members alone. Members are read one by one where the archive is; a broken archive gives what comes before the break."""
    wanted = None if names is None else frozenset(names)

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as archive:
                        for member in archive:
                            if member.isfile() and (wanted is None or member.name in wanted):
                                body = archive.extractfile(member).read()
                                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([member.name]), pa.array([body], pa.binary())], ["path", "name", "content"])
                except tarfile.TarError:
                    continue

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, name string, content binary").withColumn("language", from_path(F.col("name"), catalog))
