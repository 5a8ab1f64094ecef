"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, cast; extra and clashing columns of the caller go, and a missing one is null.

    Column names are matched exactly where that is possible, so `Text` beside `text` does no harm.
    """
    out = []
    for name, kind in columns.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        out.append((at[0] if at else None, name, kind))
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.lit(None) if i is None else F.col(f"_c{i}")).cast(kind).alias(name) for i, name, kind in out])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only in local mode, where driver and executors are one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(drop)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: it cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        delete(df.sparkSession, path)
