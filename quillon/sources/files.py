"""Small files and folders on any file system that Spark reaches, through its Hadoop client."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task takes of a large table.
PART = 500_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).head(1)
    return rows[0][0] if rows else ""


def listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"can't move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode,
    else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: computed once, kept when executors are lost."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df in parts by keys, of PART rows each if it has so many rows: what a task holds then doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART)), *keys)


def join(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def safe(name: str) -> str:
    """A name as part of a path."""
    return re.sub(r"[^A-Za-z0-9_.=-]", "_", name)
