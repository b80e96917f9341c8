"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Set while a table is written: shuffle files leave the disks as soon as the write has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all tasks run in this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop_path(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """``df`` written as zstd Parquet in the shared folder and read back: later steps survive the loss of any executor.

    With ``keep`` the table outlives the ``scratch`` that it is written in.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _made and not keep:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a folder and the folder, as the JVM knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def make_path(spark: SparkSession, path: str) -> None:
    system, p = _folder(spark, path)
    system.mkdirs(p)


def drop_path(spark: SparkSession, path: str) -> None:
    system, p = _folder(spark, path)
    system.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col), F.lit(""))


def row_keys(*cols: Column) -> list[Column]:
    """Two 64-bit digests that name a row by its content; equal rows share them."""
    return [F.xxhash64(*cols, F.lit(salt)).alias(name) for name, salt in (("k1", 0x51ED), ("k2", 0xA7C3))]
