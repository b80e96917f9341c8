"""Catalog, market and macro files, as a fetcher leaves them behind; nothing here uses a network."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = "groupId BIGINT, abbreviation STRING, name STRING, categoryId BIGINT, publishedOn STRING"
PRODUCTS = "productId BIGINT, name STRING"


def load_groups(spark: SparkSession, path: str, category: int | None = None) -> DataFrame:
    """(group_id, abbreviation, name, published) of JSON files with the rows under results. [SC10]"""
    raw = spark.read.schema(f"results ARRAY<STRUCT<{_fields(GROUPS)}>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("results").alias("r")).select("r.*")
    rows = rows.where(F.col("categoryId") == category) if category is not None else rows
    return rows.select(F.col("groupId").alias("group_id"), "abbreviation", "name", F.col("publishedOn").alias("published"))


def load_products(spark: SparkSession, path: str, groups: list[int] | None = None) -> DataFrame:
    """(group_id, product_id, name) of JSON files laid out as group=…; other groups' folders are not read. [SC11]"""
    raw = spark.read.schema(f"results ARRAY<STRUCT<{_fields(PRODUCTS)}>>, group BIGINT").option("multiLine", True).json(path)
    raw = raw.where(F.col("group").isin(groups)) if groups else raw
    rows = raw.select("group", F.explode("results").alias("r"))
    return rows.select(F.col("group").alias("group_id"), F.col("r.productId").alias("product_id"), F.col("r.name").alias("name"))


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ddl.split(", ")))


def archive_dates(spark: SparkSession, path: str) -> DataFrame:
    """(date) of the days that an archive laid out as date=… holds; files are listed, not read. [SC13 SC20]"""
    files = spark.read.format("binaryFile").load(path)
    if "date" not in files.columns:  # no day at all
        return spark.createDataFrame([], "date date")
    return files.select(F.col("date").cast("date").alias("date")).distinct()


def probe_archive(spark: SparkSession, path: str, earliest: str) -> dict[str, bool]:
    """Whether the archive holds its earliest day and, as it should not, the day before. [SC20]"""
    first = F.lit(earliest).cast("date")
    found = archive_dates(spark, path).where(F.col("date").between(F.date_sub(first, 1), first)).agg(F.count_if(F.col("date") == first).alias("a"), F.count_if(F.col("date") == F.date_sub(first, 1)).alias("b")).first()
    return {"earliest": found.a > 0, "day_before": found.b > 0}


def load_close(spark: SparkSession, path: str, ticker: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(series, date, value): adjusted close of one ticker from Parquet (ticker, date, close), both ends included; an empty result is refused. [SC18]"""
    rows = spark.read.parquet(path).where(F.col("ticker") == ticker)
    rows = rows.where(F.to_date("date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.to_date("date") <= F.lit(end).cast("date")) if end else rows
    if not rows.limit(1).count():
        raise ValueError(f"{path} has no rows of {ticker}")
    return rows.select(F.col("ticker").alias("series"), F.col("date").cast("timestamp_ntz").alias("date"), F.col("close").cast("double").alias("value"))


def load_macro(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(date, value as text) of a macro CSV whose date column is observation_date or DATE. [SC19]"""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    date = next((c for c in ("observation_date", "DATE") if c in raw.columns), None)
    if date is None or value not in raw.columns:
        raise ValueError(f"{path} needs observation_date or DATE, and {value}")
    return raw.select(F.to_timestamp_ntz(date).alias("date"), F.col(value).alias("value"))
