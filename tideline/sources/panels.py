"""Panels: scans of stored ones and the ones derived from the relational tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import bucket_means, dense, intersect_calendar
from ..schema import PANEL

#: Events of the market panel, before and after a cut-off on 1998-11-30.
EVENTS = (
    ("spring_1996", "1996-03-16", "pre_cutoff"),
    ("winter_1997", "1997-02-24", "pre_cutoff"),
    ("summer_1997", "1997-06-13", "pre_cutoff"),
    ("summer_1999", "1999-08-05", "post_cutoff"),
    ("spring_2000", "2000-04-03", "post_cutoff"),
)


def events(spark: SparkSession) -> DataFrame:
    rows = [(n, datetime.fromisoformat(d), a) for n, d, a in EVENTS]
    return spark.createDataFrame(rows, "event string, event_date timestamp_ntz, arm string")


def read_panel(spark: SparkSession, path: str, made_by: str, series: list[str] | None = None) -> DataFrame:
    """A stored panel, whole or some of its series; names the step that makes the file if it is absent, and wanted series that are not in it. [SC1 SC2 SC3 SC4]"""
    try:
        panel = spark.read.schema(PANEL).parquet(path).select("series", "date", "value", "observed", "idx")
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is absent; {made_by} makes it") from e
    if series is None:
        return panel
    wanted = spark.createDataFrame([(s,) for s in series], "series string")
    absent = wanted.join(panel.select("series").distinct(), "series", "left_anti").collect()  # of the caller's own list
    if absent:
        raise ValueError(f"{path} lacks {sorted(r.series for r in absent)}")
    return panel.where(F.col("series").isin(series))


def write_panel(panel: DataFrame, path: str) -> None:
    """zstd Parquet, one folder a series, rows in order. [SK1 SK3]"""
    panel.repartition("series").sortWithinPartitions("series", "idx").write.mode("overwrite").option("compression", "zstd").partitionBy("series").parquet(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """zstd Parquet in folders by mode and transform, so that a scan of one combination reads no other. [SK1 SK2]"""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("mode", "transform").parquet(path)


def read_predictions(spark: SparkSession, path: str, mode: str | None = None, transform: str | None = None) -> DataFrame:
    """Stored prediction rows of a mode and transform; filters on columns that are absent are skipped. [SC5 SC6]"""
    rows = spark.read.parquet(path)
    for name, value in (("mode", mode), ("transform", transform)):
        if value is not None and name in rows.columns:
            rows = rows.where(F.col(name) == value)
    return rows


def write_slice(rows: DataFrame, path: str, mode: str, transform: str) -> None:
    """The rows of one mode and transform, without columns that they share or that a demonstration does not need. [SK2]"""
    own = rows.where((F.col("mode") == mode) & (F.col("transform") == transform))
    own.drop("mode", "transform", "baseline_drift", "baseline_ets").write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_predictions(spark: SparkSession, full: str, mode: str, transform: str, small: str | None = None, small_of: tuple[str, str] = ("univariate", "identity")) -> tuple[DataFrame, str]:
    """Stored rows of a mode and transform, and the path that they came from: the slice if it holds just these, else the full table; refused if neither exists. [SC5]"""
    paths = [p for p in (small if (mode, transform) == small_of else None, full) if p]
    for path in paths:
        try:
            return read_predictions(spark, path, mode, transform), path
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths} exists")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): daily mean price by return flag."""
    return bucket_means(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice", "day")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The liquid panel: days that all series have."""
    return intersect_calendar(market_days(spark, sf_dir))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse panel: hourly mean by event type, densified and filled, rows before the first value left out."""
    return dense(bucket_means(table(spark, sf_dir, "events"), "event_type", "ts", "value", "hour"), "hour", unfilled="drop")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, value): monthly mean order price."""
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("s"), "o_orderdate", "o_totalprice")
    return bucket_means(rows, "s", "o_orderdate", "o_totalprice", "month").select("date", "value")


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as vendor rows: a market price that may be missing, a mid price, a subtype."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("market"), (F.col("l_extendedprice") * 0.95).alias("mid"),
        F.when(F.col("l_linestatus") == "F", "Normal").otherwise("Foil").alias("subtype"), F.col("l_extendedprice").alias("price"),
    )
