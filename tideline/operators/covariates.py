"""Calendar covariates, ablation with and without them, and the leak control.

The built-in covariate forecaster shows whether a covariate reaches it: with one it answers with the covariate's future value
scaled to the context (``last + future - past``), without one with the last value.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schema import COV_CONTEXT, COV_HORIZON, RELEASE_CAP
from .origins import valid_origins


def by_idx() -> WindowSpec:
    return Window.partitionBy("series").orderBy("idx")


def day_of_week(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the weekday, Monday first. [V1]"""
    angle = F.weekday(date) * (2 * pi / 7)
    return F.sin(angle), F.cos(angle)


def days_to_release(calendar: DataFrame, releases: DataFrame, cap: int = RELEASE_CAP) -> DataFrame:
    """(date, days_to_release): days to the next release on or after each date, at most ``cap``, which also stands for none. [V2]

    As-of join forward: releases and dates are sorted together once, and the next release is carried back.
    """
    dates = calendar.select(F.to_date("date").alias("d")).distinct().select("d", F.lit(None).cast("date").alias("release"))
    both = dates.unionByName(releases.select(F.to_date("release").alias("d"), F.to_date("release").alias("release")))
    ahead = Window.partitionBy(F.lit(0)).orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.first("release", ignorenulls=True).over(ahead)  # a calendar of days: one small partition
    rows = both.withColumn("next", following).where("release is null")
    days = F.least(F.coalesce(F.datediff("next", "d"), F.lit(cap)), F.lit(cap))
    return rows.select(F.col("d").alias("date"), days.cast("double").alias("days_to_release"))


def _windows(panel: DataFrame, covariate: Column, context: int, horizon: int, origins: DataFrame) -> DataFrame:
    frame = by_idx().rowsBetween(-1, -1)
    rows = panel.withColumn("cov", covariate).select(
        "series", F.col("idx").alias("origin_index"), F.last("value").over(frame).alias("last"), F.last("cov").over(frame).alias("cov_last"),
        F.collect_list(F.struct("idx", "value", "cov")).over(by_idx().rowsBetween(0, horizon - 1)).alias("t"),
    )
    rows = rows.where(F.col("origin_index") >= context).join(origins, ["series", "origin_index"], "left_semi")
    return rows.select("series", "origin_index", "last", "cov_last", F.posexplode("t").alias("step", "t")).select("*", (F.col("step") + 1).cast("bigint").alias("horizon_step"))


def covariate_ablation(panel: DataFrame, covariate: Column, label: str, context: int = COV_CONTEXT, horizon: int = COV_HORIZON, max_origins: int | None = None) -> DataFrame:
    """(covariate, series, origin_index, horizon_step, with_covariate, actual, forecast): the same origins without and with it. [V3]"""
    rows = _windows(panel, covariate, context, horizon, valid_origins(panel, context, horizon, max_origins))
    arms = F.explode(F.array(F.lit(False), F.lit(True))).alias("with_covariate")
    out = rows.select("*", arms)
    point = F.when(F.col("with_covariate"), F.col("last") + F.col("t.cov") - F.col("cov_last")).otherwise(F.col("last"))
    return out.select(F.lit(label).alias("covariate"), "series", "origin_index", "horizon_step", "with_covariate", F.col("t.value").alias("actual"), point.alias("forecast"))


def ablation_summary(rows: DataFrame) -> DataFrame:
    """Per covariate and series: error without and with it, and their ratio; NULL over a zero error. [V5]"""
    err = F.abs(F.col("actual") - F.col("forecast"))
    out = rows.groupBy("covariate", "series").agg(F.avg(F.when(~F.col("with_covariate"), err)).alias("mae_without"), F.avg(F.when(F.col("with_covariate"), err)).alias("mae_with"))
    return out.withColumn("ratio", F.try_divide("mae_with", "mae_without"))


def leak_control(panel: DataFrame, context: int = COV_CONTEXT, horizon: int = COV_HORIZON, max_origins: int | None = None) -> DataFrame:
    """(series, origin_index, horizon_step, arm, leaked, actual, forecast) for the arms clean, leaked_flat_past and leaked. [V4]

    Negative control: the covariate is the series' own future, after a flat past or after its real past. The forecaster scales a covariate by
    the spread of its past, so behind a flat past it cannot read the leak and answers with the last value.
    """
    rows = _windows(panel, F.col("value"), context, horizon, valid_origins(panel, context, horizon, max_origins))
    spread = F.stddev_pop("value").over(by_idx().rowsBetween(-context, -1))
    scale = panel.select("series", F.col("idx").alias("origin_index"), spread.alias("spread"))
    out = rows.join(scale, ["series", "origin_index"]).select("*", F.explode(F.array(F.lit("clean"), F.lit("leaked_flat_past"), F.lit("leaked"))).alias("arm"))
    readable = (F.col("arm") == "leaked") & (F.col("spread") > 0)
    point = F.when(readable, F.col("last") + F.col("t.cov") - F.col("cov_last")).otherwise(F.col("last"))
    return out.select("series", "origin_index", "horizon_step", "arm", (F.col("arm") != "clean").alias("leaked"), F.col("t.value").alias("actual"), point.alias("forecast"))


def leak_summary(rows: DataFrame) -> DataFrame:
    """Mean absolute error by series and arm."""
    return rows.groupBy("series", "arm").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"), F.count("*").alias("n"))
