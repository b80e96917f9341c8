"""Truth reconstruction, single forecast windows, and ranking of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..schema import HISTORY_ROWS, TINY_MAE
from .events import glitches


def truth(predictions: DataFrame) -> DataFrame:
    """(series, idx, date, value, observed): all one-step rows and the last origin's rows, one-step rows first where both give an index. [R1]"""
    last = F.max("origin_index").over(Window.partitionBy("series"))
    rows = predictions.withColumn("last", last).where((F.col("horizon_step") == 1) | (F.col("origin_index") == F.col("last")))
    first = F.row_number().over(Window.partitionBy("series", "target_index").orderBy("horizon_step"))
    return rows.withColumn("rn", first).where("rn = 1").select("series", F.col("target_index").alias("idx"), F.col("target_date").alias("date"), F.col("actual").alias("value"), "observed")


def forecast_slice(predictions: DataFrame, series: str, origin: int, history: int = HISTORY_ROWS, require_observed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history rows, target rows, scalars) of one window; an unknown window is refused. Scores count observed targets only. [R2]"""
    targets = predictions.where((F.col("series") == series) & (F.col("origin_index") == origin))
    if not targets.limit(1).count():
        raise ValueError(f"no forecast of {series} at origin {origin}")
    if require_observed and targets.where("not observed").limit(1).count():
        raise ValueError(f"targets of {series} at origin {origin} are not all observed")
    real = truth(predictions.where(F.col("series") == series))
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("idx")))
    past = real.where(F.col("idx") < origin).withColumn("back", back).where(F.col("back") <= history).drop("back")
    odd = glitches(real).select("idx")
    window = targets.select(F.col("target_index").alias("idx")).unionByName(past.select("idx"))
    n_glitches = window.join(odd, "idx", "left_semi").agg(F.count("*").alias("n_glitches"))
    scores = targets.where("observed").agg(M.mae("actual", "forecast").alias("model_mae"), M.mae("actual", "baseline_naive").alias("naive_mae"), M.coverage("actual").alias("coverage"))
    scalars = scores.crossJoin(n_glitches).select(
        F.lit(series).alias("series"), F.lit(origin).cast("bigint").alias("origin_index"), "coverage",
        F.when(F.col("naive_mae") > TINY_MAE, F.col("model_mae") / F.col("naive_mae")).alias("relative_mae"), (F.col("n_glitches") > 0).alias("contains_glitch"),
    )
    return past, targets, scalars


def rank_windows(predictions: DataFrame, exclude_glitches: bool = True, require_all_observed: bool = True) -> DataFrame:
    """One row for each (series, origin): move, ratio, coverage, glitch flag over targets and origin, share observed. All targets are scored. [R3]"""
    odd = glitches(truth(predictions)).select("series", F.col("idx").alias("g_idx"))
    mae, naive = M.mae("actual", "forecast"), M.mae("actual", "baseline_naive")
    rows = predictions.groupBy("series", "origin_index").agg(
        F.max_by("actual", "horizon_step").alias("last"), F.first("baseline_naive").alias("naive"), mae.alias("model_mae"), naive.alias("naive_mae"), M.coverage("actual").alias("coverage"),
        F.avg(F.col("observed").cast("double")).alias("observed_fraction"), F.bool_and("observed").alias("all_targets_observed"), F.max("target_index").alias("end"),
    )
    on = (F.col("g_series") == F.col("series")) & F.col("g_idx").between(F.col("origin_index"), F.col("end"))
    marks = rows.join(odd.withColumnRenamed("series", "g_series"), on, "left_semi").select("series", "origin_index", F.lit(True).alias("hit"))
    out = rows.join(marks, ["series", "origin_index"], "left").select(
        "series", "origin_index", F.when(F.col("naive") != 0, (F.col("last") - F.col("naive")) / F.col("naive")).alias("pct_change"),
        F.when(F.col("naive_mae") >= TINY_MAE, F.col("model_mae") / F.col("naive_mae")).alias("relative_mae"), "coverage", F.coalesce("hit", F.lit(False)).alias("contains_glitch"),
        (F.col("model_mae") < F.col("naive_mae")).alias("beats_naive"), "observed_fraction", "all_targets_observed",
    )
    out = out.where("not contains_glitch") if exclude_glitches else out
    return out.where("all_targets_observed") if require_all_observed else out
