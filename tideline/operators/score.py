"""Accuracy, calibration and leaderboards over prediction rows. Only observed targets are scored unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..schema import BASELINES, DM_LEAST_ROWS, LEVELS, QUANTILES


def mase_scales(panel: DataFrame, boundary: int, season: int = 1) -> DataFrame:
    """(series, scale) from rows before ``boundary``; a history of no more than a season is refused. [A4 A5]"""
    lagged = F.lag("value", season).over(Window.partitionBy("series").orderBy("idx"))
    rows = panel.where(F.col("idx") < boundary).withColumn("lagged", lagged)
    scales = rows.groupBy("series").agg(M.in_sample_scale(F.col("value"), F.col("lagged")).alias("scale"), F.count("lagged").alias("n"))
    short = F.raise_error(F.concat(F.lit("history too short for a scale in "), "series")).cast("double")
    return scales.select("series", F.when(F.col("n") > 0, F.col("scale")).otherwise(short).alias("scale"))


def dm_columns(horizon: Column) -> tuple[Column, Column]:
    """(statistic, rows) of a group with ``d`` = ordered array of loss differences and ``d_mean``; no variance gives 0. [D1]

    Autocovariances are normalised by the number of rows; the small-sample factor is that of Harvey, Leybourne and Newbold.
    """
    n = F.size("d").cast("double")
    mean = F.col("d_mean")  # a column: an expression would be worked out anew for every element
    e = F.transform("d", lambda x: x - mean)

    def covariance(lag: Column) -> Column:
        length = F.size("d") - lag
        pairs = F.zip_with(F.slice(e, F.lit(1), length), F.slice(e, lag + 1, length), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n

    lags = F.when(horizon > 1, F.sequence(F.lit(1), (horizon - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    variance = (covariance(F.lit(0)) + 2 * F.aggregate(lags, F.lit(0.0), lambda s, k: s + covariance(k))) / n
    factor = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    return F.when(variance <= 0, 0.0).otherwise(mean / F.sqrt(variance) * factor), n


def dm_statistics(rows: DataFrame, keys: Sequence[str], loss_a: Column, loss_b: Column, horizon: Column | None = None) -> DataFrame:
    """(keys, dm_stat, dm_n) per group in order of origin_index; NULL below max(8, 2 * horizon) rows. [D1]

    A group's differences are gathered as one array: a group is one series at one step.
    """
    h = horizon if horizon is not None else (F.col("horizon_step") if "horizon_step" in keys else F.lit(1))
    sorted_d = F.transform(F.array_sort(F.collect_list(F.struct("origin_index", "horizon_step", (loss_a - loss_b).alias("v")))), lambda x: x["v"])
    groups = rows.groupBy(*keys).agg(sorted_d.alias("d"), F.avg(loss_a - loss_b).alias("d_mean"))
    stat, n = dm_columns(h)
    enough = n >= F.greatest(F.lit(float(DM_LEAST_ROWS)), 2 * h.cast("double"))
    return groups.select(*keys, F.when(enough, stat).alias("dm_stat"), F.size("d").cast("bigint").alias("dm_n"))


def accuracy(predictions: DataFrame, scales: DataFrame, keys: Sequence[str] = ("mode", "transform", "series", "horizon_step"), baseline: str = "naive", significance: bool = True) -> DataFrame:
    """Per group: n, mae, rmse, smape, mase of forecast and baseline, relative_mae_vs_baseline, skill, dm_stat. Groups with a NULL key are left out. [A12 A13]

    Scales go to the rows of their series, 1 for others.
    """
    base = F.col(f"baseline_{baseline}")
    rows = predictions.where("observed").where(" and ".join(f"{k} is not null" for k in keys))
    scaled = rows.join(scales, "series", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    err, base_err = F.abs(F.col("actual") - F.col("forecast")), F.abs(F.col("actual") - base)
    out = scaled.groupBy(*keys).agg(
        F.count("*").alias("n"), M.mae("actual", "forecast").alias("mae"), M.mae("actual", base).alias("baseline_mae"), M.rmse("actual", "forecast").alias("rmse"),
        M.smape("actual", "forecast").alias("smape"), F.avg(err / F.col("scale")).alias("mase"), F.avg(base_err / F.col("scale")).alias("baseline_mase"),
    )
    out = out.withColumn("relative_mae_vs_baseline", M.ratio(F.col("mae"), F.col("baseline_mae"))).withColumn("skill", 1 - F.col("relative_mae_vs_baseline"))
    if not significance:
        return out
    dm = dm_statistics(rows, keys, err, base_err)
    on = [out[k] == dm[k] for k in keys]
    return out.join(dm, on).select(*(out[c] for c in out.columns), dm["dm_stat"])


def calibration(predictions: DataFrame, keys: Sequence[str] = ("mode", "transform", "series", "horizon_step")) -> DataFrame:
    """Per group: n, pinball_avg, coverage_p10_p90, pit_mean. [A14]"""
    rows = predictions.where("observed").withColumn("pit", M.pit("actual"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), M.mean_pinball("actual").alias("pinball_avg"), M.coverage("actual").alias("coverage_p10_p90"), F.avg("pit").alias("pit_mean"))


def calibration_curve(predictions: DataFrame, group: str) -> DataFrame:
    """(group, level, empirical, gap): share of actual values at or below each quantile. [A17]"""
    rows = predictions.where("observed").unpivot([group, "actual"], list(QUANTILES), "q", "quantile")
    level = F.element_at(F.create_map(*(F.lit(x) for pair in zip(QUANTILES, LEVELS, strict=True) for x in pair)), F.col("q"))
    out = rows.groupBy(group, level.alias("level")).agg(F.avg((F.col("actual") <= F.col("quantile")).cast("double")).alias("empirical"))
    return out.withColumn("gap", F.col("empirical") - F.col("level"))


def curve_pivot(curve: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Level by group, empirical shares in the cells. [R8]"""
    return curve.groupBy("level").pivot(group, list(values)).agg(F.first("empirical"))


def quantile_bins(predictions: DataFrame, steps: Sequence[int] = (1, 7, 28)) -> DataFrame:
    """(horizon_step, bin_index, label, count, fraction, nominal_fraction, n): all ten bins of every step that has rows. [A19]"""
    spark = predictions.sparkSession
    rows = predictions.where("observed").where(F.col("horizon_step").isin(*steps)).withColumn("bin_index", M.quantile_bin("actual"))
    counts = rows.groupBy("horizon_step", "bin_index").agg(F.count("*").alias("count"))
    labels = ["≤ q10", *(f"({a:.1f}, {b:.1f}]" for a, b in zip(LEVELS[:-1], LEVELS[1:], strict=True)), "> q90"]
    bins = spark.createDataFrame(list(enumerate(labels)), "bin_index bigint, label string")
    totals = counts.groupBy("horizon_step").agg(F.sum("count").alias("n"))
    full = totals.crossJoin(F.broadcast(bins)).join(counts, ["horizon_step", "bin_index"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return full.select("horizon_step", "bin_index", "label", "count", (F.col("count") / F.col("n")).alias("fraction"), F.lit(0.1).alias("nominal_fraction"), "n")


def leaderboard(predictions: DataFrame, scales: DataFrame, keys: Sequence[str] = ("mode", "transform", "series", "horizon_step"), baselines: Sequence[str] = BASELINES, significance: bool = False) -> DataFrame:
    """Accuracy against every baseline, rows without that baseline's value left out for it alone. One aggregation for all of them. [A15]"""
    names = [f"baseline_{b}" for b in baselines if f"baseline_{b}" in predictions.columns]
    if not names:
        raise ValueError("no baseline column is present")
    ids = list(dict.fromkeys([*keys, "series", "origin_index", "horizon_step", "actual", "observed", "forecast"]))
    long = predictions.unpivot(ids, names, "baseline_method", "baseline_value").where("baseline_value is not null")
    long = long.withColumn("baseline_method", F.regexp_replace("baseline_method", "^baseline_", "")).withColumnRenamed("baseline_value", "baseline_any")
    return accuracy(long, scales, ["baseline_method", *keys], "any", significance)


def aggregate_leaderboard(board: DataFrame, keys: Sequence[str], weight: str = "n") -> DataFrame:
    """Across series, NULL keys kept: n_cards, median and weighted mean of the ratio, and both skills. [A16]"""
    r, w = F.col("relative_mae_vs_baseline"), F.col(weight)
    out = board.groupBy(*keys).agg(F.countDistinct("series").alias("n_cards"), F.percentile(r, 0.5).alias("relative_mae_median"), F.try_divide(F.sum(r * w), F.sum(w)).alias("relative_mae_weighted"))
    return out.withColumn("skill_median", 1 - F.col("relative_mae_median")).withColumn("skill_weighted", 1 - F.col("relative_mae_weighted"))


def horizon_profile(acc: DataFrame, cal: DataFrame, mode: str = "univariate", transform: str = "identity") -> DataFrame:
    """Per step: mean, least and largest ratio over series, and mean coverage. [A20]"""
    own = lambda df: df.where((F.col("mode") == mode) & (F.col("transform") == transform))
    r = "relative_mae_vs_baseline"
    by_step = own(acc).groupBy("horizon_step").agg(F.avg(r).alias("relative_mae_mean"), F.min(r).alias("relative_mae_min"), F.max(r).alias("relative_mae_max"))
    return by_step.join(own(cal).groupBy("horizon_step").agg(F.avg("coverage_p10_p90").alias("coverage_mean")), "horizon_step", "left")


def naive_gap(predictions: DataFrame, horizon_step: int = 1, group: str = "series") -> DataFrame:
    """How far the forecast is from the naive one, against how far the series moved; all targets count. [A21]"""
    f, b, a = F.col("forecast"), F.col("baseline_naive"), F.col("actual")
    rows = predictions.where(F.col("horizon_step") == horizon_step)
    out = rows.groupBy(group).agg(
        F.avg(F.abs(f - b)).alias("mean_abs_dev_from_naive"), F.avg(F.abs(a - b)).alias("mean_abs_actual_move"),
        F.try_divide(F.covar_pop(f, b), F.stddev_pop(f) * F.stddev_pop(b)).alias("r"), F.count("*").alias("n"),
    )
    ratio = F.when(F.col("mean_abs_actual_move") > 0, F.col("mean_abs_dev_from_naive") / F.col("mean_abs_actual_move"))
    return out.select(group, "mean_abs_dev_from_naive", "mean_abs_actual_move", ratio.alias("ratio"), F.when(F.col("n") > 1, F.col("r")).alias("corr"), "n")


def series_ratios(acc: DataFrame) -> DataFrame:
    """Mean ratio of each series, ascending. [A28]"""
    return acc.groupBy("series").agg(F.avg("relative_mae_vs_baseline").alias("mean_ratio")).orderBy("mean_ratio", "series")


def wis_summary(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted interval score of observed rows by group. [P4]"""
    rows = predictions.where("observed").withColumn("wis", M.weighted_interval_score("actual"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("wis").alias("wis"))


def width_summary(predictions: DataFrame, scales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean width from q10 to q90 over the scale of the series. [P5]"""
    rows = predictions.where("observed").join(scales, "series", "left").withColumn("w", (F.col("q90") - F.col("q10")) / F.coalesce("scale", F.lit(1.0)))
    return rows.groupBy(*keys).agg(F.avg("w").alias("normalised_width"))
