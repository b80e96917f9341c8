"""Event studies: shock days, backtests around events, adaptation lags, regimes, glitches and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schema import GLITCH_JUMP, GLITCH_RETURN, LAG_HEADLINE, LAG_MULTIPLIERS, LAG_RUN, REGIME_DAYS, SHOCK_Z, TINY, VIGNETTE_ROWS
from .forecast import Forecaster, backtest
from .origins import event_windows


def by_idx() -> WindowSpec:
    return Window.partitionBy("series").orderBy("idx")


def shock_days(panel: DataFrame, z_threshold: float = SHOCK_Z) -> DataFrame:
    """(series, idx, date, z): days whose log return is at least that many population deviations from the mean of the whole series. [N2]"""
    if z_threshold <= 0:
        raise ValueError("the threshold must be above 0")
    whole = Window.partitionBy("series")
    rows = panel.select("series", "idx", "date", (F.ln("value") - F.ln(F.lag("value").over(by_idx()))).alias("r"))
    rows = rows.select("*", F.avg("r").over(whole).alias("m"), F.stddev_pop("r").over(whole).alias("s")).where("r is not null and s > 0")
    return rows.withColumn("z", (F.col("r") - F.col("m")) / F.col("s")).where(F.abs("z") >= z_threshold).select("series", "idx", "date", "z")


def validated_events(centers: DataFrame, shocks: DataFrame, tolerance: int) -> DataFrame:
    """(series, event, arm, center, detected): whether a shock day lies within ``tolerance`` rows of the event. [N3]"""
    near = shocks.select("series", F.col("idx").alias("s_idx"))
    on = (centers.series == near.series) & F.col("s_idx").between(F.col("center") - tolerance, F.col("center") + tolerance)
    found = centers.join(near, on, "left_semi").select("series", "event", F.lit(True).alias("hit"))
    return centers.join(found, ["series", "event"], "left").select("series", "event", "arm", "center", F.coalesce("hit", F.lit(False)).alias("detected"))


def shock_backtest(panel: DataFrame, events: DataFrame, forecaster: Forecaster, context: int, before: int, after: int) -> DataFrame:
    """One-step prediction rows around each event, with event, event_date, arm, offset and abs_pct_error. [W7]"""
    windows = event_windows(panel, events, context, before, after)
    rows = backtest(panel, forecaster, context, 1, origins=windows.select("series", "origin_index").distinct())
    out = rows.join(windows.drop("center"), ["series", "origin_index"])
    error = F.abs(F.col("actual") - F.col("forecast")) / F.greatest(F.abs("actual"), F.lit(TINY)) * 100
    return out.withColumn("abs_pct_error", error)


def naive_pct_error(rows: DataFrame) -> DataFrame:
    """Adds the naive forecast's absolute percentage error. [A29]"""
    return rows.withColumn("naive_abs_pct_error", F.abs(F.col("actual") - F.col("baseline_naive")) / F.greatest(F.abs("actual"), F.lit(TINY)) * 100)


def with_regime(rows: DataFrame, days: int = REGIME_DAYS, prefix: str = "market") -> DataFrame:
    """Adds regime: shock up to ``days`` rows around the event, else calm. [A18]"""
    return rows.withColumn("regime", F.when(F.abs("offset") <= days, f"{prefix}_shock").otherwise(f"{prefix}_calm"))


def adaptation_lags(rows: DataFrame, multipliers: Sequence[float] = LAG_MULTIPLIERS, run: int = LAG_RUN) -> DataFrame:
    """(event, arm, series, mode, multiplier, median_error, threshold, adaptation_lag_days). [A22 A23]

    The lag is the first offset from 0 on at which ``run`` errors in a row are at most the multiplier times the median error before the
    event; NULL without rows before it, or if that never happens.
    """
    keys = ["event", "arm", "series", "mode"]
    spark = rows.sparkSession
    before = rows.groupBy(*keys).agg(F.percentile(F.when(F.col("offset") < 0, F.col("abs_pct_error")), 0.5).alias("median_error"))
    thresholds = before.crossJoin(F.broadcast(spark.createDataFrame([(float(m),) for m in multipliers], "multiplier double"))).withColumn("threshold", F.col("median_error") * F.col("multiplier"))
    order = Window.partitionBy(*keys, "multiplier").orderBy("offset")
    after = rows.where("offset >= 0").join(thresholds, keys)
    worst = F.array_max(F.array("abs_pct_error", *(F.lead("abs_pct_error", i).over(order) for i in range(1, run))))
    full = F.lead("offset", run - 1).over(order).isNotNull() if run > 1 else F.lit(True)
    ok = after.withColumn("ok", full & (worst <= F.col("threshold")))
    first = ok.groupBy(*keys, "multiplier").agg(F.min(F.when(F.col("ok"), F.col("offset"))).alias("lag"))
    return thresholds.join(first, [*keys, "multiplier"], "left").select(*keys, "multiplier", "median_error", "threshold", F.col("lag").cast("double").alias("adaptation_lag_days"))


def lag_by_arm(lags: DataFrame) -> DataFrame:
    """Mean lag by arm and multiplier; events that never settle are skipped in the mean and counted apart. [A23]"""
    return lags.groupBy("arm", "multiplier").agg(F.avg("adaptation_lag_days").alias("mean_lag"), F.count_if(F.col("adaptation_lag_days").isNull()).alias("n_not_converged"))


def lag_detail(lags: DataFrame, series: str, mode: str, multiplier: float = LAG_HEADLINE) -> DataFrame:
    """Per event: median error before, threshold, lag, events in the arm. [A24 N4]"""
    own = lags.where((F.col("series") == series) & (F.col("mode") == mode) & (F.col("multiplier") == multiplier))
    n = F.count("*").over(Window.partitionBy("arm"))
    return own.select("event", "arm", F.col("median_error").alias("pre_event_median_error"), "threshold", "adaptation_lag_days", n.alias("n_events_in_arm"))


def glitches(panel: DataFrame) -> DataFrame:
    """(series, idx, date, value, r, r_next): a jump that mostly goes back on the next row; the last row never counts. [N1]"""
    r = F.try_divide(F.col("value") - F.lag("value").over(by_idx()), F.lag("value").over(by_idx()))
    rows = panel.withColumn("r", r).withColumn("r_next", F.lead("r").over(by_idx()))
    return rows.where((F.abs("r") > GLITCH_JUMP) & (F.abs("r_next") > GLITCH_RETURN) & (F.sign("r") != F.sign("r_next"))).select("series", "idx", "date", "value", "r", "r_next")


def glitch_vignette(panel: DataFrame, found: DataFrame, rows: int = VIGNETTE_ROWS) -> DataFrame:
    """The panel's rows around each glitch. [2.13]"""
    g = found.select(F.col("series").alias("g_series"), F.col("idx").alias("glitch_idx"))
    return panel.join(g, (F.col("series") == F.col("g_series")) & F.col("idx").between(F.col("glitch_idx") - rows, F.col("glitch_idx") + rows)).select("series", "glitch_idx", "idx", "date", "value", "observed")


def data_quality(panel: DataFrame) -> DataFrame:
    """Per series: shares observed and filled, longest gap, glitches, range, population deviation of log returns between observed rows. [A25 A26]"""
    observed_before = F.count_if(F.col("observed")).over(by_idx().rowsBetween(Window.unboundedPreceding, 0))
    runs = panel.withColumn("run", observed_before).where(~F.col("observed")).groupBy("series", "run").agg(F.count("*").alias("length"))
    longest = runs.groupBy("series").agg(F.max("length").alias("longest"))
    returns = panel.where("observed").select("series", (F.ln("value") - F.ln(F.lag("value").over(by_idx()))).alias("r"))
    volatility = returns.groupBy("series").agg(F.when(F.count("r") >= 2, F.stddev_pop("r")).alias("volatility"))
    base = panel.groupBy("series").agg(F.count("*").alias("n"), F.avg(F.col("observed").cast("double")).alias("observed_rate"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    counted = glitches(panel).groupBy("series").agg(F.count("*").alias("g"))
    out = base.join(longest, "series", "left").join(volatility, "series", "left").join(counted, "series", "left")
    return out.select(
        "series", "n", "observed_rate", (1 - F.col("observed_rate")).alias("fallback_rate"), F.coalesce("longest", F.lit(0)).cast("bigint").alias("max_gap"),
        F.coalesce("g", F.lit(0)).cast("bigint").alias("n_glitches"), "value_min", "value_max", "volatility",
    )
