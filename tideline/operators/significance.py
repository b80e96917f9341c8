"""p-values, bootstrap intervals, false discovery rates and conformal intervals."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from math import ceil, isnan

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..schema import SEED


def dm_pvalues(stats: DataFrame) -> DataFrame:
    """Adds dm_p, two-sided by Student's t with dm_n - 1 degrees of freedom; NULL without a statistic. [D1]"""

    @F.pandas_udf("double")
    def p(stat: pd.Series, n: pd.Series) -> pd.Series:
        out = special.t_two_sided(stat.to_numpy(float), n.to_numpy(float) - 1)
        return pd.Series(np.where(np.isnan(out), None, out), dtype=object).astype("Float64")

    return stats.withColumn("dm_p", F.when(F.col("dm_stat").isNotNull(), p("dm_stat", F.col("dm_n").cast("double"))))


#: Draws worked on at once.
DRAWS_AT_ONCE = 64
#: Multiplier and modulus of the generator of block starts, which SQL can follow.
_MULTIPLIER, _MODULUS = 48271, 2147483647


def block_starts(first: int, draws: int, blocks: int, places: int, seed: int) -> np.ndarray:
    """Where the blocks of draws ``first`` on begin, 0 to places - 1: (draws, blocks), from integers mixed by squares modulo a prime."""
    d = np.arange(first, first + draws, dtype=np.int64)[:, None]
    b = np.arange(blocks, dtype=np.int64)[None, :]
    x = (d * _MULTIPLIER + seed) % _MODULUS
    for add in (b + 1, d + 7, b + 13):
        x = (x * _MULTIPLIER + add) % _MODULUS
        x = (x * x % _MODULUS + add) % _MODULUS
    return x % places


def block_means(values: np.ndarray, block: int, draws: int, seed: int) -> np.ndarray:
    """Means of moving-block resamples of the rows of ``values``, each as long as ``values``; blocks are shared by its columns.

    Sums of blocks are differences of running sums, so memory is linear in the rows, and a block a draw is one subtraction.
    """
    n = len(values)
    if not 1 <= block <= n:
        raise ValueError(f"block of {block} for {n} rows")
    blocks = -(-n // block)
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    sizes = np.append(np.full(blocks - 1, block), n - (blocks - 1) * block)  # the last block fills up
    out = []
    for first in range(0, draws, DRAWS_AT_ONCE):
        starts = block_starts(first, min(DRAWS_AT_ONCE, draws - first), blocks, n - block + 1, seed)
        out.append((sums[starts + sizes] - sums[starts]).sum(axis=1) / n)
    return np.concatenate(out)


def bootstrap(rows: DataFrame, keys: Sequence[str], value: str, block: int, draws: int = 1000, level: float = 0.9, seed: int = SEED, order: str = "origin_index") -> DataFrame:
    """(keys, n, mean, low, high): percentile interval of a mean by moving blocks; a group shorter than a block is refused. [D2]

    A group is one series at one step; it is sorted before it is resampled, so the result does not depend on partitioning.
    """
    tail = (1 - level) / 2

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = f.sort_values(order)[value].to_numpy(float)
        means = block_means(v, block, draws, seed)
        low, high = np.quantile(means, [tail, 1 - tail])
        return pd.DataFrame([{**{k: f[k].iloc[0] for k in keys}, "n": len(v), "mean": v.mean(), "low": low, "high": high}])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "n bigint, mean double, low double, high double"])
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def _error_gap(baseline: str) -> Column:
    return F.abs(F.col("actual") - F.col(f"baseline_{baseline}")) - F.abs(F.col("actual") - F.col("forecast"))


def paired_bootstrap(predictions: DataFrame, keys: Sequence[str], horizon: int, block: int | None = None, baseline: str = "naive", **more) -> DataFrame:
    """Interval of the mean of baseline error minus forecast error; the block is at least the horizon. [P1]"""
    block = horizon if block is None else block
    if block < horizon:
        raise ValueError("the block must be at least the horizon")
    return bootstrap(predictions.where("observed").withColumn("delta", _error_gap(baseline)), keys, "delta", block, **more)


def panel_bootstrap(predictions: DataFrame, block: int, draws: int = 1000, level: float = 0.9, seed: int = SEED, baseline: str = "naive") -> DataFrame:
    """(horizon_step, n_series, n, mean, low, high): one draw of blocks for all series, each trimmed to the shortest from its end. [P2 P10]"""
    rows = predictions.where("observed").select("horizon_step", "series", "origin_index", _error_gap(baseline).alias("delta"))
    tail = (1 - level) / 2

    def run(f: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("origin_index")["delta"].to_numpy(float) for _, g in f.groupby("series", sort=True)]
        n = min(map(len, groups))
        matrix = np.stack([g[len(g) - n :] for g in groups], axis=1)
        means = block_means(matrix.mean(axis=1), block, draws, seed)
        low, high = np.quantile(means, [tail, 1 - tail])
        return pd.DataFrame([{"horizon_step": f["horizon_step"].iloc[0], "n_series": len(groups), "n": n, "mean": matrix.mean(), "low": low, "high": high}])

    return rows.groupBy("horizon_step").applyInPandas(run, "horizon_step bigint, n_series bigint, n bigint, mean double, low double, high double")


def bh_qvalues(rows: DataFrame, p: str, family: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds q_value, Benjamini-Hochberg within each family; NULL p-values stay NULL and do not count. [P6]"""
    own = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    known = F.col(p).isNotNull()
    ranked = rows.withColumn("m", F.count(p).over(own)).withColumn("rank", F.when(known, F.row_number().over(own.orderBy(F.col(p).asc_nulls_last(), *order))))
    scaled = ranked.withColumn("scaled", F.col(p) * F.col("m") / F.col("rank"))
    back = own.orderBy(F.col("rank").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("q_value", F.when(known, F.least(F.min("scaled").over(back), F.lit(1.0)))).drop("m", "rank", "scaled")


def significance_table(acc: DataFrame, boot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy rows with p-value, q-value over all of them, and bootstrap interval where there is one. [P7]"""
    table = bh_qvalues(dm_pvalues(acc.withColumn("dm_n", F.col("n"))), "dm_p", (), keys)
    return table.join(boot.select(*keys, "mean", "low", "high"), list(keys), "left")


def clopper_pearson(counts: DataFrame, hits: str, total: str, alpha: float = 0.05) -> DataFrame:
    """Adds cp_low and cp_high; NULL without rows. [P3]"""

    @F.pandas_udf("cp_low double, cp_high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([special.clopper_pearson(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)], columns=["cp_low", "cp_high"])

    out = counts.withColumn("cp", F.when(F.col(total) > 0, interval(hits, total)))
    return out.select(*counts.columns, "cp.cp_low", "cp.cp_high")


def conformal(predictions: DataFrame, alpha: float = 0.2, least: int = 20, keys: Sequence[str] = ("series", "horizon_step")) -> DataFrame:
    """Adds calibration_n, threshold, conformal_low and conformal_high. [P8]

    Scores max(q10 - actual, actual - q90) of strictly earlier observed rows calibrate a row, at least ``least`` of them; the threshold is
    their value of rank min(ceil((n + 1)(1 - alpha)), n) and may be negative.
    """
    score = F.when(F.col("observed"), F.greatest(F.col("q10") - F.col("actual"), F.col("actual") - F.col("q90")))
    rows = predictions.withColumn("score", score)
    added = [T.StructField("calibration_n", T.LongType()), T.StructField("threshold", T.DoubleType())]

    def run(group: pa.Table) -> pa.Table:
        """A series at one step, in order: earlier scores are kept sorted, so memory is linear in its rows."""
        group = group.sort_by("origin_index")
        seen: list[float] = []
        counts, thresholds = [], []
        for x in group.column("score").to_pylist():
            n = len(seen)
            counts.append(n)
            thresholds.append(seen[max(1, min(ceil((n + 1) * (1 - alpha)), n)) - 1] if n >= max(1, least) else None)
            if x is not None and not isnan(x):
                insort(seen, x)
        return group.append_column("calibration_n", pa.array(counts, pa.int64())).append_column("threshold", pa.array(thresholds, pa.float64()))

    rows = rows.groupBy(*keys).applyInArrow(run, T.StructType([*rows.schema, *added])).drop("score")
    return rows.withColumn("conformal_low", F.col("q10") - F.col("threshold")).withColumn("conformal_high", F.col("q90") + F.col("threshold"))


def conformal_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage before and after on observed rows with a threshold, and how many rows had none. [P9]"""
    a, used = F.col("actual"), F.col("threshold").isNotNull()
    inside = lambda lo, hi: F.avg(F.when(used, ((a >= F.col(lo)) & (a <= F.col(hi))).cast("double")))
    return rows.where("observed").groupBy(*keys).agg(F.count_if(used).alias("n"), F.count_if(~used).alias("n_skipped"), inside("q10", "q90").alias("coverage_raw"), inside("conformal_low", "conformal_high").alias("coverage_conformal"))
