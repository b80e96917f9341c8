"""Baselines, forecasters and the rolling-origin backtest.

Everything that needs rows around an origin comes from window frames over (series, idx): one exchange and one sort serve
the context statistics, the season's last values and the targets, so no join of origins with contexts or targets is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from time import perf_counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BASELINES, LEVELS, PREDICTION_COLUMNS, QUANTILES
from .panel import TRANSFORMS


@dataclass(frozen=True)
class Forecaster:
    """A forecaster as column expressions.

    context: name to aggregate over the context frame (the transformed value is in ``v``). point and quantile: of the context
    columns, ``ctx_last`` and ``horizon_step`` (and the level).
    """

    name: str
    point: Callable[[], Column]
    quantile: Callable[[float], Column]
    context: dict[str, Callable[[Window], Column]] = field(default_factory=dict)


def last_plus_level() -> Forecaster:
    """Test double: the last value, quantiles the last value plus the level. [M7]"""
    return Forecaster("last_plus_level", lambda: F.col("ctx_last"), lambda level: F.col("ctx_last") + level)


def empirical_step(context: int) -> Forecaster:
    """Last value; quantiles from one-step differences inside the context, scaled by the root of the step. A stand-in for an external model."""

    def steps(_: Window) -> Column:
        frame = Window.partitionBy("series").orderBy("idx").rowsBetween(-(context - 1), -1)
        return F.percentile(F.col("v_step"), F.array(*(F.lit(level) for level in LEVELS))).over(frame)

    return Forecaster(
        "empirical_step",
        lambda: F.col("ctx_last"),
        lambda level: F.col("ctx_last") + F.sqrt(F.col("horizon_step").cast("double")) * F.element_at("ctx_steps", LEVELS.index(level) + 1),
        {"ctx_steps": steps},
    )


def contexts(panel: DataFrame, context: int, horizon: int, transform: str = "identity", season: int | None = None, forecaster: Forecaster | None = None) -> DataFrame:
    """One row for each (series, idx): what precedes it (ctx_*), the season before it and the targets from it on, as arrays. [W2 K3]"""
    forward, _ = TRANSFORMS[transform]
    order = Window.partitionBy("series").orderBy("idx")
    past = order.rowsBetween(-context, -1)
    rows = panel.withColumn("v", forward(F.col("value"))).withColumn("v_step", F.col("v") - F.lag("v").over(order))
    out = rows.select(
        "series", F.col("idx").alias("origin_index"), F.col("date").alias("origin_date"),
        F.first("v").over(past).alias("ctx_first"), F.last("v").over(past).alias("ctx_last"), F.min("value").over(past).alias("ctx_low"), F.count("v").over(past).alias("ctx_n"),
        *((F.collect_list("v").over(order.rowsBetween(-season, -1)) if season else F.array().cast("array<double>")).alias("ctx_season"),),
        F.collect_list(F.struct("idx", "date", "value", "observed")).over(order.rowsBetween(0, horizon - 1)).alias("targets"),
        *(agg(past).alias(name) for name, agg in (forecaster.context if forecaster else {}).items()),
    )
    return out.where(F.col("ctx_n") == context)


def _baseline_columns(season: int | None) -> dict[str, Column]:
    """Baselines in the transformed domain; NULL where the season does not fit. Exponential smoothing is left NULL: ``with_ets`` fills it. [B1 B2 B3]"""
    h = F.col("horizon_step")
    drift = F.col("ctx_last") + (F.col("ctx_last") - F.col("ctx_first")) / (F.col("ctx_n") - 1) * h
    seasonal = F.get("ctx_season", ((h - 1) % season).cast("int")) if season else F.lit(None).cast("double")
    return {"naive": F.col("ctx_last"), "drift": drift, "seasonal_naive": seasonal, "ets": F.lit(None).cast("double")}


def backtest(
    panel: DataFrame,
    forecaster: Forecaster,
    context: int,
    horizon: int,
    *,
    transform: str = "identity",
    make_positive: bool = False,
    season: int | None = None,
    mode: str = "univariate",
    origins: DataFrame | None = None,
) -> DataFrame:
    """Prediction rows of every origin, or of ``origins`` (series, origin_index), in the fixed schema. [K1 K3]

    Without ``origins`` those with a whole context and horizon are taken; with them, targets beyond the end are left out. The transform
    holds for contexts, is undone on forecasts, quantiles and baselines, and does not touch actual.
    make_positive cuts forecasts at 0 where the context has no value below 0. baseline_ets is NULL, ``with_ets`` fills it.
    """
    if context < 2:
        raise ValueError("a drift needs a context of at least 2")
    _, back = TRANSFORMS[transform]
    rows = contexts(panel, context, horizon, transform, season if season and season <= context else None, forecaster)
    rows = rows.where(F.size("targets") == horizon) if origins is None else rows.join(origins, ["series", "origin_index"], "left_semi")
    rows = rows.select("*", F.posexplode("targets").alias("step", "t")).withColumn("horizon_step", (F.col("step") + 1).cast("bigint"))

    def positive(c: Column) -> Column:
        return F.when(F.col("ctx_low") >= 0, F.greatest(c, F.lit(0.0))).otherwise(c) if make_positive else c

    base = _baseline_columns(season if season and season <= context else None)
    return rows.select(
        F.lit(mode).alias("mode"), F.lit(transform).alias("transform"), F.lit(make_positive).alias("make_positive"), "series", "origin_index", "origin_date",
        F.col("t.idx").alias("target_index"), F.col("t.date").alias("target_date"), "horizon_step", F.col("t.value").alias("actual"), F.col("t.observed").alias("observed"),
        positive(back(forecaster.point())).alias("forecast"),
        *(positive(back(forecaster.quantile(level))).alias(q) for q, level in zip(QUANTILES, LEVELS, strict=True)),
        *(back(base[b]).alias(f"baseline_{b}") for b in BASELINES),
    )


def stacked_backtest(
    panel: DataFrame,
    context: int,
    horizon: int,
    *,
    pull: float = 0.5,
    transform: str = "identity",
    make_positive: bool = False,
    season: int | None = None,
    mode: str = "multivariate",
    origins: DataFrame | None = None,
) -> DataFrame:
    """Multivariate run with a forecaster that sees all series of an origin: each moves towards the mean growth of the panel. [K2]

    The stack of an origin is its row of every series; the growth of all of them is averaged by origin and joined back.
    Point: last * (1 + pull * mean growth over the context * step / (L - 1)); quantiles: point plus the level; both in the transformed domain and turned back.
    transform, make_positive, season and origins as in ``backtest``, but a whole horizon is always needed.
    """
    _, back = TRANSFORMS[transform]
    fits = season if season and season <= context else None
    rows = contexts(panel, context, horizon, transform, fits).where(F.size("targets") == horizon)
    rows = rows if origins is None else rows.join(origins, ["series", "origin_index"], "left_semi")
    growth = rows.groupBy("origin_index").agg(F.avg(F.try_divide(F.col("ctx_last") - F.col("ctx_first"), "ctx_first")).alias("growth"))
    rows = rows.join(growth, "origin_index")
    rows = rows.select("*", F.posexplode("targets").alias("step", "t")).withColumn("horizon_step", (F.col("step") + 1).cast("bigint"))
    point = F.col("ctx_last") * (1 + pull * F.col("growth") * F.col("horizon_step") / (context - 1))

    def positive(c: Column) -> Column:
        return F.when(F.col("ctx_low") >= 0, F.greatest(c, F.lit(0.0))).otherwise(c) if make_positive else c

    base = _baseline_columns(fits)
    return rows.select(
        F.lit(mode).alias("mode"), F.lit(transform).alias("transform"), F.lit(make_positive).alias("make_positive"), "series", "origin_index", "origin_date",
        F.col("t.idx").alias("target_index"), F.col("t.date").alias("target_date"), "horizon_step", F.col("t.value").alias("actual"), F.col("t.observed").alias("observed"),
        positive(back(point)).alias("forecast"), *(positive(back(point + level)).alias(q) for q, level in zip(QUANTILES, LEVELS, strict=True)),
        *(back(base[b]).alias(f"baseline_{b}") for b in BASELINES),
    )


#: A plug-in takes contexts (rows, L) and the horizon; it gives points (rows, H) and quantiles (rows, H, 9).
Plugin = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def check_quantiles(quantiles: np.ndarray, rows: int, horizon: int) -> None:
    """Refuses quantiles of the wrong shape or that fall by more than 1e-6. [M3]"""
    if quantiles.shape != (rows, horizon, len(LEVELS)):
        raise ValueError(f"quantiles of shape {quantiles.shape}, wanted {(rows, horizon, len(LEVELS))}")
    if (np.diff(quantiles, axis=2) < -1e-6).any():
        raise ValueError("quantiles must not fall")


def _with_results(rows: pa.Table | pa.RecordBatch, plugin: Plugin, context: int, horizon: int, stack: bool) -> pa.RecordBatch:
    """Rows with points, quantiles and the milliseconds that the call for all of them took in place of their contexts."""
    at = rows.schema.names.index("ctx")
    column = rows.column(at).combine_chunks() if isinstance(rows, pa.Table) else rows.column(at)
    ctx = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), context)
    began = perf_counter()
    point, quantiles = plugin(ctx[None] if stack else ctx, horizon)
    took = pa.array(np.full(len(ctx), (perf_counter() - began) * 1000))
    point, quantiles = (point[0], quantiles[0]) if stack else (point, quantiles)
    check_quantiles(quantiles, len(ctx), horizon)
    ends = lambda n, step: pa.array(np.arange(0, n * step + 1, step, dtype=np.int32))
    points = pa.ListArray.from_arrays(ends(len(ctx), horizon), pa.array(point.astype(float).ravel()))
    levels = pa.ListArray.from_arrays(ends(len(ctx) * horizon, len(LEVELS)), pa.array(quantiles.astype(float).ravel()))
    columns = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in zip(rows.schema.names, rows.columns, strict=True) if n != "ctx"}
    return pa.RecordBatch.from_pydict(columns | {"points": points, "quantiles": pa.ListArray.from_arrays(ends(len(ctx), horizon), levels), "latency_ms": took})


def _plugin_rows(panel: DataFrame, context: int, horizon: int, transform: str, season: int | None, origins: DataFrame | None) -> tuple[DataFrame, T.StructType]:
    """Rows that carry their transformed context and their targets through Python, and the schema that comes back."""
    carried = Forecaster("plugin", lambda: F.col("ctx_last"), lambda _: F.col("ctx_last"), {"ctx": lambda past: F.collect_list("v").over(past)})
    rows = contexts(panel, context, horizon, transform, season if season and season <= context else None, carried).where(F.size("targets") == horizon)
    rows = rows if origins is None else rows.join(origins, ["series", "origin_index"], "left_semi")
    numbers = T.ArrayType(T.DoubleType())
    made = [T.StructField("points", numbers), T.StructField("quantiles", T.ArrayType(numbers)), T.StructField("latency_ms", T.DoubleType())]
    return rows, T.StructType([*(f for f in rows.schema if f.name != "ctx"), *made])


def _plugin_predictions(made: DataFrame, mode: str, context: int, transform: str, make_positive: bool, season: int | None, latency: bool) -> DataFrame:
    """Prediction rows of what a plug-in gave: turned back, cut at 0 where asked for, NaN as NULL."""
    _, back = TRANSFORMS[transform]
    rows = made.select("*", F.posexplode("targets").alias("step", "t")).withColumn("horizon_step", (F.col("step") + 1).cast("bigint")).withColumn("q", F.get("quantiles", F.col("step")))

    def final(c: Column) -> Column:
        c = back(F.when(~F.isnan(c), c))
        return F.when((F.col("ctx_low") >= 0) & c.isNotNull(), F.greatest(c, F.lit(0.0))).otherwise(c) if make_positive else c

    base = _baseline_columns(season if season and season <= context else None)
    return rows.select(
        F.lit(mode).alias("mode"), F.lit(transform).alias("transform"), F.lit(make_positive).alias("make_positive"), "series", "origin_index", "origin_date",
        F.col("t.idx").alias("target_index"), F.col("t.date").alias("target_date"), "horizon_step", F.col("t.value").alias("actual"), F.col("t.observed").alias("observed"),
        final(F.get("points", F.col("step"))).alias("forecast"), *(final(F.get("q", F.lit(i))).alias(q) for i, q in enumerate(QUANTILES)),
        *(back(base[b]).alias(f"baseline_{b}") for b in BASELINES), *(["latency_ms"] if latency else []),
    )


def plugin_backtest(
    panel: DataFrame,
    plugin: Plugin,
    context: int,
    horizon: int,
    *,
    transform: str = "identity",
    make_positive: bool = False,
    season: int | None = None,
    origins: DataFrame | None = None,
    partitions: int | None = None,
    latency: bool = False,
) -> DataFrame:
    """Prediction rows of a forecaster that runs in Python, in Arrow batches. [M1 M2]

    Rows carry their context and their targets through Python, so nothing is joined back and their order does not matter; they are
    spread over tasks by (series, origin) after the windows, so that few long series still keep all workers busy. The plug-in sees
    transformed contexts; transform, make_positive and season as in ``backtest``. With ``latency`` rows have latency_ms, the milliseconds of the
    call that made them, which a batch of rows shares.
    """
    rows, schema = _plugin_rows(panel, context, horizon, transform, season, origins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _with_results(batch, plugin, context, horizon, stack=False)

    keys = ["series", "origin_index"]
    spread = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return _plugin_predictions(spread.mapInArrow(run, schema), "univariate", context, transform, make_positive, season, latency)


def univariate_only(plugin: Plugin) -> Plugin:
    """For models that take one series at a time: refuses a stack of series, an array of three axes. [M6]"""

    def run(contexts: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
        if np.ndim(contexts) != 2:
            raise ValueError("this model takes one series at a time")
        return plugin(contexts, horizon)

    return run


def stacked_plugin_backtest(
    panel: DataFrame,
    plugin: Plugin,
    context: int,
    horizon: int,
    *,
    transform: str = "identity",
    make_positive: bool = False,
    season: int | None = None,
    origins: DataFrame | None = None,
    latency: bool = False,
) -> DataFrame:
    """Prediction rows of a multivariate plug-in: contexts (1, series, L) to points (1, series, H) and quantiles (1, series, H, 9). [K2 M1 C6]

    An origin's series are gathered in order of their names; an origin that not all series have is refused. An origin is one row a series.
    Options as in ``plugin_backtest``.
    """
    rows, schema = _plugin_rows(panel, context, horizon, transform, season, origins)
    n_series = panel.select(F.countDistinct("series").alias("n_series"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("series")
        if len(group) != group.column("n_series")[0].as_py() or len(group.column("origin_date").unique()) > 1:
            raise ValueError(f"origin {group.column('origin_index')[0].as_py()} is not aligned across series")
        return pa.Table.from_batches([_with_results(group.drop_columns("n_series"), plugin, context, horizon, stack=True)])

    made = rows.crossJoin(n_series).groupBy("origin_index").applyInArrow(run, schema)  # one number
    return _plugin_predictions(made, "multivariate", context, transform, make_positive, season, latency)


def at_horizon(predictions: DataFrame, horizon: int, most: int) -> DataFrame:
    """The rows that a shorter run would have given. [M4]"""
    if horizon > most:
        raise ValueError(f"horizon {horizon} is longer than {most}")
    return predictions.where(F.col("horizon_step") <= horizon)


def holt(context: np.ndarray, horizon: int, season: int | None = None) -> np.ndarray:
    """Exponential smoothing with additive trend, and additive season where two seasons fit; parameters by a coarse, then a fine grid of squared one-step errors. [B4]"""
    y = np.asarray(context, float)
    if len(y) < 4:
        raise ValueError("exponential smoothing needs at least 4 values")
    m = season if season and len(y) >= 2 * season else 0

    def run(a: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parameter sets at once: squared error and forecasts."""
        k = len(a)
        level = np.full(k, y[:m].mean() if m else y[0])
        trend = np.full(k, (y[m : 2 * m].mean() - y[:m].mean()) / m if m else y[1] - y[0])
        s = np.tile(y[:m] - y[:m].mean(), (k, 1)) if m else np.zeros((k, 1))
        err = np.zeros(k)
        for t in range(m or 1, len(y)):
            seasonal = s[:, t % m] if m else 0.0
            e = y[t] - (level + trend + seasonal)
            err += e * e
            before = level
            level = level + trend + a * e
            trend = trend + a * b * e
            if m:
                s[:, t % m] = s[:, t % m] + g * (1 - a) * e
            del before
        steps = np.arange(1, horizon + 1)
        out = level[:, None] + trend[:, None] * steps
        return err, out + s[:, (len(y) + steps - 1) % m] if m else out

    def grid(a: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(x.ravel() for x in np.meshgrid(np.clip(a, 0, 1), np.clip(b, 0, 1), np.clip(g, 0, 1), indexing="ij"))

    coarse = np.linspace(0.05, 0.95, 7)
    sets = grid(coarse, coarse, coarse[::2] if m else np.zeros(1))
    best = [x[int(np.argmin(run(*sets)[0]))] for x in sets]
    near = np.linspace(-0.1, 0.1, 5)
    sets = grid(best[0] + near, best[1] + near, best[2] + near if m else np.zeros(1))
    err, out = run(*sets)
    return out[int(np.argmin(err))]


def ets_baseline(panel: DataFrame, context: int, horizon: int, *, season: int | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(series, origin_index, horizon_step, baseline_ets): one fit for each origin; NULL where it fails. [B4 B5]"""
    order = Window.partitionBy("series").orderBy("idx")
    rows = panel.select("series", F.col("idx").alias("origin_index"), F.collect_list("value").over(order.rowsBetween(-context, -1)).alias("ctx")).where(F.size("ctx") == context)
    rows = rows if origins is None else rows.join(origins, ["series", "origin_index"], "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ctx in f["ctx"]:
                try:
                    fit = holt(ctx, horizon, season)
                    out.append(list(fit) if np.isfinite(fit).all() else None)
                except (ValueError, FloatingPointError):
                    out.append(None)
            yield f[["series", "origin_index"]].assign(fit=out)

    made = rows.repartition("series", "origin_index").mapInPandas(run, "series string, origin_index bigint, fit array<double>")
    return made.select("series", "origin_index", F.posexplode_outer(F.coalesce("fit", F.array_repeat(F.lit(None).cast("double"), horizon))).alias("step", "baseline_ets")).select("series", "origin_index", (F.col("step") + 1).cast("bigint").alias("horizon_step"), "baseline_ets")


def with_ets(predictions: DataFrame, panel: DataFrame, context: int, horizon: int, *, season: int | None = None, transform: str = "identity", origins: DataFrame | None = None) -> DataFrame:
    """Prediction rows with baseline_ets filled from the fit of their own origin; NULL only where the fit fails. [B5]

    ``context``, ``horizon``, ``season``, ``transform`` and ``origins`` are those of the run that made the rows: the fit sees the transformed context and is turned back.
    """
    forward, back = TRANSFORMS[transform]
    fits = ets_baseline(panel.withColumn("value", forward(F.col("value"))), context, horizon, season=season, origins=origins)
    keys = ["series", "origin_index", "horizon_step"]
    return predictions.drop("baseline_ets").join(fits.withColumn("baseline_ets", back(F.col("baseline_ets"))), keys, "left").select(*predictions.columns)


assert set(PREDICTION_COLUMNS) >= {f"baseline_{b}" for b in BASELINES}
