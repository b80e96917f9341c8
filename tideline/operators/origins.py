"""Rolling origins. An origin is the first predicted index: context [o - L, o), targets [o, o + H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_EVENTS = 10_000


def target_indices(origins: DataFrame, horizon: int) -> DataFrame:
    """Rows (…, horizon_step, target_index) for steps 1 to ``horizon``. [W1]"""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    steps = origins.withColumn("horizon_step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return steps.withColumn("target_index", F.col("origin_index") + F.col("horizon_step") - 1)


def valid_origins(panel: DataFrame, context: int, horizon: int, max_origins: int | None = None, stride: int = 1) -> DataFrame:
    """(series, origin_index): origins with a whole context and horizon; the last ``max_origins`` of them, then every ``stride``-th from the first kept. [W3 W6]"""
    if min(context, horizon, stride) < 1 or (max_origins is not None and max_origins < 1):
        raise ValueError("context, horizon, stride and max_origins must be at least 1")
    sizes = Window.partitionBy("series")
    rows = panel.select("series", F.col("idx").alias("origin_index"), F.count("*").over(sizes).alias("n"))
    rows = rows.where((F.col("origin_index") >= context) & (F.col("origin_index") <= F.col("n") - horizon))
    # Origins are consecutive: the first kept one follows from the length of the series alone.
    start = F.greatest(F.lit(context), F.col("n") - horizon - (max_origins - 1)) if max_origins is not None else F.lit(context)
    return rows.where((F.col("origin_index") >= start) & ((F.col("origin_index") - start) % stride == 0)).select("series", "origin_index")


def common_origins(panel: DataFrame, contexts: tuple[int, ...], horizons: tuple[int, ...], stride: int = 1, max_origins: int | None = None) -> DataFrame:
    """Origins that every cell of a grid can use: those of the longest context and horizon. [W6]"""
    return valid_origins(panel, max(contexts), max(horizons), max_origins, stride)


def leaks(predictions: DataFrame, context: int) -> DataFrame:
    """Rows whose context would reach their target; empty for every frame that this package makes. [W4]"""
    return predictions.where((F.col("target_index") < F.col("origin_index")) | (F.col("origin_index") < context))


def nearest_origin(panel: DataFrame, events: DataFrame) -> DataFrame:
    """(series, event, event_date, arm, center): index of the date nearest to each event, the earlier of two; the ends count for dates outside. [W5]

    Events are a dimension table of at most MOST_EVENTS rows, more are refused: each is held against every row of the panel, and reduced before the shuffle.
    """
    if events.limit(MOST_EVENTS + 1).count() > MOST_EVENTS:
        raise ValueError(f"more than {MOST_EVENTS} events")
    gap = F.abs(F.unix_seconds(F.col("date").cast("timestamp")) - F.unix_seconds(F.col("event_date").cast("timestamp")))
    pairs = panel.crossJoin(F.broadcast(events))
    return pairs.groupBy("series", "event", "event_date", "arm").agg(F.min_by("idx", F.struct(gap, "idx")).alias("center"))


def event_windows(panel: DataFrame, events: DataFrame, context: int, before: int, after: int) -> DataFrame:
    """(series, event, event_date, arm, center, origin_index, offset): origins around each event that have a whole context; a window without any is refused. [W7]"""
    ends = panel.groupBy("series").agg(F.count("*").alias("n"))
    centers = nearest_origin(panel, events).join(ends, "series")
    first = F.greatest(F.lit(context), F.col("center") - before)
    last = F.least(F.col("n") - 1, F.col("center") + after)
    empty = F.raise_error(F.concat(F.lit("no origins around event "), "event")).cast("array<bigint>")
    rows = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(empty)
    out = centers.withColumn("origin_index", F.explode(rows))
    return out.select("series", "event", "event_date", "arm", "center", "origin_index", (F.col("origin_index") - F.col("center")).alias("offset"))
