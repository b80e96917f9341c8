"""Declarative ablation grids: configuration, cells, dry run, placebo panels and the run of all cells."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forecast import Forecaster, backtest, stacked_backtest, with_ets
from ..operators.origins import common_origins
from ..schema import BASELINES, PREDICTIONS, SEED

MODES = ("univariate", "multivariate", "placebo")
#: Names in configurations and what rows carry.
TRANSFORM_NAMES = {"raw": "identity", "log1p": "log1p"}


@dataclass(frozen=True)
class GridConfig:
    """What a grid runs. [W11]"""

    config_id: str
    context_lengths: tuple[int, ...]
    horizons: tuple[int, ...]
    primary_horizons: tuple[int, ...] = ()
    origin_stride: int = 1
    max_origins: int | None = None
    series: tuple[str, ...] = ()
    transforms: tuple[str, ...] = ("raw", "log1p")
    make_positive: tuple[bool, ...] = (False, True)
    modes: tuple[str, ...] = ("univariate", "multivariate")
    placebo_panel_size: int = 7
    placebo_seed: int = SEED
    season_length: int | None = None
    baselines: tuple[str, ...] = ("naive", "drift")

    def __post_init__(self) -> None:
        problems = [
            (not self.config_id, "config_id is empty"),
            (not self.context_lengths, "context_lengths is empty"),
            (not self.horizons, "horizons is empty"),
            (any(x < 1 for x in self.context_lengths), "context_lengths must be positive"),
            (any(x < 1 for x in self.horizons), "horizons must be positive"),
            (not set(self.modes) <= set(MODES), f"modes must be among {MODES}"),
            (not set(self.transforms) <= set(TRANSFORM_NAMES), f"transforms must be among {tuple(TRANSFORM_NAMES)}"),
            (not set(self.baselines) <= set(BASELINES), f"baselines must be among {BASELINES}"),
            (self.placebo_panel_size < 1, "placebo_panel_size must be at least 1"),
            (self.origin_stride < 1, "origin_stride must be at least 1"),
            (not set(self.primary_horizons) <= set(self.horizons), "primary_horizons must be among horizons"),
        ]
        for wrong, text in problems:
            if wrong:
                raise ValueError(text)

    @classmethod
    def load(cls, path: str) -> GridConfig:
        """From JSON; missing fields are named in the error. [SC9]"""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        missing = [n for n in ("config_id", "context_lengths", "horizons") if n not in raw]
        if missing:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})


def cells(spark: SparkSession, config: GridConfig, pool: int) -> DataFrame:
    """(cell, context_len, horizon, transform, make_positive, mode) in order of the configuration; placebo only for a pool larger than its panel. [W8]"""

    modes = [m for m in config.modes if m != "placebo" or pool > config.placebo_panel_size]
    rows = enumerate(product(config.context_lengths, config.horizons, config.transforms, config.make_positive, modes))
    return spark.createDataFrame([(i, *row) for i, row in rows], "cell bigint, context_len bigint, horizon bigint, transform string, make_positive boolean, mode string")


def placebo_panel(pool: Sequence[str], size: int, seed: int = SEED) -> tuple[str, ...]:
    """A seeded draw without replacement; a pool that is too small is refused. [W9]"""
    if size > len(pool):
        raise ValueError(f"cannot draw {size} of {len(pool)}")
    return tuple(random.Random(seed).sample(list(pool), size))


def _own_series(panel: DataFrame, config: GridConfig) -> DataFrame:
    """The series that the configuration names, or all if it names none."""
    return panel.where(F.col("series").isin(*config.series)) if config.series else panel


def dry_run(spark: SparkSession, config: GridConfig, panel: DataFrame | None, pool: int) -> DataFrame:
    """One row: config_id, n_origins, n_combos, n_skipped, pool, estimated_calls. No forecaster runs. [W10]"""
    if panel is None:
        n = spark.range(1).select(F.col("id").alias("n_origins"))
    else:
        origins = common_origins(_own_series(panel, config), config.context_lengths, config.horizons, config.origin_stride, config.max_origins)
        n = origins.groupBy("series").count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("n_origins"))
    grid = cells(spark, config, pool).agg(F.count("*").alias("n_combos"), F.count_if(F.col("mode") == "univariate").alias("n_uni"))
    full = len(config.context_lengths) * len(config.horizons) * len(config.transforms) * len(config.make_positive) * len(config.modes)
    calls = F.col("n_origins") * (F.col("n_uni") * pool + F.col("n_combos") - F.col("n_uni"))
    return n.crossJoin(grid).select(
        F.lit(config.config_id).alias("config_id"), "n_origins", "n_combos", (F.lit(full) - F.col("n_combos")).cast("bigint").alias("n_skipped"),
        F.lit(pool).cast("bigint").alias("pool"), calls.alias("estimated_calls"),
    )


def run_grid(panel: DataFrame, config: GridConfig, forecaster: Callable[[int], Forecaster]) -> DataFrame:
    """Prediction rows of all cells with config_id, context_len and requested_horizon; no rows where ``cells`` has none. [K4]

    All cells use the same origins. Built-in forecasters give the same step for every horizon, so each context, mode, transform and
    positivity runs once at the longest horizon and shorter ones are cut from its rows. Placebo cells are multivariate runs over the
    drawn panel. Rows have every closed-form baseline, and exponential smoothing where the configuration names it.
    """
    panel = _own_series(panel, config)
    origins = common_origins(panel, config.context_lengths, config.horizons, config.origin_stride, config.max_origins)
    modes, drawn = config.modes, panel
    if "placebo" in modes:
        pool = sorted(r.series for r in panel.select("series").distinct().collect())
        if len(pool) > config.placebo_panel_size:
            drawn = panel.where(F.col("series").isin(*placebo_panel(pool, config.placebo_panel_size, config.placebo_seed)))
        else:
            modes = tuple(m for m in modes if m != "placebo")
    out = panel.sparkSession.createDataFrame([], f"{PREDICTIONS}, context_len bigint")
    longest = max(config.horizons)
    for context, mode, transform, positive in product(config.context_lengths, modes, config.transforms, config.make_positive):
        own = drawn if mode == "placebo" else panel
        how = {"transform": TRANSFORM_NAMES[transform], "season": config.season_length, "origins": origins}
        if mode == "univariate":
            rows = backtest(own, forecaster(context), context, longest, make_positive=positive, **how)
        else:
            rows = stacked_backtest(own, context, longest, make_positive=positive, mode=mode, **how)
        if "ets" in config.baselines:
            rows = with_ets(rows, own, context, longest, **how)
        out = out.unionByName(rows.withColumn("context_len", F.lit(context).cast("bigint")))
    steps = F.explode(F.array(*(F.lit(h).cast("bigint") for h in config.horizons)))
    out = out.withColumn("requested_horizon", steps).where(F.col("horizon_step") <= F.col("requested_horizon"))
    return out.withColumn("config_id", F.lit(config.config_id))
