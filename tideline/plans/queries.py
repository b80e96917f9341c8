"""Registered queries over the relational tables and the same results in DuckDB SQL.

Prices come out with 4 digits, ratios and shares with 6, rounded the same way in both, as sums of doubles depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..operators import covariates, events, forecast, origins, panel, score, significance, slices
from ..schema import BASELINES, HORIZON, LEVELS, QUANTILES, SEED
from ..sources import panels, vendor
from . import grid

L, H, SEASON = 64, 7, 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def digits(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.withColumns({c: rounded(c, n) for c in names})


def r(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.501) / 1e{n}"


# ---- common table expressions -------------------------------------------------------------------------------------------

MEAN = "CAST(sum(CAST({0} AS DECIMAL(20,2))) AS DOUBLE) / count({0})"
DAILY = f"daily AS (SELECT l_returnflag AS series, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS date, {MEAN.format('l_extendedprice')} AS value FROM lineitem GROUP BY ALL)"
MARKET = DAILY + """,
keep AS (SELECT date FROM daily GROUP BY date HAVING count(value) = (SELECT count(DISTINCT series) FROM daily) AND min(value) > 0),
market AS (SELECT series, date, value, true AS observed, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx FROM daily WHERE date IN (SELECT date FROM keep))"""
ACTIVITY = f"""hourly AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, {MEAN.format('value')} AS value FROM events GROUP BY ALL),
cal AS (SELECT s.series, g.date FROM (SELECT DISTINCT series FROM hourly) s CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM hourly) g),
filled AS (SELECT c.series, c.date, last_value(h.value IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value,
  h.value IS NOT NULL AS observed FROM cal c LEFT JOIN hourly h ON h.series = c.series AND h.date = c.date),
activity AS (SELECT series, date, value, observed, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx FROM filled WHERE value IS NOT NULL)"""
EVENTS = "ev AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{d}', '{a}')" for n, d, a in panels.EVENTS) + ") t(event, event_date, arm))"


def backtest_sql(source: str, context: int = L, horizon: int = H, season: int | None = SEASON, quantiles: str = "step", transform: str = "identity", name: str = "bt") -> str:
    """The rows of forecast.backtest over a panel."""
    f, b = ("ln(1 + value)", "exp({}) - 1") if transform == "log1p" else ("value", "{}")
    if quantiles == "step":
        qs = ", ".join(b.format(f"o.last + sqrt(h) * o.steps[{i + 1}]") + f" AS {q}" for i, q in enumerate(QUANTILES))
    else:
        qs = ", ".join(b.format(f"o.last + {level}") + f" AS {q}" for q, level in zip(QUANTILES, LEVELS, strict=True))
    seasonal = b.format("s.v") if season else "CAST(NULL AS DOUBLE)"
    join = f"LEFT JOIN {name}_v s ON s.series = o.series AND s.idx = o.idx - {season} + (h - 1) % {season}" if season else ""
    return f"""{name}_v AS (SELECT series, idx, date, value, observed, {f} AS v, {f} - lag({f}) OVER (PARTITION BY series ORDER BY idx) AS step FROM {source}),
{name}_c AS (SELECT series, idx, date, first_value(v) OVER w AS first, last_value(v) OVER w AS last, count(v) OVER w AS n, count(*) OVER (PARTITION BY series) AS total,
  quantile_cont(step, {list(LEVELS)}) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {context - 1} PRECEDING AND 1 PRECEDING) AS steps
  FROM {name}_v WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN {context} PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT o.series, o.idx AS origin_index, o.date AS origin_date, t.idx AS target_index, t.date AS target_date, h AS horizon_step, t.value AS actual, t.observed,
  {b.format('o.last')} AS forecast, {qs}, {b.format('o.last')} AS baseline_naive, {b.format(f'o.last + (o.last - o.first) / {context - 1} * h')} AS baseline_drift, {seasonal} AS baseline_seasonal_naive
  FROM {name}_c o CROSS JOIN range(1, {horizon + 1}) x(h) JOIN {name}_v t ON t.series = o.series AND t.idx = o.idx + h - 1 {join} WHERE o.n = {context} AND o.idx <= o.total - {horizon})"""


BT = f"WITH {MARKET}, {backtest_sql('market')}"
AT = f"WITH {ACTIVITY}, {backtest_sql('activity')}"


def market_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.backtest(panels.market(spark, sf_dir), forecast.empirical_step(L), L, H, season=SEASON)


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.backtest(panels.activity(spark, sf_dir), forecast.empirical_step(L), L, H, season=SEASON)


# ---- panels ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ACTIVITY} SELECT series, date, idx, value, observed FROM activity")
def panel_dense_ffill(spark, sf_dir):
    return panels.activity(spark, sf_dir).select("series", "date", "idx", "value", "observed")


@query(f"WITH {MARKET} SELECT series, date, idx, value, observed FROM market")
def panel_intersection(spark, sf_dir):
    return panels.market(spark, sf_dir).select("series", "date", "idx", "value", "observed")


@query(f"""WITH {DAILY}, n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM daily GROUP BY series)),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM daily)
SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx FROM b, n WHERE back <= least""")
def panel_trim_shortest(spark, sf_dir):
    return panel.trim_shortest(panels.market_days(spark, sf_dir)).select("series", "date", "value", "idx")


@query(f"""WITH {DAILY} SELECT date, count(*) AS n FROM daily GROUP BY date HAVING count(*) <> (SELECT count(DISTINCT series) FROM daily)""")
def panel_unaligned(spark, sf_dir):
    return panel.unaligned_dates(panels.market_days(spark, sf_dir))


_CHECK = """SELECT '{0}' AS panel, check_name, CAST(n AS BIGINT) AS violations FROM (
  SELECT count(*) FILTER (WHERE date <= before) AS dates_not_rising, count(*) FILTER (WHERE value IS NULL) AS values_missing, count(*) FILTER (WHERE NOT isfinite(value)) AS values_not_finite
  FROM (SELECT *, lag(date) OVER (PARTITION BY series ORDER BY date) AS before FROM {0})) UNPIVOT (n FOR check_name IN (dates_not_rising, values_missing, values_not_finite))"""


@query(f"WITH {MARKET}, {ACTIVITY} {_CHECK.format('market')} UNION ALL {_CHECK.format('activity')}")
def panel_checks(spark, sf_dir):
    both = [panel.violations(p).select(F.lit(n).alias("panel"), "check_name", "violations") for n, p in (("market", panels.market(spark, sf_dir)), ("activity", panels.activity(spark, sf_dir)))]
    return both[0].unionByName(both[1])


@query(f"""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date, {MEAN.format('o_totalprice')} AS v FROM orders GROUP BY ALL),
y AS (SELECT date, (v - lag(v, 12) OVER (ORDER BY date)) / nullif(lag(v, 12) OVER (ORDER BY date), 0) * 100 AS yoy FROM m)
SELECT date, {r('yoy', 6)} AS yoy FROM y WHERE yoy IS NOT NULL AND date <= DATE '2000-12-31'""")
def yoy_change(spark, sf_dir):
    return digits(panel.year_on_year(panels.monthly_orders(spark, sf_dir), "date", "value", until="2000-12-31"), 6, "yoy")


# ---- vendor rows --------------------------------------------------------------------------------------------------------

_VENDOR = """v AS (SELECT l_orderkey, l_partkey, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS market, l_extendedprice * 0.95 AS mid,
  CASE WHEN l_linestatus = 'F' THEN 'Normal' ELSE 'Foil' END AS subtype, l_extendedprice AS price FROM lineitem),
used AS (SELECT 'market_then_mid' AS policy, coalesce(market, mid) AS p, CASE WHEN market IS NOT NULL THEN 'market' ELSE 'mid' END AS field_used FROM v
  UNION ALL SELECT 'market_only', market, CASE WHEN market IS NOT NULL THEN 'market' END FROM v UNION ALL SELECT 'mid_only', mid, 'mid' FROM v)"""


def _priced(spark, sf_dir):
    rows, out = panels.vendor_rows(spark, sf_dir), None
    for policy in vendor.POLICIES:
        p, used = vendor.price(policy, F.col("market"), F.col("mid"))
        own = rows.select(F.lit(policy).alias("policy"), p.alias("p"), used.alias("field_used"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {_VENDOR} SELECT policy, count(*) AS n, count(p) AS n_priced, {r('avg(p)', 4)} AS mean_price FROM used GROUP BY policy")
def price_policy(spark, sf_dir):
    return digits(_priced(spark, sf_dir).groupBy("policy").agg(F.count("*").alias("n"), F.count("p").alias("n_priced"), F.avg("p").alias("mean_price")), 4, "mean_price")


@query(f"""WITH {_VENDOR}, c AS (SELECT policy, field_used, count(*) AS n FROM used WHERE field_used IS NOT NULL GROUP BY ALL)
SELECT policy, field_used, n, {r('n / sum(n) OVER (PARTITION BY policy)', 6)} AS fraction FROM c""")
def price_field_fractions(spark, sf_dir):
    return digits(vendor.field_fractions(_priced(spark, sf_dir), ["policy"]), 6, "fraction")


@query(f"""WITH {_VENDOR}, g AS (SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (WHERE subtype = 'Normal') AS good, max(price) AS any_p, max(CASE WHEN subtype = 'Normal' THEN price END) AS good_p FROM v GROUP BY l_orderkey)
SELECT l_orderkey, n_rows, CASE WHEN n_rows = 1 THEN any_p WHEN good = 1 THEN good_p END AS value,
  CASE WHEN n_rows = 1 THEN 'single' WHEN good = 1 THEN 'preferred' ELSE 'conflict' END AS outcome FROM g""")
def duplicate_resolution(spark, sf_dir):
    return vendor.resolve_duplicates(panels.vendor_rows(spark, sf_dir), ["l_orderkey"], "subtype", "price", conflicts="null")


_SPECS = [("one", "africa", "nation_0"), ("two", "ASIA", "Nation_2"), ("three", "EUROPE", "NATION_3"), ("miss", "AFRICA", "NATION_9x"), ("nowhere", "ATLANTIS", "NATION_1")]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(map(str, _SPECS))}) t(label, abbr, product)),
f AS (SELECT label, product, r_regionkey AS group_id FROM s LEFT JOIN region ON upper(abbr) = upper(r_name))
SELECT label, CAST(group_id AS BIGINT) AS group_id, CAST(n_nationkey AS BIGINT) AS product_id FROM f LEFT JOIN nation ON n_regionkey = group_id AND lower(n_name) = lower(product)""")
def entity_resolution(spark, sf_dir):
    specs = spark.createDataFrame(_SPECS, "label string, group_abbreviation string, product_name string")
    groups = panels.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("group_id"), F.col("r_name").alias("abbreviation"))
    products = panels.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("group_id"), F.col("n_nationkey").cast("bigint").alias("product_id"), F.col("n_name").alias("name"))
    return vendor.resolve_entities(specs, groups, products).select("label", "group_id", "product_id")


_ENTITY = """raw AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS date, 'supplier ' || l_suppkey AS series, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS market, l_extendedprice * 0.95 AS mid,
  l_linestatus = 'F' AS good FROM lineitem WHERE l_suppkey IS NOT NULL),
g AS (SELECT series, date, count(*) AS n, count(*) FILTER (WHERE good) AS ng, max(market) AS m1, max(mid) AS d1, max(CASE WHEN good THEN market END) AS m2, max(CASE WHEN good THEN mid END) AS d2 FROM raw GROUP BY ALL),
one AS (SELECT series, date, CASE WHEN n = 1 THEN m1 WHEN ng = 1 THEN m2 END AS market, CASE WHEN n = 1 THEN d1 WHEN ng = 1 THEN d2 END AS mid FROM g),
pr AS (SELECT series, date, coalesce(market, mid) AS v, CASE WHEN market IS NOT NULL THEN 'market' WHEN mid IS NOT NULL THEN 'mid' END AS used FROM one),
cal AS (SELECT s.series, d.date FROM (SELECT DISTINCT series FROM pr) s CROSS JOIN (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM pr) d),
fill AS (SELECT c.series, c.date, last_value(v IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value, v IS NOT NULL AS observed FROM cal c LEFT JOIN pr ON pr.series = c.series AND pr.date = c.date)"""


def _entity_series(spark, sf_dir):
    """Every supplier of lineitem."""
    rows = panels.table(spark, sf_dir, "lineitem").select(
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("date"), F.col("l_suppkey").alias("product_id"), F.when(F.col("l_linestatus") == "F", "Normal").otherwise("Foil").alias("subtype"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("market"), (F.col("l_extendedprice") * 0.95).alias("mid"),
    )
    ids = rows.where("product_id is not null").select(F.col("product_id").alias("id")).distinct()
    entities = ids.select(F.concat(F.lit("supplier "), "id").alias("label"), F.col("id").alias("product_id"))
    return vendor.entity_series(rows, entities, conflicts="null", unfilled="drop")


@query(f"WITH {_ENTITY} SELECT series, date, {r('value', 4)} AS value, observed, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS idx FROM fill WHERE value IS NOT NULL")
def entity_series(spark, sf_dir):
    return digits(_entity_series(spark, sf_dir)[0].select("series", "date", "value", "observed", "idx"), 4, "value")


@query(f"WITH {_ENTITY} SELECT series, used AS field_used, count(*) AS n FROM pr WHERE used IS NOT NULL GROUP BY ALL")
def entity_price_usage(spark, sf_dir):
    return _entity_series(spark, sf_dir)[1]


# ---- origins -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {MARKET}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM market),
v AS (SELECT series, idx AS origin_index, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS back FROM n WHERE idx BETWEEN 64 AND n - 28)
SELECT series, origin_index FROM v WHERE back <= 200""")
def valid_origins(spark, sf_dir):
    return origins.valid_origins(panels.market(spark, sf_dir), 64, 28, 200)


@query(f"""WITH {MARKET}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM market),
v AS (SELECT series, idx AS origin_index, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS back FROM n WHERE idx BETWEEN 64 AND n - 28),
k AS (SELECT series, origin_index, row_number() OVER (PARTITION BY series ORDER BY origin_index) AS rn FROM v WHERE back <= 200)
SELECT series, origin_index FROM k WHERE (rn - 1) % 5 = 0""")
def common_origins(spark, sf_dir):
    return origins.common_origins(panels.market(spark, sf_dir), (32, 64), (7, 28), 5, 200)


_CENTER = """pairs AS (SELECT series, event, event_date, arm, idx, abs(epoch(date) - epoch(event_date)) AS gap FROM market CROSS JOIN ev),
center AS (SELECT series, event, event_date, arm, idx AS center FROM pairs QUALIFY row_number() OVER (PARTITION BY series, event ORDER BY gap, idx) = 1)"""
_WINDOWS = _CENTER + """,
wins AS (SELECT c.*, m.idx AS origin_index, m.idx - c.center AS "offset" FROM center c JOIN market m ON m.series = c.series AND m.idx BETWEEN greatest(256, c.center - 12) AND c.center + 25)"""


@query(f"WITH {MARKET}, {EVENTS}, {_CENTER} SELECT * FROM center")
def nearest_origin(spark, sf_dir):
    return origins.nearest_origin(panels.market(spark, sf_dir), panels.events(spark))


@query(f"WITH {MARKET}, {EVENTS}, {_WINDOWS} SELECT * FROM wins")
def event_windows(spark, sf_dir):
    return origins.event_windows(panels.market(spark, sf_dir), panels.events(spark), 256, 12, 25)


# ---- grid ------------------------------------------------------------------------------------------------------------------

GRID = grid.GridConfig("small", (32, 64), (1, 7), (7,), origin_stride=5, max_origins=200, modes=("univariate", "placebo"), baselines=("naive", "drift"))
_AXIS = lambda name, values: f"(SELECT * FROM (VALUES {', '.join(f'({i}, {v!r})' for i, v in enumerate(values))}) t({name}_at, {name}))"
_CELLS = f"""cells AS (SELECT CAST((((context_len_at * 2 + horizon_at) * 2 + transform_at) * 2 + make_positive_at) * 2 + mode_at AS BIGINT) AS cell, CAST(context_len AS BIGINT) AS context_len,
  CAST(horizon AS BIGINT) AS horizon, transform, make_positive, mode FROM {_AXIS('context_len', (32, 64))} CROSS JOIN {_AXIS('horizon', (1, 7))} CROSS JOIN {_AXIS('transform', ('raw', 'log1p'))}
  CROSS JOIN {_AXIS('make_positive', (False, True))} CROSS JOIN {_AXIS('mode', ('univariate', 'placebo'))})"""


@query(f"WITH {_CELLS} SELECT * FROM cells")
def grid_cells(spark, sf_dir):
    return grid.cells(spark, GRID, pool=9)


@query(f"""WITH {MARKET}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM market), v AS (SELECT series, idx, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS back FROM n WHERE idx BETWEEN 64 AND n - 7),
k AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY idx) AS rn FROM v WHERE back <= 200), o AS (SELECT min(c) AS n_origins FROM (SELECT count(*) AS c FROM k WHERE (rn - 1) % 5 = 0 GROUP BY series))
SELECT 'small' AS config_id, n_origins, CAST(16 AS BIGINT) AS n_combos, CAST(16 AS BIGINT) AS n_skipped, CAST(3 AS BIGINT) AS pool, n_origins * 16 * 3 AS estimated_calls FROM o""")
def dry_run(spark, sf_dir):
    return grid.dry_run(spark, GRID, panels.market(spark, sf_dir), pool=3)


def _grid_sql() -> str:
    parts, rows = [], []
    for context in (32, 64):
        for transform in ("identity", "log1p"):
            name = f"b{context}{transform[:1]}"
            parts.append(backtest_sql("market", context, 7, None, "step", transform, name))
            for positive in (False, True):
                cut = (lambda x: f"greatest({x}, 0)") if positive else (lambda x: x)  # prices are above 0, so every context is; drift baselines may fall below
                for h in (1, 7):
                    rows.append(
                        f"SELECT '{transform}' AS transform, {positive} AS make_positive, {context} AS context_len, {h} AS requested_horizon, series, origin_index, horizon_step, actual, "
                        f"{cut('forecast')} AS forecast, {cut('baseline_naive')} AS naive, baseline_drift AS drift FROM {name} WHERE horizon_step <= {h}"
                    )
    keep = "ok AS (SELECT series, 64 AS start, count(*) - 7 AS stop FROM market GROUP BY series)"
    return f"""WITH {MARKET}, {', '.join(parts)}, {keep}, u AS ({' UNION ALL '.join(rows)}),
k AS (SELECT u.* FROM u JOIN ok USING (series) WHERE origin_index >= start AND origin_index <= stop),
long AS (SELECT *, 'naive' AS baseline_method, naive AS b FROM k UNION ALL SELECT *, 'drift', drift FROM k),
acc AS (SELECT baseline_method, transform, make_positive, context_len, requested_horizon, series, count(*) AS n, avg(abs(actual - forecast)) / avg(abs(actual - b)) AS rel FROM long GROUP BY ALL)
SELECT baseline_method, transform, make_positive, CAST(context_len AS BIGINT) AS context_len, CAST(requested_horizon AS BIGINT) AS requested_horizon, count(DISTINCT series) AS n_cards,
  {r('quantile_cont(rel, 0.5)', 6)} AS relative_mae_median, {r('sum(rel * n) / sum(n)', 6)} AS relative_mae_weighted FROM acc GROUP BY ALL"""


def _grid_board(spark, sf_dir, config):
    p = panels.market(spark, sf_dir)
    rows = grid.run_grid(p, config, forecast.empirical_step)
    keys = ["transform", "make_positive", "context_len", "requested_horizon", "series"]
    board = score.leaderboard(rows, score.mase_scales(p, 64), keys, config.baselines)
    out = score.aggregate_leaderboard(board, ["baseline_method", *keys[:-1]])
    return digits(out, 6, "relative_mae_median", "relative_mae_weighted").drop("skill_median", "skill_weighted")


@query(_grid_sql())
def grid_backtest_leaderboard(spark, sf_dir):
    """The grid over all valid origins; positivity holds for forecasts only, as in backtest()."""
    return _grid_board(spark, sf_dir, replace(GRID, origin_stride=1, max_origins=None))


# ---- backtests -------------------------------------------------------------------------------------------------------------

_FACT = ["series", "origin_index", "origin_date", "target_index", "target_date", "horizon_step", "actual", "observed"]
_FACT_SQL = ", ".join(_FACT)


@query(f"WITH {ACTIVITY}, {backtest_sql('activity', quantiles='level')} SELECT {_FACT_SQL}, {r('forecast', 4)} AS forecast, {r('q90', 4)} AS q90, {r('baseline_naive', 4)} AS baseline_naive, {r('baseline_drift', 4)} AS baseline_drift, {r('baseline_seasonal_naive', 4)} AS baseline_seasonal_naive FROM bt")
def backtest_naive_drift_seasonal(spark, sf_dir):
    rows = forecast.backtest(panels.activity(spark, sf_dir), forecast.last_plus_level(), L, H, season=SEASON)
    names = ["forecast", "q90", "baseline_naive", "baseline_drift", "baseline_seasonal_naive"]
    return digits(rows.select(*_FACT, *names), 4, *names)


@query(f"WITH {ACTIVITY}, {backtest_sql('activity', transform='log1p')} SELECT {_FACT_SQL}, {r('forecast', 4)} AS forecast, {r('q10', 4)} AS q10, {r('baseline_drift', 4)} AS baseline_drift FROM bt")
def backtest_log1p(spark, sf_dir):
    rows = forecast.backtest(panels.activity(spark, sf_dir), forecast.empirical_step(L), L, H, season=SEASON, transform="log1p")
    return digits(rows.select(*_FACT, "forecast", "q10", "baseline_drift"), 4, "forecast", "q10", "baseline_drift")


@query(f"{AT} SELECT series, origin_index, horizon_step, {', '.join(f'{r(q, 4)} AS {q}' for q in QUANTILES)} FROM bt")
def backtest_empirical_quantiles(spark, sf_dir):
    return digits(activity_rows(spark, sf_dir).select("series", "origin_index", "horizon_step", *QUANTILES), 4, *QUANTILES)


@query(f"""{BT}, g AS (SELECT idx AS origin_index, avg((last - first) / nullif(first, 0)) AS growth FROM bt_c WHERE n = {L} AND idx <= total - {H} GROUP BY idx)
SELECT series, origin_index, horizon_step, {r('forecast * (1 + 0.5 * growth * horizon_step / 63)', 4)} AS forecast FROM bt JOIN g USING (origin_index)""")
def backtest_stacked(spark, sf_dir):
    rows = forecast.stacked_backtest(panels.market(spark, sf_dir), L, H)
    return digits(rows.select("series", "origin_index", "horizon_step", "forecast"), 4, "forecast")


def median_plugin(contexts: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """A plug-in forecaster: quantiles of the context at every step, its median as the point."""
    q = np.quantile(contexts, LEVELS, axis=1).T
    full = np.repeat(q[:, None, :], horizon, axis=1)
    return full[:, :, 4], full


@query(f"""WITH {MARKET}, c AS (SELECT series, idx AS origin_index, count(*) OVER w AS n, count(*) OVER (PARTITION BY series) AS total, quantile_cont(value, {list(LEVELS)}) OVER w AS q
  FROM market WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING))
SELECT c.series, c.origin_index, h AS horizon_step, {r('q[5]', 4)} AS forecast, {r('q[1]', 4)} AS q10, {r('q[9]', 4)} AS q90 FROM c CROSS JOIN range(1, {H + 1}) x(h) WHERE n = {L} AND origin_index <= total - {H}""")
def backtest_plugin(spark, sf_dir):
    rows = forecast.plugin_backtest(panels.market(spark, sf_dir), median_plugin, L, H)
    return digits(rows.select("series", "origin_index", "horizon_step", "forecast", "q10", "q90"), 4, "forecast", "q10", "q90")


def _stacked_plugin(spark, sf_dir, horizon):
    """A multivariate plug-in: every series is forecast by the mean of all last values."""

    def mean_of_panel(contexts, horizon):
        point = np.broadcast_to(contexts[:, :, -1:].mean(axis=1, keepdims=True), (*contexts.shape[:2], horizon))
        return point, point[..., None] + np.array(LEVELS)

    rows = forecast.stacked_plugin_backtest(panels.market(spark, sf_dir), mean_of_panel, L, horizon)
    return digits(rows.select("series", "origin_index", "horizon_step", "forecast"), 4, "forecast")


@query(f"WITH {MARKET}, {backtest_sql('market', quantiles='level', horizon=HORIZON)} SELECT series, origin_index, horizon_step, {r('avg(forecast) OVER (PARTITION BY origin_index, horizon_step)', 4)} AS forecast FROM bt")
def backtest_stacked_plugin(spark, sf_dir):
    return _stacked_plugin(spark, sf_dir, HORIZON)


@query()
def ets_baseline(spark, sf_dir):
    p = panels.market(spark, sf_dir)
    return forecast.ets_baseline(p, L, H, season=SEASON, origins=origins.valid_origins(p, L, H))


# ---- scores ----------------------------------------------------------------------------------------------------------------

_SCALES = f"""scales AS (SELECT series, greatest(avg(abs(value - before)), 1e-12) AS scale FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY idx) AS before FROM {{0}} WHERE idx < {L}) GROUP BY series)"""
_ACC = f"""{_SCALES}, acc AS (SELECT b.series, horizon_step, count(*) AS n, avg(abs(actual - forecast)) AS mae, avg(abs(actual - {{1}})) AS baseline_mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse,
  avg(200 * abs(actual - forecast) / CASE WHEN abs(actual) + abs(forecast) = 0 THEN 1e-8 ELSE abs(actual) + abs(forecast) END) AS smape, avg(abs(actual - forecast) / scale) AS mase, avg(abs(actual - {{1}}) / scale) AS baseline_mase
  FROM bt b JOIN scales USING (series) WHERE observed GROUP BY ALL)"""
_ACC_DRIFT = _ACC.format("activity", "baseline_drift")


@query(f"WITH {MARKET}, {_SCALES.format('market')} SELECT series, {r('scale', 4)} AS scale FROM scales")
def mase_scales(spark, sf_dir):
    return digits(score.mase_scales(panels.market(spark, sf_dir), L), 4, "scale")


@query(f"""{AT}, {_ACC_DRIFT} SELECT series, horizon_step, n, {', '.join(f'{r(c, 6)} AS {c}' for c in ('mae', 'baseline_mae', 'rmse', 'smape', 'mase', 'baseline_mase'))},
{r('mae / baseline_mae', 6)} AS relative_mae_vs_baseline, {r('1 - mae / baseline_mae', 6)} AS skill FROM acc""")
def accuracy(spark, sf_dir):
    acc = score.accuracy(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L), baseline="drift", significance=False)
    return digits(acc.drop("mode", "transform"), 6, "mae", "baseline_mae", "rmse", "smape", "mase", "baseline_mase", "relative_mae_vs_baseline", "skill")


_PINBALL = " + ".join(f"avg(greatest({level} * (actual - {q}), ({level} - 1) * (actual - {q})))" for q, level in zip(QUANTILES, LEVELS, strict=True))
_PIT = "CASE WHEN actual >= q90 THEN 0.9 WHEN actual < q10 THEN 0.1 " + " ".join(
    f"WHEN actual >= {a} THEN {la} + {lb - la} * coalesce((actual - {a}) / nullif({b} - {a}, 0), 0)" for a, b, la, lb in reversed(list(zip(QUANTILES[:-1], QUANTILES[1:], LEVELS[:-1], LEVELS[1:], strict=True)))
) + " END"
_CAL = f"calib AS (SELECT series, horizon_step, count(*) AS n, ({_PINBALL}) / 9 AS pinball_avg, avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) AS coverage, avg({_PIT}) AS pit_mean FROM bt WHERE observed GROUP BY ALL)"


@query(f"{AT}, {_CAL} SELECT series, horizon_step, n, {r('pinball_avg', 6)} AS pinball_avg, {r('coverage', 6)} AS coverage_p10_p90, {r('pit_mean', 6)} AS pit_mean FROM calib")
def calibration(spark, sf_dir):
    return digits(score.calibration(activity_rows(spark, sf_dir)).drop("mode", "transform"), 6, "pinball_avg", "coverage_p10_p90", "pit_mean")


_CURVE = " UNION ALL ".join(f"SELECT series, {level} AS level, avg(CASE WHEN actual <= {q} THEN 1.0 ELSE 0.0 END) AS empirical FROM bt WHERE observed GROUP BY series" for q, level in zip(QUANTILES, LEVELS, strict=True))


@query(f"{AT}, c AS ({_CURVE}) SELECT series, CAST(level AS DOUBLE) AS level, {r('empirical', 6)} AS empirical, {r('empirical - level', 6)} AS gap FROM c")
def calibration_curve(spark, sf_dir):
    return digits(score.calibration_curve(activity_rows(spark, sf_dir), "series"), 6, "empirical", "gap")


_BINS = " + ".join(f"CASE WHEN {q} < actual THEN 1 ELSE 0 END" for q in QUANTILES)
_LABELS = "CASE i WHEN 0 THEN '≤ q10' WHEN 9 THEN '> q90' ELSE '(0.' || i || ', 0.' || (i + 1) || ']' END"


@query(f"""{AT}, b AS (SELECT horizon_step, {_BINS} AS i FROM bt WHERE observed AND horizon_step IN (1, 7, 28)), n AS (SELECT horizon_step, count(*) AS n FROM b GROUP BY 1), c AS (SELECT horizon_step, i, count(*) AS c FROM b GROUP BY ALL)
SELECT n.horizon_step, CAST(x.i AS BIGINT) AS bin_index, {_LABELS.replace(' i ', ' x.i ').replace('|| i ||', '|| x.i ||').replace('(i + 1)', '(x.i + 1)')} AS label, coalesce(c, 0) AS count, {r('coalesce(c, 0) / n', 6)} AS fraction, 0.1::DOUBLE AS nominal_fraction, n
FROM n CROSS JOIN range(0, 10) x(i) LEFT JOIN c ON c.horizon_step = n.horizon_step AND c.i = x.i""")
def quantile_bins(spark, sf_dir):
    return digits(score.quantile_bins(activity_rows(spark, sf_dir)), 6, "fraction")


_DM = """d AS (SELECT series, horizon_step, row_number() OVER (PARTITION BY series, horizon_step ORDER BY origin_index) AS rn, abs(actual - forecast) - abs(actual - baseline_drift) AS d FROM bt WHERE observed),
m AS (SELECT series, horizon_step, count(*) AS t, avg(d) AS mean FROM d GROUP BY ALL), e AS (SELECT d.series, d.horizon_step, rn, d - mean AS e FROM d JOIN m USING (series, horizon_step)),
g AS (SELECT a.series, a.horizon_step, k, sum(a.e * b.e) AS s FROM e a CROSS JOIN range(0, 7) x(k) JOIN e b ON b.series = a.series AND b.horizon_step = a.horizon_step AND b.rn = a.rn - k WHERE k < a.horizon_step GROUP BY ALL),
v AS (SELECT series, horizon_step, sum(CASE WHEN k = 0 THEN s ELSE 2 * s END) AS s FROM g GROUP BY ALL),
dm AS (SELECT series, horizon_step, t, CASE WHEN s <= 0 THEN 0.0 ELSE mean / sqrt(s / t / t) * sqrt((t + 1 - 2 * horizon_step + horizon_step * (horizon_step - 1) / t) / t) END AS stat FROM m JOIN v USING (series, horizon_step))"""


def _dm(spark, sf_dir):
    err = lambda c: F.abs(F.col("actual") - F.col(c))
    return score.dm_statistics(activity_rows(spark, sf_dir).where("observed"), ["series", "horizon_step"], err("forecast"), err("baseline_drift"))


@query(f"{AT}, {_DM} SELECT series, horizon_step, {r('stat', 6)} AS dm_stat, t AS dm_n FROM dm")
def dm_statistic(spark, sf_dir):
    return digits(_dm(spark, sf_dir), 6, "dm_stat")


# Student's t by Simpson's rule: with t = sqrt(v) * tan(x) the density is cos(x) ** (v - 1) up to a factor.
_TAIL = """pv AS (SELECT *, CASE WHEN stat IS NOT NULL THEN greatest(0, 1 - 2 * exp(lgamma((t) / 2) - lgamma((t - 1) / 2)) / sqrt(pi()) * atan(abs(stat) / sqrt(t - 1)) / 6000 *
  list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos(atan(abs(stat) / sqrt(t - 1)) * i / 2000) ** (t - 2)))) END AS p
  FROM (SELECT series, horizon_step, t, CASE WHEN t >= greatest(8, 2 * horizon_step) THEN stat END AS stat FROM dm))"""


def _q_sql(family: str) -> str:
    return f"""kq AS (SELECT *, count(p) OVER ({family}) AS m, row_number() OVER ({family} ORDER BY p NULLS LAST, {'horizon_step' if family else 'series, horizon_step'}) AS rk FROM pv),
q AS (SELECT series, horizon_step, least(1, min(p * m / rk) OVER ({family} ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM kq WHERE p IS NOT NULL)"""


@query(f"{AT}, {_DM}, {_TAIL}, {_q_sql('PARTITION BY series')} SELECT pv.series, pv.horizon_step, {r('stat', 6)} AS dm_stat, t AS dm_n, {r('p', 6)} AS dm_p, {r('q', 6)} AS q_value FROM pv LEFT JOIN q USING (series, horizon_step)")
def dm_pvalues(spark, sf_dir):
    return digits(significance.bh_qvalues(significance.dm_pvalues(_dm(spark, sf_dir)), "dm_p", ("series",), ("horizon_step",)), 6, "dm_stat", "dm_p", "q_value")


def _boot_sql(keys: str, source: str, block: int = H, draws: int = 1000) -> str:
    """Moving blocks over rows (keys, i from 0, d): mean and 90 % interval of the resampled means, in ``boot``."""
    start = f"(dr * 48271 + {SEED}) % 2147483647"
    for add in ("(b + 1)", "(dr + 7)", "(b + 13)"):
        start = f"(SELECT (y * y % 2147483647 + {add}) % 2147483647 FROM (SELECT ({start} * 48271 + {add}) % 2147483647 AS y))"
    return f"""{source}, z AS (SELECT {keys}, i + 1 AS i, sum(d) OVER (PARTITION BY {keys} ORDER BY i) AS s FROM d0 UNION ALL SELECT DISTINCT {keys}, 0, 0.0 FROM d0),
nn AS (SELECT {keys}, count(*) AS n, avg(d) AS mean FROM d0 GROUP BY ALL), lens AS (SELECT DISTINCT n, CAST(ceil(n / {block}) AS BIGINT) AS blocks FROM nn),
cells AS (SELECT n, dr, b, blocks FROM lens CROSS JOIN range(0, {draws}) x(dr) JOIN range(0, 100000) w(b) ON b < blocks),
st AS (SELECT n, dr, {start} % (n - {block} + 1) AS start, CASE WHEN b = blocks - 1 THEN n - (blocks - 1) * {block} ELSE {block} END AS size FROM cells),
ms AS (SELECT {keys}, dr, sum(z2.s - z1.s) / n AS m FROM nn JOIN st USING (n) JOIN z z1 USING ({keys}) JOIN z z2 USING ({keys}) WHERE z1.i = start AND z2.i = start + size GROUP BY {keys}, dr, n),
boot AS (SELECT {keys}, n, {r('any_value(mean)', 4)} AS mean, {r('quantile_cont(m, 0.05)', 4)} AS low, {r('quantile_cont(m, 0.95)', 4)} AS high FROM ms JOIN nn USING ({keys}) GROUP BY {keys}, n)"""


_GAP = "abs(actual - baseline_drift) - abs(actual - forecast)"
_OWN_GAPS = f"d0 AS (SELECT series, horizon_step, row_number() OVER (PARTITION BY series, horizon_step ORDER BY origin_index) - 1 AS i, {_GAP} AS d FROM bt WHERE observed)"
_PANEL_GAPS = f"""e0 AS (SELECT series, horizon_step, row_number() OVER (PARTITION BY series, horizon_step ORDER BY origin_index DESC) AS back, count(*) OVER (PARTITION BY series, horizon_step) AS c, {_GAP} AS d FROM bt WHERE observed),
e1 AS (SELECT *, min(c) OVER (PARTITION BY horizon_step) AS least FROM e0), d0 AS (SELECT horizon_step, least - back AS i, avg(d) AS d FROM e1 WHERE back <= least GROUP BY ALL)"""


@query(f"{AT}, {_boot_sql('series, horizon_step', _OWN_GAPS)} SELECT * FROM boot")
def bootstrap_ci(spark, sf_dir):
    return digits(significance.paired_bootstrap(activity_rows(spark, sf_dir), ["series", "horizon_step"], H, baseline="drift"), 4, "mean", "low", "high")


@query(f"{AT}, {_boot_sql('horizon_step', _PANEL_GAPS)} SELECT horizon_step, n_series, n, mean, low, high FROM boot JOIN (SELECT horizon_step, count(DISTINCT series) AS n_series FROM e0 GROUP BY 1) USING (horizon_step)")
def panel_bootstrap(spark, sf_dir):
    return digits(significance.panel_bootstrap(activity_rows(spark, sf_dir), H, baseline="drift"), 4, "mean", "low", "high")


_ACC_NAMES = ("mae", "baseline_mae", "rmse", "smape", "mase", "baseline_mase")


@query(f"""{AT}, {_ACC_DRIFT}, {_DM}, {_TAIL}, {_q_sql('')}, {_boot_sql('series, horizon_step', _OWN_GAPS)}
SELECT acc.series, acc.horizon_step, acc.n, {', '.join(f'{r("acc." + c, 6)} AS {c}' for c in _ACC_NAMES)}, {r('mae / baseline_mae', 6)} AS relative_mae_vs_baseline, {r('1 - mae / baseline_mae', 6)} AS skill,
{r('stat', 6)} AS dm_stat, t AS dm_n, {r('p', 6)} AS dm_p, {r('q', 6)} AS q_value, mean, low, high FROM acc JOIN pv USING (series, horizon_step) LEFT JOIN q USING (series, horizon_step) LEFT JOIN boot USING (series, horizon_step)""")
def significance_table(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    acc = score.accuracy(rows, score.mase_scales(panels.activity(spark, sf_dir), L), ["series", "horizon_step"], "drift")
    table = significance.significance_table(acc, significance.paired_bootstrap(rows, ["series", "horizon_step"], H, baseline="drift"), ["series", "horizon_step"])
    return digits(digits(table, 6, *_ACC_NAMES, "relative_mae_vs_baseline", "skill", "dm_stat", "dm_p", "q_value"), 4, "mean", "low", "high")


_BINOMIAL = "list_sum(list_transform(range({0}, {1}), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({2}) + (n - j) * ln(1 - {2}))))"


@query(f"""{AT.replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT series, horizon_step, count(*) FILTER (WHERE actual BETWEEN q10 AND q90) AS hits, count(*) AS n FROM bt WHERE observed GROUP BY ALL),
b AS (SELECT series, horizon_step, hits, n, 0 AS step, 0.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM c
UNION ALL SELECT series, horizon_step, hits, n, step + 1, CASE WHEN pa < 0.025 THEN am ELSE a0 END, CASE WHEN pa < 0.025 THEN a1 ELSE am END, CASE WHEN pb > 0.025 THEN bm ELSE b0 END, CASE WHEN pb > 0.025 THEN b1 ELSE bm END
  FROM (SELECT *, {_BINOMIAL.format('hits', 'n + 1', 'am')} AS pa, {_BINOMIAL.format('0', 'hits + 1', 'bm')} AS pb FROM (SELECT *, (a0 + a1) / 2 AS am, (b0 + b1) / 2 AS bm FROM b WHERE step < 40)))
SELECT series, horizon_step, hits, n, CASE WHEN hits = 0 THEN 0 ELSE {r('a0', 6)} END AS cp_low, CASE WHEN hits = n THEN 1 ELSE {r('b1', 6)} END AS cp_high FROM b WHERE step = 40""")
def clopper_pearson(spark, sf_dir):
    inside = ((F.col("actual") >= F.col("q10")) & (F.col("actual") <= F.col("q90")))
    counts = activity_rows(spark, sf_dir).where("observed").groupBy("series", "horizon_step").agg(F.count_if(inside).alias("hits"), F.count("*").alias("n"))
    return digits(significance.clopper_pearson(counts, "hits", "n"), 6, "cp_low", "cp_high")


_LONG = " UNION ALL ".join(f"SELECT series, horizon_step, actual, forecast, '{b}' AS baseline_method, baseline_{b} AS b FROM bt WHERE observed AND baseline_{b} IS NOT NULL" for b in BASELINES[:3])
_BOARD = f"""long AS ({_LONG}), board AS (SELECT baseline_method, series, horizon_step, count(*) AS n, avg(abs(actual - forecast)) AS mae, avg(abs(actual - b)) AS bmae FROM long GROUP BY ALL),
rel AS (SELECT *, CASE WHEN bmae = 0 THEN CASE WHEN mae = 0 THEN 0.0 ELSE 'inf'::DOUBLE END ELSE mae / bmae END AS rel FROM board)"""


def _board(spark, sf_dir):
    return score.leaderboard(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L))


@query(f"{AT}, {_BOARD} SELECT baseline_method, series, horizon_step, n, {r('rel', 6)} AS relative_mae_vs_baseline FROM rel")
def leaderboard(spark, sf_dir):
    return digits(_board(spark, sf_dir).select("baseline_method", "series", "horizon_step", "n", "relative_mae_vs_baseline"), 6, "relative_mae_vs_baseline")


@query(f"""{AT}, {_BOARD}, a AS (SELECT baseline_method, horizon_step, count(DISTINCT series) AS n_cards, quantile_cont(rel, 0.5) AS med, sum(rel * n) / sum(n) AS w FROM rel GROUP BY ALL)
SELECT baseline_method, horizon_step, n_cards, {r('med', 6)} AS relative_mae_median, {r('w', 6)} AS relative_mae_weighted, {r('1 - med', 6)} AS skill_median, {r('1 - w', 6)} AS skill_weighted FROM a""")
def leaderboard_aggregate(spark, sf_dir):
    return digits(score.aggregate_leaderboard(_board(spark, sf_dir), ["baseline_method", "horizon_step"]), 6, "relative_mae_median", "relative_mae_weighted", "skill_median", "skill_weighted")


def _ets_board(spark, sf_dir):
    p = panels.activity(spark, sf_dir)
    return score.leaderboard(forecast.with_ets(activity_rows(spark, sf_dir), p, L, H, season=SEASON), score.mase_scales(p, L))


@query()
def leaderboard_ets(spark, sf_dir):
    """The rows of leaderboard and those against exponential smoothing."""
    return digits(_ets_board(spark, sf_dir).select("baseline_method", "series", "horizon_step", "n", "relative_mae_vs_baseline"), 6, "relative_mae_vs_baseline")


@query()
def leaderboard_ets_aggregate(spark, sf_dir):
    return digits(score.aggregate_leaderboard(_ets_board(spark, sf_dir), ["baseline_method", "horizon_step"]), 6, "relative_mae_median", "relative_mae_weighted", "skill_median", "skill_weighted")


@query(f"""{AT}, {_ACC_DRIFT}, {_CAL}, a AS (SELECT horizon_step, avg(mae / baseline_mae) AS m, min(mae / baseline_mae) AS lo, max(mae / baseline_mae) AS hi FROM acc GROUP BY 1), c AS (SELECT horizon_step, avg(coverage) AS c FROM calib GROUP BY 1)
SELECT horizon_step, {r('m', 6)} AS relative_mae_mean, {r('lo', 6)} AS relative_mae_min, {r('hi', 6)} AS relative_mae_max, {r('c', 6)} AS coverage_mean FROM a LEFT JOIN c USING (horizon_step)""")
def horizon_profile(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    acc = score.accuracy(rows, score.mase_scales(panels.activity(spark, sf_dir), L), baseline="drift", significance=False)
    return digits(score.horizon_profile(acc, score.calibration(rows)), 6, "relative_mae_mean", "relative_mae_min", "relative_mae_max", "coverage_mean")


@query(f"""{AT}, {_ACC_DRIFT} SELECT series, {r('avg(mae / baseline_mae)', 6)} AS mean_ratio FROM acc GROUP BY series""")
def series_ratios(spark, sf_dir):
    acc = score.accuracy(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L), baseline="drift", significance=False)
    return digits(score.series_ratios(acc), 6, "mean_ratio")


@query(f"""WITH {ACTIVITY}, {backtest_sql('activity')}, g AS (SELECT series, avg(abs(q60 - baseline_naive)) AS m, avg(abs(actual - baseline_naive)) AS a, covar_pop(q60, baseline_naive) / nullif(stddev_pop(q60) * stddev_pop(baseline_naive), 0) AS c, count(*) AS n FROM bt WHERE horizon_step = 2 GROUP BY series)
SELECT series, {r('m', 6)} AS mean_abs_dev_from_naive, {r('a', 6)} AS mean_abs_actual_move, {r('CASE WHEN a > 0 THEN m / a END', 6)} AS ratio, {r('CASE WHEN n > 1 THEN c END', 6)} AS corr, n FROM g""")
def naive_gap(spark, sf_dir):
    rows = activity_rows(spark, sf_dir).withColumn("forecast", F.col("q60"))  # the point forecast is the naive one itself
    return digits(score.naive_gap(rows, 2), 6, "mean_abs_dev_from_naive", "mean_abs_actual_move", "ratio", "corr")


_WIS = "(0.5 * abs(actual - q50)" + "".join(f" + {a / 2} * (({hi} - {lo}) + {2 / a} * greatest({lo} - actual, 0) + {2 / a} * greatest(actual - {hi}, 0))" for a, lo, hi in ((0.2, "q10", "q90"), (0.4, "q20", "q80"), (0.6, "q30", "q70"), (0.8, "q40", "q60"))) + ") / 4.5"


@query(f"{AT} SELECT series, horizon_step, count(*) AS n, {r(f'avg({_WIS})', 6)} AS wis FROM bt WHERE observed GROUP BY ALL")
def weighted_interval_score(spark, sf_dir):
    return digits(score.wis_summary(activity_rows(spark, sf_dir), ["series", "horizon_step"]), 6, "wis")


@query(f"{AT}, {_SCALES.format('activity')} SELECT series, horizon_step, {r('avg((q90 - q10) / scale)', 6)} AS normalised_width FROM bt JOIN scales USING (series) WHERE observed GROUP BY ALL")
def normalised_width(spark, sf_dir):
    return digits(score.width_summary(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L), ["series", "horizon_step"]), 6, "normalised_width")


@query(f"""{AT}, {_ACC_DRIFT}, p AS (SELECT series, horizon_step, CASE WHEN horizon_step <> 3 THEN least(mae / baseline_mae, 1) END AS p FROM acc),
k AS (SELECT *, count(p) OVER (PARTITION BY series) AS m, row_number() OVER (PARTITION BY series ORDER BY p NULLS LAST, horizon_step) AS rk FROM p),
q AS (SELECT *, min(p * m / rk) OVER (PARTITION BY series ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM k WHERE p IS NOT NULL)
SELECT p.series, p.horizon_step, {r('p.p', 6)} AS p, {r('CASE WHEN q.q IS NOT NULL THEN least(q.q, 1) END', 6)} AS q_value FROM p LEFT JOIN q USING (series, horizon_step)""")
def bh_qvalues(spark, sf_dir):
    """Ratios stand in for p-values, one of them missing: the correction is what is compared."""
    acc = score.accuracy(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L), baseline="drift", significance=False)
    p = acc.select("series", "horizon_step", F.when(F.col("horizon_step") != 3, F.least("relative_mae_vs_baseline", F.lit(1.0))).alias("p"))
    return digits(significance.bh_qvalues(p, "p", ("series",), ("horizon_step",)), 6, "p", "q_value")


_CONF = """s AS (SELECT *, CASE WHEN observed THEN greatest(q10 - actual, actual - q90) END AS score FROM bt),
h AS (SELECT *, list(score) FILTER (WHERE score IS NOT NULL) OVER (PARTITION BY series, horizon_step ORDER BY origin_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s),
t AS (SELECT *, coalesce(len(past), 0) AS cn, CASE WHEN coalesce(len(past), 0) >= 20 THEN list_sort(past)[CAST(least(ceil((len(past) + 1) * 0.8), len(past)) AS BIGINT)] END AS threshold FROM h)"""
_FULL_AT = f"WITH {ACTIVITY}, {backtest_sql('activity', horizon=HORIZON)}"


def _conformal(spark, sf_dir):
    rows = forecast.backtest(panels.activity(spark, sf_dir), forecast.empirical_step(L), L, HORIZON, season=SEASON)
    return significance.conformal(rows)


@query(f"{_FULL_AT}, {_CONF} SELECT series, origin_index, horizon_step, cn AS calibration_n, {r('threshold', 4)} AS threshold, {r('q10 - threshold', 4)} AS conformal_low, {r('q90 + threshold', 4)} AS conformal_high FROM t")
def conformal(spark, sf_dir):
    """All steps of the full horizon."""
    return digits(_conformal(spark, sf_dir).select("series", "origin_index", "horizon_step", "calibration_n", "threshold", "conformal_low", "conformal_high"), 4, "threshold", "conformal_low", "conformal_high")


@query(f"""{_FULL_AT}, {_CONF} SELECT series, horizon_step, count(threshold) AS n, count(*) - count(threshold) AS n_skipped,
{r('avg(CASE WHEN threshold IS NOT NULL THEN CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END END)', 6)} AS coverage_raw,
{r('avg(CASE WHEN threshold IS NOT NULL THEN CASE WHEN actual BETWEEN q10 - threshold AND q90 + threshold THEN 1.0 ELSE 0.0 END END)', 6)} AS coverage_conformal FROM t WHERE observed GROUP BY ALL""")
def conformal_eval(spark, sf_dir):
    return digits(significance.conformal_summary(_conformal(spark, sf_dir), ["series", "horizon_step"]), 6, "coverage_raw", "coverage_conformal")


# ---- events ------------------------------------------------------------------------------------------------------------------

_SHOCKS = """r AS (SELECT series, idx, date, ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY idx)) AS r FROM market), s AS (SELECT *, avg(r) OVER (PARTITION BY series) AS m, stddev_pop(r) OVER (PARTITION BY series) AS sd FROM r),
shocks AS (SELECT series, idx, date, (r - m) / sd AS z FROM s WHERE r IS NOT NULL AND sd > 0 AND abs((r - m) / sd) >= 2.5)"""


@query(f"WITH {MARKET}, {_SHOCKS} SELECT series, idx, date, {r('z', 6)} AS z FROM shocks")
def shock_days(spark, sf_dir):
    return digits(events.shock_days(panels.market(spark, sf_dir), 2.5), 6, "z")


@query(f"""WITH {MARKET}, {EVENTS}, {_CENTER}, {_SHOCKS} SELECT series, event, arm, center, EXISTS (SELECT 1 FROM shocks k WHERE k.series = c.series AND k.idx BETWEEN c.center - 3 AND c.center + 3) AS detected FROM center c""")
def shock_validation(spark, sf_dir):
    p = panels.market(spark, sf_dir)
    return events.validated_events(origins.nearest_origin(p, panels.events(spark)), events.shock_days(p, 2.5), 3)


_SHOCK_BT = f"""{MARKET}, {EVENTS}, {_WINDOWS}, {backtest_sql('market', 256, 1, None)},
sb AS (SELECT b.*, w.event, w.event_date, w.arm, w."offset", abs(actual - forecast) / greatest(abs(actual), 1e-8) * 100 AS err FROM bt b JOIN wins w ON w.series = b.series AND w.origin_index = b.origin_index)"""


def _shock(spark, sf_dir):
    return events.shock_backtest(panels.market(spark, sf_dir), panels.events(spark), forecast.empirical_step(256), 256, 12, 25)


@query(f"""WITH {_SHOCK_BT} SELECT event, arm, series, origin_index, "offset", {r('actual', 4)} AS actual, {r('forecast', 4)} AS forecast, {r('q90', 4)} AS q90, {r('err', 6)} AS abs_pct_error, {r('err', 6)} AS naive_abs_pct_error FROM sb""")
def shock_backtest(spark, sf_dir):
    rows = events.naive_pct_error(_shock(spark, sf_dir)).select("event", "arm", "series", "origin_index", "offset", "actual", "forecast", "q90", "abs_pct_error", "naive_abs_pct_error")
    return digits(digits(rows, 4, "actual", "forecast", "q90"), 6, "abs_pct_error", "naive_abs_pct_error")


_REGIME = "reg AS (SELECT *, CASE WHEN abs(\"offset\") <= 3 THEN 'market_shock' ELSE 'market_calm' END AS regime FROM sb)"


@query(f"WITH {_SHOCK_BT}, {_REGIME} SELECT regime, count(*) AS n, {r('avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END)', 6)} AS coverage_p10_p90 FROM reg GROUP BY regime")
def regimes(spark, sf_dir):
    return digits(score.calibration(events.with_regime(_shock(spark, sf_dir)), ["regime"]).select("regime", "n", "coverage_p10_p90"), 6, "coverage_p10_p90")


_PIVOT = " UNION ALL ".join(
    f"SELECT CAST({level} AS DOUBLE) AS level, {r(f'''avg(CASE WHEN regime = 'market_calm' THEN CASE WHEN actual <= {q} THEN 1.0 ELSE 0.0 END END)''', 6)} AS market_calm, {r(f'''avg(CASE WHEN regime = 'market_shock' THEN CASE WHEN actual <= {q} THEN 1.0 ELSE 0.0 END END)''', 6)} AS market_shock FROM reg"
    for q, level in zip(QUANTILES, LEVELS, strict=True)
)


@query(f"WITH {_SHOCK_BT}, {_REGIME} {_PIVOT}")
def regime_curves(spark, sf_dir):
    curve = score.calibration_curve(events.with_regime(_shock(spark, sf_dir)), "regime")
    return digits(score.curve_pivot(curve, "regime", ["market_calm", "market_shock"]), 6, "market_calm", "market_shock")


_LAGS = """med AS (SELECT event, arm, series, quantile_cont(err, 0.5) FILTER (WHERE "offset" < 0) AS median_error FROM sb GROUP BY ALL),
thr AS (SELECT med.*, multiplier, median_error * multiplier AS threshold FROM med CROSS JOIN (VALUES (1.25::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) m(multiplier)),
post AS (SELECT sb.event, sb.series, sb."offset", thr.multiplier, err, threshold, lead(err, 1) OVER w AS e1, lead(err, 2) OVER w AS e2 FROM sb JOIN thr ON thr.event = sb.event AND thr.series = sb.series WHERE sb."offset" >= 0
  WINDOW w AS (PARTITION BY sb.event, sb.series, thr.multiplier ORDER BY sb."offset")),
fst AS (SELECT event, series, multiplier, min("offset") AS lag FROM post WHERE err <= threshold AND e1 <= threshold AND e2 <= threshold GROUP BY ALL),
lags AS (SELECT thr.*, CAST(lag AS DOUBLE) AS lag FROM thr LEFT JOIN fst USING (event, series, multiplier))"""


@query(f"WITH {_SHOCK_BT}, {_LAGS} SELECT event, arm, series, 'univariate' AS mode, multiplier, {r('median_error', 6)} AS median_error, {r('threshold', 6)} AS threshold, lag AS adaptation_lag_days FROM lags")
def adaptation_lag(spark, sf_dir):
    return digits(events.adaptation_lags(_shock(spark, sf_dir)), 6, "median_error", "threshold")


@query(f"WITH {_SHOCK_BT}, {_LAGS} SELECT arm, multiplier, {r('avg(lag)', 6)} AS mean_lag, count(*) - count(lag) AS n_not_converged FROM lags GROUP BY ALL")
def lag_by_arm(spark, sf_dir):
    return digits(events.lag_by_arm(events.adaptation_lags(_shock(spark, sf_dir))), 6, "mean_lag")


@query(f"WITH {_SHOCK_BT}, {_LAGS} SELECT event, arm, {r('median_error', 6)} AS pre_event_median_error, {r('threshold', 6)} AS threshold, lag AS adaptation_lag_days, count(*) OVER (PARTITION BY arm) AS n_events_in_arm FROM lags WHERE series = 'A' AND multiplier = 1.5")
def lag_detail(spark, sf_dir):
    return digits(events.lag_detail(events.adaptation_lags(_shock(spark, sf_dir)), "A", "univariate"), 6, "pre_event_median_error", "threshold")


_GLITCH = """rr AS (SELECT *, value / nullif(lag(value) OVER (PARTITION BY series ORDER BY idx), 0) - 1 AS r FROM {0}), rn AS (SELECT *, lead(r) OVER (PARTITION BY series ORDER BY idx) AS r_next FROM rr),
odd AS (SELECT * FROM rn WHERE abs(r) > 0.25 AND abs(r_next) > 0.15 AND sign(r) <> sign(r_next))"""


@query(f"WITH {ACTIVITY}, {_GLITCH.format('activity')} SELECT series, idx, date, {r('value', 4)} AS value, {r('r', 6)} AS r, {r('r_next', 6)} AS r_next FROM odd")
def glitches(spark, sf_dir):
    return digits(digits(events.glitches(panels.activity(spark, sf_dir)), 4, "value"), 6, "r", "r_next")


@query(f"""WITH {MARKET}, {_GLITCH.format('market')}, w AS (SELECT series, min(idx) AS g FROM odd GROUP BY series)
SELECT m.series, w.g AS glitch_idx, m.idx, m.date, m.value, m.observed FROM market m JOIN w ON w.series = m.series AND m.idx BETWEEN w.g - 20 AND w.g + 20""")
def glitch_vignette(spark, sf_dir):
    p = panels.market(spark, sf_dir)
    first = events.glitches(p).groupBy("series").agg(F.min("idx").alias("idx"))
    return events.glitch_vignette(p, first)


@query(f"""WITH {ACTIVITY}, {_GLITCH.format('activity')}, gap AS (SELECT series, max(n) AS longest FROM (SELECT series, g, count(*) AS n FROM (SELECT series, observed, sum(CASE WHEN observed THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY idx) AS g FROM activity) WHERE NOT observed GROUP BY ALL) GROUP BY series),
vol AS (SELECT series, CASE WHEN count(r) >= 2 THEN stddev_pop(r) END AS volatility FROM (SELECT series, ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY idx)) AS r FROM activity WHERE observed) GROUP BY series),
b AS (SELECT series, count(*) AS n, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) AS o, min(value) AS lo, max(value) AS hi FROM activity GROUP BY series), g AS (SELECT series, count(*) AS g FROM odd GROUP BY series)
SELECT series, n, {r('o', 6)} AS observed_rate, {r('1 - o', 6)} AS fallback_rate, coalesce(longest, 0) AS max_gap, coalesce(g, 0) AS n_glitches, {r('lo', 4)} AS value_min, {r('hi', 4)} AS value_max, {r('volatility', 6)} AS volatility
FROM b LEFT JOIN gap USING (series) LEFT JOIN vol USING (series) LEFT JOIN g USING (series)""")
def data_quality(spark, sf_dir):
    return digits(digits(events.data_quality(panels.activity(spark, sf_dir)), 6, "observed_rate", "fallback_rate", "volatility"), 4, "value_min", "value_max")


# ---- slices ------------------------------------------------------------------------------------------------------------------

_TRUTH = """tr AS (SELECT series, target_index AS idx, target_date AS date, actual AS value, observed FROM (SELECT *, max(origin_index) OVER (PARTITION BY series) AS lo FROM bt) WHERE horizon_step = 1 OR origin_index = lo
  QUALIFY row_number() OVER (PARTITION BY series, target_index ORDER BY horizon_step) = 1)"""


@query(f"{AT}, {_TRUTH} SELECT * FROM tr")
def truth(spark, sf_dir):
    return slices.truth(activity_rows(spark, sf_dir))


@query(f"""{AT}, {_TRUTH}, {_GLITCH.format("(SELECT * FROM tr WHERE series = 'view')")}, t AS (SELECT * FROM bt WHERE series = 'view' AND origin_index = 300), past AS (SELECT idx FROM tr WHERE series = 'view' AND idx < 300 ORDER BY idx DESC LIMIT 120),
win AS (SELECT idx FROM past UNION ALL SELECT target_index FROM t), s AS (SELECT avg(abs(actual - forecast)) AS m, avg(abs(actual - baseline_naive)) AS b, avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) AS c FROM t WHERE observed)
SELECT 'view' AS series, CAST(300 AS BIGINT) AS origin_index, {r('c', 6)} AS coverage, {r('CASE WHEN b > 1e-9 THEN m / b END', 6)} AS relative_mae, EXISTS (SELECT 1 FROM win WHERE idx IN (SELECT idx FROM odd)) AS contains_glitch FROM s""")
def forecast_slice(spark, sf_dir):
    return digits(slices.forecast_slice(activity_rows(spark, sf_dir), "view", 300)[2], 6, "coverage", "relative_mae")


@query(f"""{AT}, {_TRUTH}, {_GLITCH.format('tr')}, w AS (SELECT series, origin_index, arg_max(actual, horizon_step) AS last, first(baseline_naive) AS naive, avg(abs(actual - forecast)) AS m, avg(abs(actual - baseline_naive)) AS b,
  avg(CASE WHEN actual BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) AS o, bool_and(observed) AS al, max(target_index) AS e FROM bt GROUP BY ALL),
k AS (SELECT w.*, EXISTS (SELECT 1 FROM odd g WHERE g.series = w.series AND g.idx BETWEEN w.origin_index AND w.e) AS gl FROM w)
SELECT series, origin_index, {r('CASE WHEN naive <> 0 THEN (last - naive) / naive END', 6)} AS pct_change, {r('CASE WHEN b >= 1e-9 THEN m / b END', 6)} AS relative_mae, {r('c', 6)} AS coverage, gl AS contains_glitch,
  m < b AS beats_naive, {r('o', 6)} AS observed_fraction, al AS all_targets_observed FROM k WHERE al""")
def rank_windows(spark, sf_dir):
    return digits(slices.rank_windows(activity_rows(spark, sf_dir), exclude_glitches=False), 6, "pct_change", "relative_mae", "coverage", "observed_fraction")


# ---- covariates --------------------------------------------------------------------------------------------------------------

RELEASES = ("1995-06-30", "1996-03-16", "1997-02-24", "1998-11-30", "2000-04-03", "2001-09-01")


def _releases(spark):
    return spark.createDataFrame([(d,) for d in RELEASES], "release string")


@query(f"""WITH {MARKET} SELECT date, {r('sin(2 * pi() * (isodow(date) - 1) / 7)', 6)} AS dow_sin, {r('cos(2 * pi() * (isodow(date) - 1) / 7)', 6)} AS dow_cos FROM (SELECT DISTINCT date FROM market)""")
def covariate_dow(spark, sf_dir):
    s, c = covariates.day_of_week(F.col("date"))
    return digits(panels.market(spark, sf_dir).select("date").distinct().select("date", s.alias("dow_sin"), c.alias("dow_cos")), 6, "dow_sin", "dow_cos")


_RELEASE_SQL = "rel AS (SELECT CAST(d AS DATE) AS d FROM (VALUES " + ", ".join(f"('{d}')" for d in RELEASES) + ") t(d))"


@query(f"""WITH {MARKET}, {_RELEASE_SQL} SELECT CAST(m.date AS DATE) AS date, CAST(least(coalesce((SELECT min(d) FROM rel WHERE d >= CAST(m.date AS DATE)) - CAST(m.date AS DATE), 365), 365) AS DOUBLE) AS days_to_release FROM (SELECT DISTINCT date FROM market) m""")
def covariate_release(spark, sf_dir):
    return covariates.days_to_release(panels.market(spark, sf_dir), _releases(spark))


_COV_ORIGINS = """n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM market), o AS (SELECT n.series, n.idx, p.value AS last, p.date AS pdate FROM n JOIN market p ON p.series = n.series AND p.idx = n.idx - 1 WHERE n.idx >= 32 AND n.idx <= n.n - 5 AND n.idx > n.n - 5 - 40)"""


@query(f"""WITH {MARKET}, {_COV_ORIGINS}, x AS (SELECT o.series, t.value AS actual, o.last, sin(2 * pi() * (isodow(t.date) - 1) / 7) - sin(2 * pi() * (isodow(o.pdate) - 1) / 7) AS c FROM o CROSS JOIN range(1, 6) k(h) JOIN market t ON t.series = o.series AND t.idx = o.idx + h - 1),
s AS (SELECT series, avg(abs(actual - last)) AS wo, avg(abs(actual - (last + c))) AS wi FROM x GROUP BY series) SELECT 'day_of_week' AS covariate, series, {r('wo', 4)} AS mae_without, {r('wi', 4)} AS mae_with, {r('wi / wo', 6)} AS ratio FROM s""")
def covariate_ablation(spark, sf_dir):
    rows = covariates.covariate_ablation(panels.market(spark, sf_dir), covariates.day_of_week(F.col("date"))[0], "day_of_week", max_origins=40)
    return digits(digits(covariates.ablation_summary(rows), 4, "mae_without", "mae_with"), 6, "ratio")


@query(f"""WITH {MARKET}, {_COV_ORIGINS}, x AS (SELECT o.series, t.value AS actual, o.last FROM o CROSS JOIN range(1, 6) k(h) JOIN market t ON t.series = o.series AND t.idx = o.idx + h - 1),
a AS (SELECT series, arm, CASE WHEN arm = 'leaked' THEN abs(actual - (last + actual - last)) ELSE abs(actual - last) END AS e FROM x CROSS JOIN (VALUES ('clean'), ('leaked_flat_past'), ('leaked')) v(arm))
SELECT series, arm, {r('avg(e)', 4)} AS mae, count(*) AS n FROM a GROUP BY ALL""")
def leak_control(spark, sf_dir):
    return digits(covariates.leak_summary(covariates.leak_control(panels.market(spark, sf_dir), max_origins=40)), 4, "mae")


@query(f"""{AT}, {_ACC_DRIFT}, {_DM} SELECT count(*) AS n_cells, {r('avg(mae / baseline_mae)', 6)} AS mean_ratio, {r('avg(CASE WHEN stat > 1.96 THEN 1.0 ELSE 0.0 END)', 6)} AS share_worse, {r('avg(CASE WHEN stat < -1.96 THEN 1.0 ELSE 0.0 END)', 6)} AS share_better
FROM acc JOIN dm USING (series, horizon_step)""")
def summary_values(spark, sf_dir):
    """Shares of significant cells by sign and the mean ratio. [A27]"""
    acc = score.accuracy(activity_rows(spark, sf_dir), score.mase_scales(panels.activity(spark, sf_dir), L), ["series", "horizon_step"], "drift")
    share = lambda c: F.avg(c.cast("double"))
    out = acc.agg(F.count("*").alias("n_cells"), F.avg("relative_mae_vs_baseline").alias("mean_ratio"), share(F.col("dm_stat") > 1.96).alias("share_worse"), share(F.col("dm_stat") < -1.96).alias("share_better"))
    return digits(out, 6, "mean_ratio", "share_worse", "share_better")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest accuracy of the market panel by series and step."""
    p = panels.market(spark, sf_dir)
    return score.accuracy(market_rows(spark, sf_dir), score.mase_scales(p, L), baseline="drift")


