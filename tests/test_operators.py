"""Hand-computed cases and the traps of the operators."""

import json
import lzma
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tideline.functions import metrics as M
from tideline.functions import special
from tideline.operators import covariates, events, forecast, origins, panel, score, significance, slices
from tideline.plans import grid
from tideline.schema import LEVELS, PREDICTION_COLUMNS, QUANTILES
from tideline.sources import catalog, manifest, panels, vendor
from tideline.streaming import panel as streaming

START = datetime(2024, 1, 1)


def make_panel(spark, series: dict, observed: dict | None = None, step=timedelta(days=1)):
    rows = []
    for name, values in series.items():
        flags = (observed or {}).get(name, [True] * len(values))
        rows += [(name, START + i * step, v if v is None else float(v), o, i) for i, (v, o) in enumerate(zip(values, flags, strict=True))]
    return spark.createDataFrame(rows, "series string, date timestamp_ntz, value double, observed boolean, idx bigint")


def make_rows(spark, rows):
    """Prediction rows from (series, origin, h, actual, observed, forecast, naive[, quantiles])."""
    out = []
    for s, o, h, a, ob, f, n, *q in rows:
        qs = q[0] if q else [f + (k - 5) for k in range(1, 10)]
        out.append(("univariate", "identity", False, s, o, START, o + h - 1, START + timedelta(days=o + h - 1), h, float(a), ob, float(f), *map(float, qs), float(n), None, None, None))
    from tideline.schema import PREDICTIONS

    return spark.createDataFrame(out, PREDICTIONS)


def one(df, expr):
    return df.agg(expr.alias("x")).first().x


def test_point_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, p double")
    assert one(df, M.mae("a", "p")) == 1.0 and one(df, M.rmse("a", "p")) == pytest.approx(math.sqrt(5 / 3))
    for a, p, want in ((10.0, 0.0, 200), (10.0, 10.0, 0), (0.0, 0.0, 0)):
        assert one(spark.createDataFrame([(a, p)], "a double, p double"), M.smape("a", "p")) == want
    ratios = spark.createDataFrame([(2.0, 4.0), (0.0, 0.0), (1.0, 0.0)], "m double, b double").select(M.ratio(F.col("m"), F.col("b")).alias("r"))
    assert [r.r for r in ratios.collect()] == [0.5, 0.0, math.inf]


def test_quantile_metrics(spark):
    for a, q, level, want in ((10, 8, 0.5, 1.0), (10, 12, 0.9, 0.2), (12, 10, 0.9, 1.8)):
        assert one(spark.createDataFrame([(float(a), float(q))], "a double, q double"), M.pinball("a", "q", level)) == pytest.approx(want)
    rows = make_rows(spark, [("A", 1, 1, a, True, 5, 5, range(1, 10)) for a in (5, 0)])
    r = score.calibration(rows).first()
    assert (r.n, r.coverage_p10_p90) == (2, 0.5) and r.pit_mean == pytest.approx(0.3)
    flat = make_rows(spark, [("A", 1, 1, a, True, 5, 5, [5] * 9) for a in (4, 5, 6)]).withColumn("pit", M.pit("actual"))
    assert [r.pit for r in flat.orderBy("actual").collect()] == [0.1, 0.9, 0.9]
    tied = make_rows(spark, [("A", 1, 1, 3, True, 5, 5, [1, 2, 3, 3, 3, 6, 7, 8, 9])]).withColumn("pit", M.pit("actual"))
    assert tied.first().pit == pytest.approx(0.5)  # the rightmost of equal quantiles


def test_scales(spark):
    assert score.mase_scales(make_panel(spark, {"A": [1, 3, 2, 100, 100, 100]}), 3).first().scale == 1.5
    assert score.mase_scales(make_panel(spark, {"A": [7] * 5}), 5).first().scale == 1e-12
    with pytest.raises(PySparkException, match="too short"):
        score.mase_scales(make_panel(spark, {"A": [1, 2]}), 2, 3).collect()


def test_accuracy_scores_observed_targets_only(spark):
    rows = make_rows(spark, [("A", 1, 1, 10, True, 10, 11), ("A", 2, 1, 10, True, 10, 11), ("A", 3, 1, 999, False, 10, 11)])
    scales = spark.createDataFrame([("B", 2.0)], "series string, scale double")
    r = score.accuracy(rows, scales).first()
    assert (r.n, r.mae, r.baseline_mae, r.baseline_mase, r.relative_mae_vs_baseline, r.skill) == (2, 0, 1, 1, 0, 1)
    assert r.dm_stat is None  # fewer than 8 rows
    flat = make_rows(spark, [("A", o, 1, 10, True, 11, 10) for o in range(3)])
    r = score.accuracy(flat, scales).first()
    assert r.relative_mae_vs_baseline == math.inf and r.skill == -math.inf


def reference_dm(d, h):
    d = np.asarray(d, float)
    t, e = len(d), np.asarray(d) - np.mean(d)
    v = (sum(e * e) / t + 2 * sum(sum(e[k:] * e[:-k]) / t for k in range(1, h))) / t
    return 0.0 if v <= 0 else d.mean() / math.sqrt(v) * math.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)


def test_diebold_mariano(spark):
    rng = np.random.default_rng(42)
    for h in (1, 2, 3):
        d = rng.normal(size=40)
        rows = spark.createDataFrame([("A", h, int(i), float(x)) for i, x in enumerate(d)], "series string, horizon_step bigint, origin_index bigint, d double").repartition(4)
        got = score.dm_statistics(rows, ["series", "horizon_step"], F.col("d"), F.lit(0.0)).first()
        assert got.dm_stat == pytest.approx(reference_dm(d, h), rel=1e-9)
    const = spark.createDataFrame([("A", 1, i, 2.0) for i in range(10)], "series string, horizon_step bigint, origin_index bigint, d double")
    r = significance.dm_pvalues(score.dm_statistics(const, ["series", "horizon_step"], F.col("d"), F.lit(0.0))).first()
    assert (r.dm_stat, r.dm_p) == (0.0, 1.0)


def test_special_functions():
    assert special.t_two_sided(np.array([2.228]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-4)
    assert special.t_two_sided(np.array([0.0]), np.array([5.0]))[0] == 1
    low, high = special.clopper_pearson(5, 10, 0.05)
    assert (low, high) == (pytest.approx(0.1871, abs=1e-4), pytest.approx(0.8129, abs=1e-4))
    assert all(math.isnan(x) for x in special.clopper_pearson(0, 0, 0.05))


def test_windows(spark):
    p = make_panel(spark, {"A": range(10), "B": range(4)})
    got = origins.valid_origins(p, 3, 2).collect()
    assert sorted(r.origin_index for r in got if r.series == "A") == [3, 4, 5, 6, 7, 8] and not [r for r in got if r.series == "B" and r.origin_index > 2 + 1]
    assert sorted(r.origin_index for r in origins.valid_origins(p.where("series = 'A'"), 3, 2, 4, 3).collect()) == [5, 8]
    steps = origins.target_indices(spark.createDataFrame([(10,)], "origin_index bigint"), 3)
    assert [(r.horizon_step, r.target_index) for r in steps.collect()] == [(1, 10), (2, 11), (3, 12)]
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            origins.valid_origins(p, *bad)
    with pytest.raises(ValueError):
        origins.target_indices(p, 0)


def test_nearest_origin(spark):
    dates = [1, 5, 10]
    p = spark.createDataFrame([("A", START + timedelta(days=d - 1), 1.0, True, i) for i, d in enumerate(dates)], "series string, date timestamp_ntz, value double, observed boolean, idx bigint")
    ev = spark.createDataFrame([(str(d), START + timedelta(days=d - 1), "x") for d in (3, 4, -50, 99)], "event string, event_date timestamp_ntz, arm string")
    assert {r.event: r.center for r in origins.nearest_origin(p, ev).collect()} == {"3": 0, "4": 1, "-50": 0, "99": 2}
    with pytest.raises(PySparkException, match="no origins around event"):
        origins.event_windows(p, ev, 256, 1, 1).collect()


def test_backtest_shape_and_baselines(spark):
    p = make_panel(spark, {"A": [10 * i for i in range(1, 31)], "B": [5.0] * 30})
    rows = forecast.backtest(p, forecast.last_plus_level(), 5, 3, season=3)
    assert rows.columns == list(PREDICTION_COLUMNS) and rows.count() == 2 * 23 * 3
    r = {x.horizon_step: x for x in rows.where("series = 'A' and origin_index = 7").collect()}
    assert [r[h].baseline_naive for h in (1, 2, 3)] == [70] * 3 and [r[h].baseline_drift for h in (1, 2, 3)] == [80, 90, 100]
    assert [r[h].baseline_seasonal_naive for h in (1, 2, 3)] == [50, 60, 70] and r[2].actual == 90 and r[2].target_index == 8
    assert r[1].q10 == pytest.approx(70.1) and not origins.leaks(rows, 5).count()
    long = forecast.backtest(make_panel(spark, {"A": [1, 2, 3] * 4}), forecast.last_plus_level(), 3, 7, season=3).where("origin_index = 3").orderBy("horizon_step")
    assert [x.baseline_seasonal_naive for x in long.collect()] == [1, 2, 3, 1, 2, 3, 1]
    assert forecast.backtest(p, forecast.last_plus_level(), 5, 3, season=9).where("baseline_seasonal_naive is not null").count() == 0
    with pytest.raises(ValueError):
        forecast.backtest(p, forecast.last_plus_level(), 1, 3)


def test_backtest_is_the_same_however_rows_are_placed(spark):
    p = make_panel(spark, {"A": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], "B": range(11)})
    f = forecast.empirical_step(4)
    a, b = (set(map(tuple, forecast.backtest(x, f, 4, 3).collect())) for x in (p, p.orderBy(F.rand(1)).repartition(7)))
    assert a == b
    short = forecast.at_horizon(forecast.backtest(p, f, 4, 3), 2, 3).where("origin_index <= 8")
    assert set(map(tuple, short.collect())) == set(map(tuple, forecast.backtest(p, f, 4, 2).where("origin_index <= 8").collect()))
    with pytest.raises(ValueError):
        forecast.at_horizon(short, 9, 3)


def test_transform_and_positivity(spark):
    p = make_panel(spark, {"A": [10, 20, 15, 30, 25, 40]})
    plain, logged = (forecast.backtest(p, forecast.last_plus_level(), 3, 2, transform=t).orderBy("origin_index", "horizon_step").collect() for t in ("identity", "log1p"))
    assert [r.forecast for r in logged] == pytest.approx([r.forecast for r in plain]) and [r.actual for r in logged] == [r.actual for r in plain]
    assert [r.baseline_drift for r in logged] != pytest.approx([r.baseline_drift for r in plain])
    falling = make_panel(spark, {"A": [30, 15, 0, 5], "B": [-30, -15, -40, 5]})
    rows = {r.series: r for r in forecast.backtest(falling, forecast.last_plus_level(), 3, 1, make_positive=True).collect()}
    assert rows["A"].baseline_drift == -15 and rows["B"].forecast == -40


def test_observed_flag_follows_the_target(spark):
    flags = [True] * 20
    flags[12] = False
    rows = forecast.backtest(make_panel(spark, {"A": range(20)}, {"A": flags}), forecast.last_plus_level(), 5, 3)
    assert {r.observed for r in rows.where("target_index = 12").collect()} == {False} and not rows.where("target_index <> 12 and not observed").count()


def test_plugins(spark):
    p = make_panel(spark, {"A": range(12), "B": range(12)})

    def last(ctx, h):
        point = np.repeat(ctx[:, -1:], h, axis=1)
        return point, point[:, :, None] + np.array(LEVELS)

    names = ["series", "origin_index", "horizon_step", "forecast", "actual", *QUANTILES]
    a = forecast.plugin_backtest(p, last, 4, 2).select(*names)
    b = forecast.backtest(p, forecast.last_plus_level(), 4, 2).select(*names)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(PySparkException, match="must not fall"):
        forecast.plugin_backtest(p, lambda c, h: (last(c, h)[0], -last(c, h)[1]), 4, 2).collect()
    with pytest.raises(PySparkException, match="shape"):
        forecast.plugin_backtest(p, lambda c, h: (last(c, h)[0], last(c, h)[1][:, :, :5]), 4, 2).collect()


def test_plugins_with_transform_positivity_and_season(spark):
    p = make_panel(spark, {"A": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8], "B": [2, 7, 1, 8, 2, 8, 1, 8, 2, 8, 4, 5]})

    def last(ctx, h):
        point = np.repeat(ctx[..., -1:], h, axis=-1)
        return point, point[..., None] + np.array(LEVELS)

    names = ["transform", "make_positive", "series", "origin_index", "horizon_step", "forecast", "actual", "baseline_naive", "baseline_drift", "baseline_seasonal_naive", *QUANTILES]
    rows = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, df.select(*names).collect()))]
    for transform in ("identity", "log1p"):
        how = {"transform": transform, "make_positive": True, "season": 3}
        want = rows(forecast.backtest(p, forecast.last_plus_level(), 4, 2, **how))
        assert rows(forecast.plugin_backtest(p, last, 4, 2, **how)) == want == rows(forecast.stacked_plugin_backtest(p, last, 4, 2, **how))
    down = lambda ctx, h: (last(ctx, h)[0] - 100, last(ctx, h)[1] - 100)
    assert {r.forecast for r in forecast.plugin_backtest(p, down, 4, 2, make_positive=True).collect()} == {0.0}
    timed = forecast.plugin_backtest(p, last, 4, 2, latency=True)
    assert timed.columns[-1] == "latency_ms" and min(r.latency_ms for r in timed.collect()) >= 0
    lost = lambda ctx, h: (last(ctx, h)[0] * np.nan, last(ctx, h)[1])
    assert {r.forecast for r in forecast.plugin_backtest(p, lost, 4, 2, make_positive=True).collect()} == {None}


def test_price_history_is_read_entity_by_entity(spark, tmp_path):
    days = {"u-1": {f"2024-{m:02d}-01": m + 0.5 for m in range(1, 13)}, "u-2": {}, "u-3": {"2023-12-31": 7, "2024-12-01": 1e3}}
    for name, text in (("a.json", json.dumps(days)), ("b.json", json.dumps(days, indent=2))):
        (tmp_path / name).write_text(text)
        got = {(r.series, r.date.date().isoformat(), r.value) for r in vendor.load_price_history(spark, str(tmp_path / name)).collect()}
        assert got == {(k, d, float(v)) for k, own in days.items() for d, v in own.items()}
        recent = vendor.load_price_history(spark, str(tmp_path / name), days=90).collect()
        assert {(r.series, r.date.month) for r in recent} == {("u-1", 10), ("u-1", 11), ("u-1", 12), ("u-3", 12)} and {r.date.year for r in recent} == {2024}


def test_block_means_are_those_of_the_blocks():
    values = np.random.default_rng(0).normal(size=(23, 2))
    starts = significance.block_starts(0, 100, 5, 23 - 5 + 1, 7)
    assert starts.min() == 0 and starts.max() == 18 and len(np.unique(starts, axis=0)) == 100
    want = [np.concatenate([values[s : s + 5] for s in row])[:23].mean(axis=0) for row in starts]
    assert np.allclose(significance.block_means(values, 5, 100, 7), want)
    assert np.allclose(significance.block_means(values, 23, 3, 7), values.mean(axis=0))
    with pytest.raises(ValueError, match="block of 24"):
        significance.block_means(values, 24, 3, 7)


def test_exponential_smoothing():
    out = forecast.holt(np.arange(0, 40, 2.0), 4)
    assert np.isfinite(out).all() and (np.diff(out) > 0).all() and out[0] > 38
    season = forecast.holt(np.tile([1.0, 5.0, 9.0], 8) + np.arange(24) * 0.1, 6, 3)
    assert season[2] > season[1] > season[0] and season[3] < season[2]
    with pytest.raises(ValueError):
        forecast.holt(np.arange(3.0), 2)


def test_panel_building(spark):
    p = make_panel(spark, {"A": [1, None, None, None, None, 6], "B": [1, 2, 3, 4, 5, 6]}).where("value is not null").drop("idx")
    kept = {r.idx: (r.value, r.observed) for r in panel.dense(p, unfilled="keep").where("series = 'A'").collect()}
    assert kept == {0: (1, True), 1: (1, False), 2: (1, False), 3: (1, False), 4: (None, False), 5: (6, True)}
    assert panel.dense(p, unfilled="drop").count() == 11
    with pytest.raises(PySparkException, match="gap longer"):
        panel.dense(p).collect()
    days = panel.intersect_calendar(make_panel(spark, {"A": [1, 2, -3, 4], "B": [1, None, 3, 4]}))
    assert sorted((r.series, r.idx, r.value) for r in days.collect()) == [("A", 0, 1), ("A", 1, 4), ("B", 0, 1), ("B", 1, 4)]
    trimmed = panel.trim_shortest(make_panel(spark, {"A": [1, 2, 3], "B": [4, 5]}))
    assert sorted((r.series, r.idx, r.value) for r in trimmed.collect()) == [("A", 0, 2), ("A", 1, 3), ("B", 0, 4), ("B", 1, 5)]
    assert panel.unaligned_dates(trimmed).count() == 2
    bad = make_panel(spark, {"A": [1, None, float("inf")]}).withColumn("date", F.lit(START).cast("timestamp_ntz"))
    assert {r.check_name: r.violations for r in panel.violations(bad).collect()} == {"dates_not_rising": 2, "values_missing": 1, "values_not_finite": 1}


def test_year_on_year(spark):
    rows = spark.createDataFrame([(datetime(2023 + i // 12, i % 12 + 1, 1), str(100 + i)) for i in range(13)] + [(datetime(2022, 1, 1), ".")], "date timestamp_ntz, v string")
    assert [round(r.yoy, 9) for r in panel.year_on_year(rows, "date", "v").collect()] == [12.0]


def test_events(spark):
    assert events.shock_days(make_panel(spark, {"A": [100] * 50})).count() == 0
    with pytest.raises(ValueError):
        events.shock_days(make_panel(spark, {"A": [1, 2]}), 0)
    found = lambda v: [r.idx for r in events.glitches(make_panel(spark, {"A": v})).collect()]
    assert found([10, 10.1, 20, 10.2, 10.3]) == [2] and found([10, 15, 22, 33, 49]) == [] and found([10, 10, 20]) == []
    q = events.data_quality(make_panel(spark, {"A": [1, 2, 2, 2, 3, 3, 4, 5]}, {"A": [True, True, False, False, True, True, True, True]})).first()
    assert (q.observed_rate, q.fallback_rate, q.max_gap) == (6 / 8, 2 / 8, 2)
    single = events.data_quality(make_panel(spark, {"A": [1, 1]}, {"A": [True, False]})).first()
    assert single.volatility is None and single.max_gap == 1


def lag_rows(spark, pre, post):
    rows = [("e", "pre_cutoff", "A", "univariate", -len(pre) + i, float(x)) for i, x in enumerate(pre)] + [("e", "pre_cutoff", "A", "univariate", i, float(x)) for i, x in enumerate(post)]
    return spark.createDataFrame(rows, "event string, arm string, series string, mode string, offset bigint, abs_pct_error double")


def test_adaptation_lag(spark):
    lags = events.adaptation_lags(lag_rows(spark, [2, 4], [9, 4, 4, 9, 4, 4, 4, 9]), (1.5,))
    r = events.lag_detail(lags, "A", "univariate").first()
    assert (r.pre_event_median_error, r.threshold, r.adaptation_lag_days, r.n_events_in_arm) == (3, 4.5, 4, 1)
    never = events.adaptation_lags(lag_rows(spark, [2, 4], [9, 9, 4, 4]), (1.5,))
    assert never.first().adaptation_lag_days is None and events.lag_by_arm(never).first().n_not_converged == 1
    assert events.adaptation_lags(lag_rows(spark, [], [1, 1, 1]), (1.5,)).first().adaptation_lag_days is None


def test_leaderboard(spark):
    rows = make_rows(spark, [("A", o, 1, 10, True, 10, 11) for o in range(2)]).withColumn("baseline_drift", F.when(F.col("origin_index") == 0, 12.0))
    board = score.leaderboard(rows, spark.createDataFrame([("A", 1.0)], "series string, scale double"))
    assert {r.baseline_method: r.n for r in board.collect()} == {"naive": 2, "drift": 1}
    with pytest.raises(ValueError):
        score.leaderboard(rows.drop(*(c for c in rows.columns if c.startswith("baseline"))), None)
    table = spark.createDataFrame([("A", None, 0.5, 10), ("B", None, 1.5, 1000)], "series string, k string, relative_mae_vs_baseline double, n bigint")
    r = score.aggregate_leaderboard(table, ["k"]).first()
    assert (r.n_cards, r.relative_mae_median) == (2, 1.0) and r.relative_mae_weighted == pytest.approx(1505 / 1010)


def test_slices(spark):
    rows = make_rows(spark, [("A", o, h, 100 + o + h, True, 100 + o, 100 + o) for o in range(10, 15) for h in (1, 2, 3)])
    assert sorted(r.idx for r in slices.truth(rows).collect()) == list(range(10, 17))
    past, targets, scalars = slices.forecast_slice(rows, "A", 12, history=1)
    assert [r.idx for r in past.collect()] == [11] and targets.count() == 3 and scalars.first().relative_mae == 1
    with pytest.raises(ValueError):
        slices.forecast_slice(rows, "A", 99)
    with pytest.raises(ValueError):
        slices.forecast_slice(rows.withColumn("observed", F.lit(False)), "A", 12, require_observed=True)
    ranked = slices.rank_windows(rows)
    assert ranked.count() == 5 and not ranked.where("beats_naive").count()
    assert slices.rank_windows(rows.withColumn("observed", F.col("target_index") != 12)).count() == 2


def test_naive_gap(spark):
    naive, noise = [100, 120, 140, 160, 180], [5, -8, 12, -3, 7]
    rows = make_rows(spark, [("A", i, 1, n + e, True, n + 0.3 * e, n) for i, (n, e) in enumerate(zip(naive, noise, strict=True))])
    r = score.naive_gap(rows).first()
    assert r.ratio == pytest.approx(0.3) and r.corr > 0.99 and r.n == 5
    flat = score.naive_gap(make_rows(spark, [("A", 1, 1, 5, True, 5, 5), ("A", 2, 1, 5, True, 5, 5)])).first()
    assert flat.ratio is None and flat.corr is None


def test_quantile_bins_are_dense(spark):
    rows = make_rows(spark, [("A", i, 1, a, True, 5, 5, range(1, 10)) for i, a in enumerate((0, 1, 5, 9, 50))])
    bins = score.quantile_bins(rows, (1, 28)).orderBy("bin_index").collect()
    assert [b.bin_index for b in bins] == list(range(10)) and [b["count"] for b in bins] == [2, 0, 0, 0, 1, 0, 0, 0, 1, 1]
    assert (bins[0].label, bins[1].label, bins[9].label) == ("≤ q10", "(0.1, 0.2]", "> q90") and sum(b.fraction for b in bins) == pytest.approx(1)


def test_false_discovery_and_conformal(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.03, None, 0.5])], "i bigint, p double")
    got = {r.i: r.q_value for r in significance.bh_qvalues(p, "p", (), ("i",)).collect()}
    assert got[3] is None and got[0] == pytest.approx(0.04) and got[1] == got[2] == pytest.approx(0.04 * 4 / 3) and got[4] == 0.5
    rows = make_rows(spark, [("A", o, 1, 5 + o, True, 5, 5, range(1, 10)) for o in range(25)])
    got = significance.conformal(rows).orderBy("origin_index").collect()
    assert got[19].threshold is None and got[20].calibration_n == 20 and got[20].threshold == sorted(max(1 - a, a - 9) for a in range(5, 25))[math.ceil(21 * 0.8) - 1]
    assert significance.conformal_summary(significance.conformal(rows), ["series"]).first().n_skipped == 20


def test_bootstrap_is_seeded_and_checks_its_block(spark):
    rows = spark.createDataFrame([("A", i, float(i % 5)) for i in range(60)], "series string, origin_index bigint, v double")
    a, b = (significance.bootstrap(x, ["series"], "v", 5, draws=200).first() for x in (rows, rows.orderBy(F.rand(2)).repartition(5)))
    assert a == b and a.low <= 2.0 <= a.high
    with pytest.raises(PySparkException, match="block"):
        significance.bootstrap(rows, ["series"], "v", 61).collect()


def test_covariates(spark):
    p = make_panel(spark, {"A": [float(x) for x in np.cumsum(np.arange(60) % 7)]})
    s, c = covariates.day_of_week(F.col("date"))
    monday = p.where("idx = 0").select(s.alias("s"), c.alias("c")).first()
    assert (monday.s, monday.c) == (0, 1)
    rel = spark.createDataFrame([("2024-01-03",)], "release string")
    got = {r.date.day: r.days_to_release for r in covariates.days_to_release(p.where("idx < 5"), rel).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 365, 5: 365}
    arms = {r.arm: r.mae for r in covariates.leak_summary(covariates.leak_control(p)).collect()}
    assert arms["leaked"] < 1e-9 < arms["clean"] == arms["leaked_flat_past"]
    summary = covariates.ablation_summary(covariates.covariate_ablation(p, F.lit(0.0), "none")).first()
    assert summary.ratio == 1


def test_grid(spark, tmp_path):
    c = grid.GridConfig("g", (4, 8), (1, 2), modes=("univariate", "placebo"))
    assert grid.cells(spark, c, 8).count() == 32 and grid.cells(spark, c, 7).count() == 16
    r = grid.dry_run(spark, c, make_panel(spark, {n: range(30) for n in "AB"}), 2).first()
    assert (r.n_origins, r.n_combos, r.n_skipped, r.estimated_calls) == (21, 16, 16, 21 * 16 * 2)
    assert grid.dry_run(spark, c, None, 2).first().n_origins == 0
    for bad in ({"config_id": ""}, {"horizons": ()}, {"horizons": (0,)}, {"modes": ("x",)}, {"transforms": ("x",)}, {"baselines": ("x",)}, {"placebo_panel_size": 0}, {"origin_stride": 0}, {"primary_horizons": (9,)}):
        with pytest.raises(ValueError):
            grid.GridConfig(**({"config_id": "g", "context_lengths": (4,), "horizons": (1,)} | bad))
    (tmp_path / "c.json").write_text(json.dumps({"config_id": "g"}))
    with pytest.raises(ValueError, match="context_lengths, horizons"):
        grid.GridConfig.load(str(tmp_path / "c.json"))
    assert grid.placebo_panel("abcdefgh", 3) == grid.placebo_panel("abcdefgh", 3)
    with pytest.raises(ValueError):
        grid.placebo_panel("ab", 3)


def test_grid_runs_every_cell(spark):
    values = {n: [float(5 * k + 10 + (i * (k + 2)) % 7) for i in range(12)] for k, n in enumerate("ABCD")}
    p = make_panel(spark, values)
    columns = ["context_len", "requested_horizon", "transform", "make_positive", "mode"]

    def ran(c):
        return {tuple(r) for r in grid.run_grid(p, c, forecast.empirical_step).select(*columns).distinct().collect()}

    def listed(c, pool):
        return {(r.context_len, r.horizon, grid.TRANSFORM_NAMES[r.transform], r.make_positive, r.mode) for r in grid.cells(spark, c, pool).collect()}

    c = grid.GridConfig("g", (4, 6), (1, 2), modes=("univariate", "multivariate", "placebo"), placebo_panel_size=2, season_length=3, origin_stride=2, baselines=("naive", "ets"))
    rows = grid.run_grid(p, c, forecast.empirical_step).collect()
    assert {(r.context_len, r.requested_horizon, r.transform, r.make_positive, r.mode) for r in rows} == listed(c, 4) and len(listed(c, 4)) == 48
    drawn = set(grid.placebo_panel("ABCD", 2))
    origins_of = {r.origin_index for r in rows if r.mode == "univariate"}
    for mode in c.modes:
        own = [r for r in rows if r.mode == mode]
        assert {r.series for r in own} == (drawn if mode == "placebo" else set("ABCD")) and {r.origin_index for r in own} == origins_of
        assert all(r.baseline_seasonal_naive is not None and r.baseline_ets is not None for r in own)
    for r in rows:
        if r.mode != "univariate":
            f = np.log1p if r.transform == "log1p" else np.asarray
            past = {s: f(np.array(values[s][r.origin_index - r.context_len : r.origin_index])) for s in (drawn if r.mode == "placebo" else "ABCD")}
            growth = np.mean([(x[-1] - x[0]) / x[0] for x in past.values()])
            want = past[r.series][-1] * (1 + 0.5 * growth * r.horizon_step / (r.context_len - 1))
            assert r.forecast == pytest.approx(np.expm1(want) if r.transform == "log1p" else want)
    one_mode = grid.GridConfig("g", (4,), (1,), modes=("placebo",), placebo_panel_size=3)
    assert ran(one_mode) == listed(one_mode, 4) != set()
    small = grid.GridConfig("g", (4,), (1,), modes=("placebo",))
    assert ran(small) == listed(small, 4) == set()
    two = grid.GridConfig("g", (4,), (1,), series=("A", "C"))
    assert {r.series for r in grid.run_grid(p, two, forecast.empirical_step).collect()} == {"A", "C"}


def test_multivariate_positivity(spark):
    p = make_panel(spark, {"A": [8, 4, 2, 0, 1], "B": [-1, 8, 1, -7, 1]})
    raw, cut = ({(r.series, r.origin_index): r for r in forecast.stacked_backtest(p, 3, 1, pull=9, make_positive=m).collect()} for m in (False, True))
    assert raw["A", 3].forecast < 0 == cut["A", 3].forecast == cut["A", 3].q10
    assert {k: r.forecast for k, r in cut.items() if k[0] == "B"} == {k: r.forecast for k, r in raw.items() if k[0] == "B"}


def test_ets_fills_prediction_rows_and_boards(spark):
    values = {"A": [10 + 3 * (i % 3) + i * 0.5 for i in range(16)], "B": [40 - i + (i * i) % 5 for i in range(16)], "C": [-5.0] * 16}
    p = make_panel(spark, values)
    for transform in ("identity", "log1p"):
        rows = forecast.backtest(p, forecast.last_plus_level(), 8, 2, season=3, transform=transform)
        got = forecast.with_ets(rows, p, 8, 2, season=3, transform=transform)
        assert got.columns == rows.columns and got.count() == rows.count() > 0
        for r in got.collect():
            ctx = np.array(values[r.series][r.origin_index - 8 : r.origin_index])
            if transform == "log1p" and r.series == "C":
                assert r.baseline_ets is None  # the context has no logarithm
            else:
                want = forecast.holt(np.log1p(ctx) if transform == "log1p" else ctx, 2, 3)[r.horizon_step - 1]
                assert r.baseline_ets == pytest.approx(np.expm1(want) if transform == "log1p" else want)
    scales = score.mase_scales(p, 8)
    long = score.leaderboard(forecast.with_ets(forecast.backtest(p, forecast.last_plus_level(), 8, 2, season=3), p, 8, 2, season=3), scales)
    n = {(r.baseline_method, r.series, r.horizon_step): r.n for r in long.collect()}
    assert all(n["ets", s, h] == n["naive", s, h] for s in "ABC" for h in (1, 2))


def test_vendor_rows(spark, tmp_path):
    rows = spark.createDataFrame([(12.5, 99.0), (None, 7.0), (None, None)], "market double, mid double")
    p, used = vendor.price("market_then_mid", F.col("market"), F.col("mid"))
    assert [tuple(r) for r in rows.select(p, used).collect()] == [(12.5, "market"), (7.0, "mid"), (None, None)]
    with pytest.raises(ValueError):
        vendor.price("low", F.col("market"), F.col("mid"))
    dup = spark.createDataFrame([(1, "Foil", 90.0), (1, "Normal", 30.0), (2, "Foil", 5.0), (3, "Foil", 1.0), (3, "Etched", 2.0)], "k bigint, s string, v double")
    assert {r.k: r.value for r in vendor.resolve_duplicates(dup.where("k < 3"), ["k"], "s", "v").collect()} == {1: 30, 2: 5}
    with pytest.raises(PySparkException, match="no single row"):
        vendor.resolve_duplicates(dup, ["k"], "s", "v").collect()
    used = spark.createDataFrame([("market",)] * 3 + [("mid",)] + [(None,)], "field_used string")
    assert {r.field_used: r.fraction for r in vendor.field_fractions(used, []).collect()} == {"market": 0.75, "mid": 0.25}
    (tmp_path / "e.csv").write_text("# comment\nlabel,group_abbreviation,product_name\na,G,P\n")
    (tmp_path / "e.json").write_text(json.dumps({"cards": [{"label": "a", "group_abbreviation": "G", "product_name": "P"}]}))
    assert vendor.load_entities(spark, str(tmp_path / "e.csv")).collect() == vendor.load_entities(spark, str(tmp_path / "e.json")).collect()
    with pytest.raises(ValueError):
        vendor.load_entities(spark, str(tmp_path / "e.txt"))


def test_entities_are_suggested(spark):
    specs = spark.createDataFrame([("x", "abc", "Blu Lantern")], "label string, group_abbreviation string, product_name string")
    groups = spark.createDataFrame([(1, "ABC")], "group_id bigint, abbreviation string")
    products = spark.createDataFrame([(1, 7, "Blue Lantern"), (1, 8, "Forest")], "group_id bigint, product_id bigint, name string")
    r = vendor.resolve_entities(specs, groups, products).first()
    assert r.product_id is None and r.suggestions[0] == "Blue Lantern"


def test_stored_panels_and_archives(spark, tmp_path):
    p = make_panel(spark, {"A": [1, 2], "B": [3, 4]})
    panels.write_panel(p, str(tmp_path / "p"))
    assert sorted(map(tuple, panels.read_panel(spark, str(tmp_path / "p"), "x", ["B"]).collect())) == sorted(map(tuple, p.where("series = 'B'").collect()))
    with pytest.raises(ValueError, match="Z"):
        panels.read_panel(spark, str(tmp_path / "p"), "x", ["A", "Z"])
    with pytest.raises(FileNotFoundError, match="the fetch step"):
        panels.read_panel(spark, str(tmp_path / "none"), "the fetch step")
    rows = make_rows(spark, [("A", 1, 1, 5, True, 5, 5)])
    panels.write_predictions(rows.unionByName(rows.withColumn("transform", F.lit("log1p"))), str(tmp_path / "r"))
    read = panels.read_predictions(spark, str(tmp_path / "r"), "univariate", "log1p")
    assert read.count() == 1 and "transform#" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    day = tmp_path / "arch" / "date=2024-01-01" / "group=5"
    day.mkdir(parents=True)
    (day / "prices.json").write_text('{"productId": 3, "marketPrice": 1.5}\n')
    assert vendor.load_archive(spark, str(tmp_path / "arch"), [5]).first().marketPrice == 1.5 and vendor.file_digests(spark, str(day)).count() == 1
    with lzma.open(day / "more.json.xz", "wt") as f:
        f.write('{"productId": 4, "marketPrice": 2.5}\n\n{"productId": 6}')
    got = vendor.load_archive(spark, str(tmp_path / "arch"), [5], xz=True).collect()
    assert sorted((r.productId, r.marketPrice, r.date.isoformat(), r.group) for r in got) == [(4, 2.5, "2024-01-01", 5), (6, None, "2024-01-01", 5)]
    assert vendor.load_archive(spark, str(tmp_path / "arch"), [7], xz=True).count() == 0
    (tmp_path / "h.json").write_text('{"a": {"2024-01-01": 1.0, "2024-01-02": 2.0}}')
    assert vendor.load_price_history(spark, str(tmp_path / "h.json")).count() == 2


def test_predictions_come_from_the_slice_that_holds_them(spark, tmp_path):
    rows = make_rows(spark, [("A", 1, 1, 5, True, 5, 5)])
    full, small = str(tmp_path / "full"), str(tmp_path / "small")
    with pytest.raises(FileNotFoundError):
        panels.load_predictions(spark, full, "univariate", "raw", small)
    panels.write_predictions(rows.unionByName(rows.withColumn("transform", F.lit("log1p"))), full)
    assert panels.load_predictions(spark, full, "univariate", "raw", small)[1] == full  # no slice yet
    mode, transform = rows.select("mode", "transform").first()
    panels.write_slice(rows, small, mode, transform)
    got, path = panels.load_predictions(spark, full, mode, transform, small, (mode, transform))
    assert path == small and got.count() == 1 and not {"mode", "transform", "baseline_drift", "baseline_ets"} & set(got.columns)
    got, path = panels.load_predictions(spark, full, mode, "log1p", small, (mode, transform))
    assert path == full and got.count() == 1


def test_manifest(tmp_path):
    out = manifest.write_manifest(str(tmp_path / "m.json"), {"x": 1}, manifest.resolve_as_of("2024-01-31", False))
    assert json.loads((tmp_path / "m.json").read_text()) == out and out["_meta"]["as_of"] == "2024-01-31" and not out["_meta"]["live_end"]
    for bad in ((None, False), ("2024-01-01", True)):
        with pytest.raises(ValueError):
            manifest.resolve_as_of(*bad)
    assert manifest.git_sha(str(tmp_path)) == "unknown"
    assert manifest.fill_template("a {{x}} {{y}}", {"x": 1}) == "a 1 [missing: y]"


def test_streaming_panel_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    streaming.run_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = set(map(tuple, streaming.panel(spark, str(tmp_path / "out")).select("series", "date", "value", "observed").collect()))
    end = max(d for _, d, _, _ in got)
    want = {tuple(r) for r in panels.activity(spark, sf).select("series", "date", "value", "observed").collect() if r.date <= end}
    assert want == got and len(want) > 3000


def test_stacked_plugin(spark):
    p = make_panel(spark, {"A": range(12), "B": range(10, 22)})

    def mean_last(ctx, h):
        point = np.broadcast_to(ctx[:, :, -1:].mean(axis=1, keepdims=True), (*ctx.shape[:2], h))
        return point, point[..., None] + np.array(LEVELS)

    rows = forecast.stacked_plugin_backtest(p, mean_last, 4, 2).where("origin_index = 5").collect()
    assert len(rows) == 4 and {r.forecast for r in rows} == {9.0} and {r.q90 for r in rows} == {9.9}
    assert {(r.series, r.horizon_step, r.actual) for r in rows} == {("A", 1, 5), ("A", 2, 6), ("B", 1, 15), ("B", 2, 16)}
    with pytest.raises(PySparkException, match="not aligned"):
        forecast.stacked_plugin_backtest(p.where("not (series = 'B' and idx > 8)"), mean_last, 4, 2).collect()
    with pytest.raises(PySparkException, match="one series at a time"):
        forecast.stacked_plugin_backtest(p, forecast.univariate_only(mean_last), 4, 2).collect()


def test_entity_series(spark):
    day = lambda d: START + timedelta(days=d)
    rows = [(day(0), 1, "Foil", None, 5.0), (day(2), 1, "Normal", 7.0, 1.0), (day(2), 1, "Foil", 9.0, 1.0), (day(2), 2, "Normal", 3.0, 3.0), (day(0), 3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, product_id bigint, subtype string, market double, mid double")
    entities = spark.createDataFrame([("one", 1), ("two", 2)], "label string, product_id bigint")
    p, used = vendor.entity_series(df, entities, unfilled="drop")
    assert sorted((r.series, r.date, r.value, r.observed) for r in p.collect()) == [("one", day(0), 5, True), ("one", day(1), 5, False), ("one", day(2), 7, True), ("two", day(2), 3, True)]
    assert {(r.series, r.field_used): r.n for r in used.collect()} == {("one", "mid"): 1, ("one", "market"): 1, ("two", "market"): 1}


def test_catalog_files(spark, tmp_path):
    (tmp_path / "groups.json").write_text(json.dumps({"results": [{"groupId": 1, "abbreviation": "abc", "name": "A", "categoryId": 1, "publishedOn": "2024-02-09T00:00:00"}, {"groupId": 2, "abbreviation": "X", "name": "B", "categoryId": 2}]}))
    (tmp_path / "p" / "group=1").mkdir(parents=True)
    (tmp_path / "p" / "group=1" / "p.json").write_text(json.dumps({"results": [{"productId": 7, "name": "Blue Lantern"}]}))
    groups, products = catalog.load_groups(spark, str(tmp_path / "groups.json"), 1), catalog.load_products(spark, str(tmp_path / "p"), [1])
    assert [(r.group_id, r.published) for r in groups.collect()] == [(1, "2024-02-09T00:00:00")] and products.first().product_id == 7
    specs = spark.createDataFrame([("x", "ABC", "blue lantern")], "label string, group_abbreviation string, product_name string")
    r = vendor.resolve_entities(specs, groups, products).first()
    assert (r.group_id, r.product_id, r.suggestions) == (1, 7, [])
    assert [r.release.isoformat() for r in vendor.release_dates(products, groups, specs).collect()] == ["2024-02-09"]
    for d in ("2024-02-08", "2024-02-09"):
        day = tmp_path / "arch" / f"date={d}"
        day.mkdir(parents=True)
        (day / "x.json").write_text('{"productId": 1}')
    assert catalog.probe_archive(spark, str(tmp_path / "arch"), "2024-02-08") == {"earliest": True, "day_before": False}
    assert [str(r.date) for r in catalog.archive_dates(spark, str(tmp_path / "arch")).sort("date").collect()] == ["2024-02-08", "2024-02-09"]
    (tmp_path / "bare").mkdir()
    assert catalog.archive_dates(spark, str(tmp_path / "bare")).count() == 0
    closes = spark.createDataFrame([("T", START, 1.0), ("T", START + timedelta(days=9), 2.0)], "ticker string, date timestamp_ntz, close double")
    closes.write.parquet(str(tmp_path / "c"))
    assert catalog.load_close(spark, str(tmp_path / "c"), "T", end="2024-01-05").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        catalog.load_close(spark, str(tmp_path / "c"), "Z")
    (tmp_path / "m.csv").write_text("DATE,CPI\n2024-01-01,100\n2024-02-01,.\n")
    assert [r.value for r in catalog.load_macro(spark, str(tmp_path / "m.csv"), "CPI").collect()] == ["100", "."]
    with pytest.raises(ValueError):
        catalog.load_macro(spark, str(tmp_path / "m.csv"), "GDP")
