"""Schemas and fixed numbers shared by all operators.

NULL is the only missing value; NaN is turned into NULL at every source and Python boundary.
"""

from __future__ import annotations

# Fixed values.
SEED = 42
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
QUANTILES = tuple(f"q{round(100 * level)}" for level in LEVELS)
CONTEXT, HORIZON = 64, 28
FILL_LIMIT = 3
SHOCK_CONTEXT, SHOCK_BEFORE, SHOCK_AFTER = 256, 12, 25
SHOCK_Z, SHOCK_TOLERANCE = 4.0, 3
LAG_MULTIPLIERS, LAG_HEADLINE, LAG_RUN = (1.25, 1.5, 2.0), 1.5, 3
REGIME_DAYS = 3
GLITCH_JUMP, GLITCH_RETURN = 0.25, 0.15
DM_LEAST_ROWS = 8
TINY, TINY_SCALE, TINY_MAE = 1e-8, 1e-12, 1e-9
HISTORY_ROWS, VIGNETTE_ROWS = 120, 20
COV_CONTEXT, COV_HORIZON, COV_ORIGINS = 32, 5, 40
RELEASE_CAP = 365

PANEL = "series STRING, date TIMESTAMP_NTZ, value DOUBLE, observed BOOLEAN, idx BIGINT"
BASELINES = ("naive", "drift", "seasonal_naive", "ets")
PREDICTION_COLUMNS = (
    "mode", "transform", "make_positive", "series", "origin_index", "origin_date", "target_index", "target_date", "horizon_step",
    "actual", "observed", "forecast", *QUANTILES, *(f"baseline_{b}" for b in BASELINES),
)
PREDICTIONS = ", ".join(
    [
        "mode STRING, transform STRING, make_positive BOOLEAN, series STRING, origin_index BIGINT, origin_date TIMESTAMP_NTZ",
        "target_index BIGINT, target_date TIMESTAMP_NTZ, horizon_step BIGINT, actual DOUBLE, observed BOOLEAN, forecast DOUBLE",
        *(f"{q} DOUBLE" for q in QUANTILES),
        *(f"baseline_{b} DOUBLE" for b in BASELINES),
    ]
)
