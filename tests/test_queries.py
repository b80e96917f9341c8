"""Every registered query with SQL gives the same rows in DuckDB."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from tideline.plans import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return x.isoformat() + "T00:00:00" if isinstance(x, date) else x


@pytest.mark.parametrize("name", queries.SQL)
def test_same_rows(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(queries.SQL[name])
    assert sorted(relation.columns) == columns
    got = sorted((tuple(plain(x) for x in row) for row in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(plain(x) for x in row) for row in relation.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want and (got or name == "panel_unaligned")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_rows_without_sql(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        d = r.asDict()
        if "low" in d:
            assert d["low"] <= d["mean"] <= d["high"]
        if "cp_low" in d:
            assert 0 <= d["cp_low"] <= d["hits"] / d["n"] <= d["cp_high"] <= 1
        if d.get("dm_p") is not None:
            assert 0 <= d["dm_p"] <= d["q_value"] <= 1


def test_every_valid_origin_and_step_counts(spark):
    rows = queries.QUERIES["panel_intersection"](spark, SF).groupBy("series").count().collect()
    got = Counter((r.series, r.horizon_step) for r in queries.QUERIES["ets_baseline"](spark, SF).collect())
    assert got == {(r.series, h): r["count"] - 64 - 7 + 1 for r in rows for h in range(1, 8)}
    assert {r.horizon_step for r in queries.QUERIES["conformal"](spark, SF).select("horizon_step").distinct().collect()} == set(range(1, 29))


def test_every_supplier_is_priced(spark, con):
    want = {r[0] for r in con.sql("SELECT DISTINCT 'supplier ' || l_suppkey FROM lineitem").fetchall()}
    for name in ("entity_series", "entity_price_usage"):
        assert {r.series for r in queries.QUERIES[name](spark, SF).select("series").distinct().collect()} == want and len(want) > 5


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_is_whole():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
