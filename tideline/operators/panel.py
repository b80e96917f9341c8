"""Building panels: dense calendars, bounded fill, intersection, trimming, checks, year-on-year change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schema import FILL_LIMIT


def by_series() -> WindowSpec:
    return Window.partitionBy("series").orderBy("date")


def exact_mean(value: Column) -> Column:
    """Mean of values of two decimals, the same whatever the order of rows."""
    return F.sum(value.cast("decimal(20,2)")).cast("double") / F.count(value)


def bucket_means(rows: DataFrame, series: str, ts: str, value: str, unit: str) -> DataFrame:
    """(series, date, value): mean of each series in each unit of time that has rows."""
    date = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return rows.groupBy(F.col(series).alias("series"), date.alias("date")).agg(exact_mean(F.col(value)).alias("value"))


def with_index(panel: DataFrame) -> DataFrame:
    """Adds idx, the position in the series from 0."""
    return panel.withColumn("idx", (F.row_number().over(by_series()) - 1).cast("bigint"))


def dense(panel: DataFrame, step: str = "day", fill_limit: int = FILL_LIMIT, unfilled: str = "raise") -> DataFrame:
    """Every step from the first to the last date of all series, whether observed, and values carried on for at most ``fill_limit`` steps. [C1 C2]

    A gap that stays is refused when read (unfilled='raise'), kept as NULL ('keep') or left out ('drop').
    """
    ends = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = panel.select("series").distinct().crossJoin(ends)  # one row of two dates
    calendar = calendar.select("series", F.explode(F.expr(f"sequence(lo, hi, interval 1 {step})")).alias("date"))
    full = calendar.join(panel.select("series", "date", "value"), ["series", "date"], "left")
    filled = F.last("value", ignorenulls=True).over(by_series().rowsBetween(-fill_limit, 0))
    out = full.select("series", "date", filled.alias("value"), F.col("value").isNotNull().alias("observed"))
    if unfilled == "drop":
        out = out.where("value is not null")
    elif unfilled == "raise":
        out = out.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("gap longer than the fill limit in "), "series")).cast("double")))
    return with_index(out)


def intersect_calendar(panel: DataFrame) -> DataFrame:
    """Dates on which every series has a value and all values are above 0; everything counts as observed. [C4]"""
    n = panel.agg(F.countDistinct("series").alias("n_series"))
    days = panel.groupBy("date").agg(F.count("value").alias("n"), F.min("value").alias("low")).crossJoin(n)
    days = days.where("n = n_series and low > 0").select("date")
    return with_index(panel.join(days, "date", "left_semi").select("series", "date", "value", F.lit(True).alias("observed")))


def trim_shortest(panel: DataFrame) -> DataFrame:
    """The last n rows of every series, n the length of the shortest. [C5]"""
    sizes = panel.groupBy("series").count().agg(F.min("count").alias("least"))
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("date")))
    return with_index(panel.withColumn("back", back).crossJoin(sizes).where("back <= least").drop("back", "least", "idx"))


def unaligned_dates(panel: DataFrame) -> DataFrame:
    """Dates that not all series have; empty for a panel that can be stacked. [C6]"""
    n = panel.agg(F.countDistinct("series").alias("n_series"))
    return panel.groupBy("date").agg(F.count("*").alias("n")).crossJoin(n).where("n <> n_series").select("date", "n")


def violations(panel: DataFrame) -> DataFrame:
    """(check_name, violations): dates that do not rise, values that are missing or not finite. [C7]"""
    before = F.lag("date").over(by_series())
    rows = panel.withColumn("before", before)
    bad = rows.agg(
        F.count_if(F.col("date") <= F.col("before")).alias("dates_not_rising"),
        F.count_if(F.col("value").isNull()).alias("values_missing"),
        F.count_if(F.isnan("value") | F.col("value").isin(float("inf"), float("-inf"))).alias("values_not_finite"),
    )
    return bad.unpivot([], ["dates_not_rising", "values_missing", "values_not_finite"], "check_name", "violations")


def year_on_year(rows: DataFrame, date: str, value: str, lag: int = 12, until: str | None = None) -> DataFrame:
    """(date, yoy): change in per cent against the row ``lag`` places before, after values that are no numbers are dropped. [C8 C9]"""
    clean = rows.select(F.col(date).alias("date"), F.try_to_number(F.col(value), F.lit("S999999999999.999999")).cast("double").alias("v")) if dict(rows.dtypes)[value] == "string" else rows.select(F.col(date).alias("date"), F.col(value).alias("v"))
    clean = clean.where(F.col("v").isNotNull() & ~F.isnan("v"))
    # One macro series: its rows are few by nature.
    before = F.lag("v", lag).over(Window.partitionBy(F.lit(0)).orderBy("date"))
    out = clean.select("date", (F.try_divide(F.col("v") - before, before) * 100).alias("yoy")).where("yoy is not null")
    return out.where(F.to_date("date") <= F.lit(until).cast("date")) if until else out


def log1p_pair() -> tuple:
    return F.log1p, F.expm1


#: Transforms by the name that rows carry; configurations call the first one raw. [C10]
TRANSFORMS = {"identity": (lambda c: c, lambda c: c), "log1p": log1p_pair()}
