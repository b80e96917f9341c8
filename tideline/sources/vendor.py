"""Vendor price rows and the catalog: price policy, duplicate rows, entity resolution, manifests of entities."""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.panel import dense
from ..schema import FILL_LIMIT

#: Price policies: which fields may be used, in order. Never the low or high price. [F2]
POLICIES = {"market_then_mid": ("market", "mid"), "market_only": ("market",), "mid_only": ("mid",)}
#: The subtype that wins among several rows of a product; a missing subtype counts as it. [F3]
PREFERRED = "Normal"


def price(policy: str, market: Column, mid: Column) -> tuple[Column, Column]:
    """(price, field_used) of a row under a policy; both NULL without a usable field. [F2]"""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {tuple(POLICIES)}")
    columns = {"market": market, "mid": mid}
    order = POLICIES[policy]
    used = F.coalesce(*(F.when(columns[f].isNotNull(), f) for f in order))
    return F.coalesce(*(columns[f] for f in order)), used


def field_fractions(rows: DataFrame, keys: list[str], field: str = "field_used") -> DataFrame:
    """Share of each field among the rows of a group that used one; groups without any give no rows. [SK7]"""
    counts = rows.where(F.col(field).isNotNull()).groupBy(*keys, field).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    both = counts.join(totals, keys) if keys else counts.crossJoin(totals)  # without keys there is one total
    return both.select(*keys, field, "n", (F.col("n") / F.col("total")).alias("fraction"))


def resolve_duplicates(rows: DataFrame, keys: list[str], subtype: str, value: str, conflicts: str = "raise") -> DataFrame:
    """(keys, n_rows, value, outcome): a single row wins whatever its subtype, of several the only preferred one; else refused, or NULL with conflicts='null'. [F3]"""
    good = F.col(subtype).isNull() | (F.col(subtype) == PREFERRED)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(good).alias("n_good"), F.max(value).alias("any"), F.max(F.when(good, F.col(value))).alias("good"))
    outcome = F.when(F.col("n_rows") == 1, "single").when(F.col("n_good") == 1, "preferred").otherwise("conflict")
    picked = F.when(F.col("n_rows") == 1, F.col("any")).when(F.col("n_good") == 1, F.col("good"))
    if conflicts == "raise":
        picked = picked.otherwise(F.raise_error(F.concat(F.lit("no single row for "), F.to_json(F.struct(*keys)))).cast(rows.schema[value].dataType))
    return out.select(*keys, "n_rows", picked.alias("value"), outcome.alias("outcome"))


def entity_series(rows: DataFrame, entities: DataFrame, policy: str = "market_then_mid", fill_limit: int = FILL_LIMIT, conflicts: str = "raise", unfilled: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Panel of the entities' prices and (series, field_used, n), how often each price field was used. [C3]

    rows: (date, product_id, subtype, market, mid); entities: (label, product_id). Duplicates are resolved, the policy picks a price, every day
    of the calendar gets a row and gaps are filled for at most ``fill_limit`` days.
    """
    own = rows.join(entities.select(F.col("label").alias("series"), "product_id"), "product_id")
    single = resolve_duplicates(own.withColumn("both", F.struct("market", "mid")), ["series", "date"], "subtype", "both", conflicts)
    p, used = price(policy, F.col("value.market"), F.col("value.mid"))
    priced = single.select("series", "date", p.alias("value"), used.alias("field_used"))
    counters = priced.where("field_used is not null").groupBy("series", "field_used").agg(F.count("*").alias("n"))
    return dense(priced.select("series", "date", "value"), "day", fill_limit, unfilled), counters


def resolve_entities(specs: DataFrame, groups: DataFrame, products: DataFrame, suggestions: int = 5) -> DataFrame:
    """(label, group_id, product_id, suggestions) for specs (label, group_abbreviation, product_name). [F4]

    Groups match by upper case, products by exact name whatever the case, the least id first. A miss has NULL ids and the nearest names by edit distance.
    """
    g = groups.groupBy(F.upper("abbreviation").alias("abbr")).agg(F.min("group_id").alias("group_id"))
    p = products.groupBy("group_id", F.lower("name").alias("p_name")).agg(F.min("product_id").alias("product_id"))
    found = specs.join(g, F.upper("group_abbreviation") == F.col("abbr"), "left")
    found = found.join(p, (found["group_id"] == p["group_id"]) & (F.lower("product_name") == F.col("p_name")), "left").select("label", "product_name", found["group_id"], "product_id")
    missing = found.where("product_id is null and group_id is not null").join(products.select("group_id", "name"), "group_id")
    near = missing.select("label", F.levenshtein(F.lower("product_name"), F.lower("name")).alias("d"), "name").distinct()
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("d", "name"))).where(F.col("at") <= suggestions)
    near = near.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "name"))).alias("s"))
    return found.join(near, "label", "left").select("label", "group_id", "product_id", F.transform(F.coalesce("s", F.array().cast("array<struct<d:int,name:string>>")), lambda x: x["name"]).alias("suggestions"))


def load_entities(spark: SparkSession, path: str) -> DataFrame:
    """Specs from CSV (# starts a comment) or JSON (a list, or an object with the list under cards); others and empty files are refused. [SC8]"""
    names = ["label", "group_abbreviation", "product_name"]
    if path.endswith(".csv"):
        out = spark.read.option("header", True).option("comment", "#").csv(path).select(*names)
    elif path.endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        out = raw.select(F.explode("cards").alias("c")).select(*(f"c.{n}" for n in names)) if "cards" in raw.columns else raw.select(*names)
    else:
        raise ValueError(f"{path}: neither CSV nor JSON")
    if not out.limit(1).count():
        raise ValueError(f"{path} has no entities")
    return out


_ROW = "productId BIGINT, subTypeName STRING, lowPrice DOUBLE, midPrice DOUBLE, highPrice DOUBLE, marketPrice DOUBLE"


def _xz_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of compressed files, some thousands at a time; only the compressed bytes are held whole."""
    for batch in batches:
        for row in batch.to_pylist():
            with lzma.open(io.BytesIO(row["content"]), "rt", encoding="utf-8") as file:
                lines = (x for x in file if x.strip())
                while some := list(islice(lines, 4096)):
                    columns = [pa.array(some, pa.string()), pa.array([row["date"]] * len(some), pa.date32()), pa.array([row["group"]] * len(some), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["line", "date", "group"])


def load_archive(spark: SparkSession, path: str, groups: list[int] | None = None, xz: bool = False) -> DataFrame:
    """Daily price rows of a JSON archive laid out as date=…/group=…; only the wanted groups' folders are read. [SC12 SC17]

    Plain and gzip files are read as they are; with ``xz`` the files that end so are, a file in a task.
    """
    if not xz:
        rows = spark.read.schema(f"{_ROW}, date DATE, group BIGINT").json(path)
        return rows.where(F.col("group").isin(groups)) if groups else rows
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path)
    files = files.where(F.col("group").isin(groups)) if groups else files
    files = files.select("content", F.col("date").cast("date").alias("date"), F.col("group").cast("bigint").alias("group"))
    lines = files.mapInArrow(_xz_lines, "line string, date date, group bigint")
    return lines.select(F.from_json("line", _ROW).alias("r"), "date", "group").select("r.*", "date", "group")


def load_price_history(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """(series, date, value) of a JSON map of entity to a map of date to price; with ``days`` only that many up to the newest date. [SC16]

    The file is read a map at a time, cut at closing braces, so that a file of many GB is spread over tasks and no row holds more than one entity.
    Names must not hold braces or quotes, as identifiers and dates do not.
    """
    parts = spark.read.option("lineSep", "}").text(path).select(F.regexp_extract("value", r'(?s)"([^"{}]+)"\s*:\s*\{(.*)$', 1).alias("series"), F.regexp_extract("value", r"(?s)\{([^{]*)$", 1).alias("body"))
    maps = parts.where("series <> ''").select("series", F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), "map<string,double>").alias("days"))
    rows = maps.select("series", F.explode("days").alias("day", "value")).select("series", F.to_date("day").cast("timestamp_ntz").alias("date"), "value")
    if days is None:
        return rows
    newest = rows.agg(F.max("date").alias("newest"))  # one row
    return rows.join(F.broadcast(newest), F.datediff("newest", "date") < days).drop("newest")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file of a folder. [SC12]"""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def release_dates(products: DataFrame, groups: DataFrame, tracked: DataFrame) -> DataFrame:
    """(release) of tracked groups, from the first ten characters of the date text; missing ones left out. [SC21]"""
    own = groups.join(tracked, F.upper(groups["abbreviation"]) == F.upper(tracked["group_abbreviation"]), "left_semi")
    return own.where("published is not null").select(F.to_date(F.substring("published", 1, 10)).alias("release")).distinct()
