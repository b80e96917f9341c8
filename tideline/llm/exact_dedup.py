"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. New rows are reduced to one
candidate a digest, held against the index by a sort-merge anti-join that reads the index
without a shuffle, and appended in the same bucket layout, as a partition for each batch: a batch
that is run again after a failure takes the place of what it had appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import make_path, new_path, stored, table, whole_text

#: Deleted before texts are compared.
WHITESPACE = " \t\n\x0b\f\r"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
_INDEX_SCHEMA = "digest STRING, keep_id BIGINT, n_chars BIGINT, batch BIGINT"


def normal_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space."""
    return F.sha2(F.translate(text, WHITESPACE, ""), 256)


def buckets(spark: SparkSession) -> int:
    """Buckets for a new index: one for each shuffle partition of the session, as a batch is joined with the index bucket by bucket."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


class DigestIndex:
    """Digests seen so far, kept at ``path`` in ``buckets`` buckets sorted by digest, partitioned by batch.

    Opening the same path with the same number of buckets in a later session finds the earlier digests. The first batch that
    brings a text owns it: within a batch the row with the most code points, then the smallest
    id stays; a row whose text another batch brought is dropped in favour of that one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({_INDEX_SCHEMA}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        make_path(spark, path)
        spark.catalog.recoverPartitions(self.name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Puts the digests of ``rows`` (digest, keep_id, n_chars; one row a digest) that no other batch has in the place of this batch's."""
        others = self.entries().where(F.col("batch") != batch).select("digest")
        fresh = rows.hint("merge").join(others, "digest", "left_anti")
        before = self.spark.conf.get(_OVERWRITE)
        self.spark.conf.set(_OVERWRITE, "dynamic")  # only this batch's partition is replaced, when the job commits
        try:
            # One task a bucket, so that each batch adds one sorted file to a bucket.
            (
                fresh.select("digest", "keep_id", "n_chars", F.lit(batch).cast("bigint").alias("batch"))
                .repartition(self.buckets, "digest")
                .write.insertInto(self.name, overwrite=True)
            )
        finally:
            self.spark.conf.set(_OVERWRITE, before)


def new_batch() -> int:
    """A number that no other batch has."""
    return uuid.uuid4().int >> 66


def _key_columns(doc_id: Column, text: Column) -> list[Column]:
    return [normal_digest(text).alias("text_sha256"), F.length(text).cast("bigint").alias("n_chars"), doc_id.cast("bigint").alias("doc_id")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What is compared of each row: digest, id and size."""
    return docs.select(*_key_columns(F.col(id_col), whole_text(text_col)))


def _owned(keyed: DataFrame, index: DigestIndex, batch: int | None) -> DataFrame:
    """Puts the rows' digests into the index; for each of them whose row stays, its size, whether this batch owns it, and the rows that share it."""
    # Counted and ranked before the shuffle: a text that holds a third of all rows is one row a task here.
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))
    groups = keyed.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    number = new_batch() if batch is None else batch
    index.add(groups.select(F.col("text_sha256").alias("digest"), F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n_chars")), number)
    entries = index.entries().select(F.col("digest").alias("text_sha256"), "keep_id", F.col("n_chars").alias("keep_chars"), (F.col("batch") == number).alias("new"))
    # Written first: a join of two plain exchanges can be split where one text has very many rows.
    return stored(groups.select("text_sha256", "group_size").join(entries, "text_sha256"), "owned")[0]


def _winners(rows: DataFrame, owned: DataFrame, how: str) -> DataFrame:
    """``rows`` with won: one row of each text that this batch owns."""
    # Joined on id and size too, so that the rows of a group of copies go to many tasks.
    new = owned.where("new").select(F.col("text_sha256").alias("o_digest"), F.col("keep_id").alias("o_id"), F.col("keep_chars").alias("o_n"))
    on = (rows["text_sha256"] == new["o_digest"]) & rows["doc_id"].eqNullSafe(new["o_id"]) & (rows["n_chars"] == new["o_n"])
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id", "n_chars").orderBy(F.lit(1))) == 1
    return rows.join(new, on, how).withColumn("won", F.col("o_digest").isNotNull() & first).drop("o_digest", "o_id", "o_n")


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted; a null text is an empty one, and
    empty texts are equal to each other. Of equal texts in a batch the one with the most code
    points stays, then the smallest id (null ids last); of rows that repeat id and text exactly
    one. A row whose text another batch of the index has is not kept, and keep_id is that of this
    batch. group_size counts the rows of this batch that share the text. An empty table gives no
    rows; further columns are left out. ``batch`` names these rows in the index: run again under the same
    number they give the same result. Batches are to be added one after another.
    """
    keyed, _ = stored(_keyed(docs, id_col, text_col), "digests")  # texts are read and hashed once
    owned = _owned(keyed, index, batch)
    marked = _winners(keyed, owned, "left").select("doc_id", "text_sha256", F.col("won").alias("kept"))
    return marked.join(owned, "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> DataFrame:
    """Only the rows that ``dedup`` marks as kept, with all columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names: a column of docs may have any
    keyed, _ = stored(_keyed(docs, id_col, text_col), "digests")
    owned = _owned(keyed, index, batch)
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names)
    rows = rows.select("*", *_key_columns(F.col(at[id_col]), F.coalesce(F.col(at[text_col]), F.lit(""))))
    return _winners(rows, owned, "inner").where("won").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = DigestIndex(spark, new_path(spark, "digest-index"), buckets(spark))
    marked = dedup(docs, index)
    index.close()
    return marked


OP10_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
"""
