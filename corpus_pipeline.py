"""From documents to packed training sequences: five stages, each written as Parquet and read again.

The toxicity model is fitted on the labels of documents whose held_out is false, as in its query. Repeated passages are removed
wherever they stand, so a text may come out empty; its row stays and packs as an end id. n_chars follows the text.

Every stage takes null ids and texts (a null text is an empty one), empty and very long texts, rows that repeat and further columns of
any name; all columns but the text that is cut, and n_chars then, go through unchanged. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, minhash, packing, shared, suffix_dedup, toxicity
from tideline.llm.tokens import vocabulary


def beside(docs: DataFrame, *taken: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of the names that an operator makes itself renamed, and how to name them back."""
    own, back = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in taken:
            new = f"own_{c}"
            while new.lower() in own:
                new += "_"
            own.add(new.lower())
            back[new] = c
    return docs.withColumnsRenamed({c: new for new, c in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; equal texts go or stay together, texts without words have the score of the bias alone."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"), allowed=~toxicity.held_out())
    rest, back = beside(docs, "score", "predicted")
    return toxicity.score(rest, model).where("predicted = 0").select(*rest.columns).withColumnsRenamed(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, index_path: str | None = None, batch: int | None = None) -> DataFrame:
    """One document of each text, white space aside: the longest, then the smallest id, null ids last; of rows that repeat, one.

    Texts without any character but white space are equal too, so one of them stays.
    A run over a whole corpus has an index of its own. ``index_path`` names one that lasts, against which a later batch of documents is
    held too; ``batch`` then names the documents, so that they can be run again.
    """
    index = exact_dedup.DigestIndex(spark, index_path or shared.new_path(spark, "digest-index"), exact_dedup.buckets(spark))
    kept = exact_dedup.survivors(docs, index, batch=batch)
    index.close()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, null ids last; texts without words form one group."""
    return minhash.survivors(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that stand anywhere else too, repeated rows included; null texts come out empty."""
    rest, back = beside(docs, "kept", "removed")
    cut = suffix_dedup.remove_repeats(rest, kind=suffix_dedup.WORDS, as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*rest.columns).withColumnsRenamed(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids, with a checksum in place of the ids; every row is packed for itself, whatever its id."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix dedup", cut_repeats),
    ("packing", pack),
]

#: Hashing, sampling and tokenizers have no SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with shared.scratch(spark):  # what a stage has stored goes with it, but for its result
            done = stage(spark, docs, sf_dir)
            docs, path = shared.stored(done, "stage-" + name.replace(" ", "-"), keep=True)
        if before:
            shared.drop_path(spark, before)
        before = path
    return docs
