"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Every coordinate has a learning rate of its own and an L1 bound that keeps rare features at zero,
so that the weights are few and fit a broadcast: at most 2 ** BITS of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table
from .tokens import text_chunks
from .worker import caches, serves

#: Hashed features, and the most labelled rows that the model is fitted on (taken by a digest of their ids where there are more).
BITS, SAMPLE_ROWS = 20, 16_000
#: FTRL: learning rate and its offset, L1 and L2 bounds, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 2.0, 0.0, 3
#: Every so many rows one is kept out of a first fit, whose scores of these rows set the bias; not done with fewer rows labelled 1 among them.
TUNED_EVERY, TUNED_LEAST = 4, 20
#: A document counts as toxic from this score on.
THRESHOLD = 0.7
#: Words whose digests a worker remembers; a digest is cheap, so they are few.
CACHE_WORDS = 60_000

_WORD = re.compile(r"\w+")


class _Digests(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_digests = _Digests()
caches.append(_digests.clear)


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, one after another, and where each text's begin: single words, neighbours, and words two apart."""
    words = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    get = _digests.__getitem__
    h = np.fromiter((get(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    parts, docs, shift = [h], [doc], np.uint64(64 - bits)
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap]
        parts.append((h[:-gap] * np.uint64(odd) + (h[gap:] ^ (h[gap:] >> np.uint64(29))))[same])
        docs.append(doc[gap:][same])
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    order = np.concatenate(docs)
    index = (mixed >> shift).astype(np.int32)
    return index, order


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # features with a weight, ascending
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each text's score from 0 to 1; a feature counts once a text, a text without words has the bias alone."""
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.index] = self.weight
        return scored(texts, dense, self.bias, self.bits)


def scored(texts: list[str], dense: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    index, doc = features(texts, bits)
    hit = dense[index] != 0
    pairs = np.unique(doc[hit].astype(np.int64) << np.int64(bits) | index[hit])
    total = np.bincount(pairs >> bits, weights=dense[pairs & ((1 << bits) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def _fitted(docs: list[np.ndarray], labels: list[int], size: int, passes: int) -> np.ndarray:
    """The weights that FTRL-proximal gives; a document is the array of its features, the last coordinate the bias, which has no L1 bound."""
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        bound = l1[at]
        w = (np.sign(zi) * bound - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= bound, 0.0, w)

    rng = np.random.default_rng(0)
    for p in range(passes):
        for i in rng.permutation(len(docs)) if p else range(len(docs)):
            at = docs[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    return weights(np.arange(size))


def _cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the best F0.5, which counts precision more, half-way to the next row below."""
    order = np.argsort(-logits)
    found = np.cumsum(labels[order])
    f = 1.25 * found / (np.arange(1, len(labels) + 1) + 0.25 * labels.sum())
    k = int(np.argmax(f))
    return float(logits[order[k]] + logits[order[min(k + 1, len(order) - 1)]]) / 2


def fit(rows: Iterable[tuple[list[str], list[int]]], bits: int = BITS, passes: int = PASSES) -> Model:
    """Fits the weights to batches of (texts, labels), in their order, then sets the bias so that THRESHOLD parts the labels best (by F0.5)."""
    docs: list[np.ndarray] = []
    labels: list[int] = []
    size = (1 << bits) + 1
    for texts, own in rows:
        index, doc = features(texts, bits)
        pairs = np.unique(doc.astype(np.int64) << np.int64(bits) | index)
        stops = np.searchsorted(pairs >> bits, np.arange(len(texts)), "right")
        docs += [np.append(d, size - 1) for d in np.split((pairs & ((1 << bits) - 1)).astype(np.int32), stops[:-1])] if texts else []
        labels += own
    shift, y = 0.0, np.array(labels)
    if TUNED_LEAST <= y.sum() <= len(y) - TUNED_LEAST:  # fewer rank too few rows to set a cut
        few = not TUNED_LEAST <= y[::TUNED_EVERY].sum() <= len(y[::TUNED_EVERY]) - TUNED_LEAST
        logits = np.full(len(y), np.nan)
        for fold in range(TUNED_EVERY if few else 1):  # with few labels each part is left out once, so that all of them set the cut
            part = [i for i in range(len(docs)) if i % TUNED_EVERY != fold]
            w = _fitted([docs[i] for i in part], [labels[i] for i in part], size, passes)
            logits[fold::TUNED_EVERY] = [w[d].sum() for d in docs[fold::TUNED_EVERY]]
        out = ~np.isnan(logits)
        shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - _cut(logits[out], y[out])
    w = _fitted(docs, labels, size, passes)
    keep = np.flatnonzero(w[:-1])
    return Model(keep.astype(np.int32), w[keep].astype(np.float32), float(w[-1]) + shift, bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", allowed: Column | None = None) -> Model:
    """Fits the model to at most SAMPLE_ROWS (in expectation) labelled rows; only texts and labels enter.

    ``allowed`` restricts the rows of ``labels``. A row labelled more than once counts as 1 if any label is 1; null labels
    and ids are left out, null texts are empty. Without labelled rows every score is 0.5.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    own = own.where(allowed) if allowed is not None else own
    own = own.groupBy(F.col(id_col).alias("l_id")).agg(F.max(label).cast("int").alias("l"))
    share = min(1.0, SAMPLE_ROWS / max(1, own.count()))
    place = F.pmod(F.xxhash64(F.col("l_id").cast("string")), F.lit(1 << 30))
    sample = own.where(place < int(share * (1 << 30)))
    # The sample has some SAMPLE_ROWS rows of two numbers however large the tables are, so it may be sent to every executor.
    rows = docs.select(F.col(id_col).alias("l_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "l_id")
    rows = rows.select("text", "l", F.xxhash64("l_id", "text").alias("o")).repartition(1).sortWithinPartitions("o", "text")

    @serves("toxicity fit")
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple[list[str], list[int]]]:
            for batch in batches:
                for part, texts in text_chunks(batch, "text"):
                    yield texts, part.column(1).to_pylist()

        m = fit(read())
        yield pa.RecordBatch.from_pydict({"i": np.append(m.index, -1).astype(np.int32), "w": np.append(m.weight, m.bias).astype(np.float64)})

    found = rows.mapInArrow(one, "i int, w double").toPandas().sort_values("i")
    i, w = found["i"].to_numpy(np.int32), found["w"].to_numpy()
    return Model(i[i >= 0], w[i >= 0].astype(np.float32), float(w[i < 0].sum()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (double) and predicted (int); columns of these names are replaced.

    A null or empty text has the score of the bias alone. Equal texts have equal scores; an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.index, model.weight, model.bias, model.bits))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    @serves("toxicity")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, bias, bits = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[index] = weight
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scored(texts, dense, bias, bits), pa.float64())], names=[*part.schema.names, "score"])

    return docs.mapInArrow(partition, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id is not one of them (it has no label)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), allowed=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
