"""Near-duplicate groups by BagMinHash over bags of word shingles.

A shingle that occurs w times has weight w. Weights are discretised at integers and split hierarchically at powers of two:
(0, 1], (1, 2], (2, 4], (4, 8] ... Each shingle has a Poisson process on each of these blocks, whose points carry a
place in the block; a point counts where its place is at most w. Points come in increasing order and fall on one of the
signature's registers, which keep the least, so that a process is left as soon as it has passed the largest register.
Two registers agree with the probability of the weighted Jaccard similarity of the bags.

Bands of registers name candidate buckets; candidates are verified on their whole bags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_path, stored, table
from .tokens import text_chunks
from .worker import serves

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 6 registers: a pair of similarity 0.8 shares a band with a probability of 0.9993, of 0.5 with 0.31.
BANDS, BAND_ROWS = 24, 6
REGISTERS = BANDS * BAND_ROWS
#: Rounds in which one member of each bucket is held against all others, and members that are held at once after them.
LEADER_ROUNDS, BLOCK = 2, 1024

_G1, _G2, _G3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * _G2
    x = (x ^ (x >> np.uint64(29))) * _G2
    return x ^ (x >> np.uint64(32))


def _power_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte * odd ** place modulo 2 ** 64, and the inverse powers."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    up = np.full(len(data), base, np.uint64)
    down = np.full(len(data), inverse, np.uint64)
    up[:1] = down[:1] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums, down


def shingle_digests(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all word shingles of each text, one text after another, and the text of each.

    Words are runs of bytes other than white space and controls, A-Z lower-cased. A text of fewer words than ``size`` is one shingle.
    """
    parts = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    edge = np.diff((data > 32) & (data != 127), prepend=False, append=False)
    at = np.flatnonzero(edge)
    begin, end = at[::2], at[1::2]
    sums, down = _power_sums(data)
    with np.errstate(over="ignore"):
        word = mix((sums[end] - sums[begin]) * down[np.minimum(begin, len(down) - 1)] + (end - begin).astype(np.uint64) * _G1)
        stops = np.cumsum(sizes + 1)
        doc = np.searchsorted(stops, begin, "right")
        n = len(word)
        sh = np.zeros(max(0, n - size + 1), np.uint64)
        for i in range(size):
            sh = sh * _G3 + word[i : n - size + 1 + i] if len(sh) else sh
        whole = doc[: len(sh)] == doc[size - 1 :] if len(sh) else np.zeros(0, bool)
        digests, docs = mix(sh[whole]), doc[: len(sh)][whole]
        counts = np.bincount(doc, minlength=len(texts))
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            extra = np.zeros(len(short), np.uint64)
            for i in range(size - 1):
                inside = counts[short] > i
                extra[inside] = extra[inside] * _G3 + word[first[short[inside]] + i]
            digests, docs = np.concatenate([digests, mix(extra ^ _G1)]), np.concatenate([docs, short])
    return digests, docs


def bags(digests: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their multiplicities: (digest, text, count), sorted by text, then digest."""
    order = np.lexsort((digests, docs))
    digests, docs = digests[order], docs[order]
    new = np.ones(len(digests), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (docs[1:] != docs[:-1])
    starts = np.flatnonzero(new)
    return digests[starts], docs[starts], np.diff(starts, append=len(digests))


def signatures(digests: np.ndarray, docs: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures, (texts, registers) of doubles; a text without shingles has infinities."""
    sig = np.full((n_docs, registers), np.inf)
    flat = sig.ravel()
    levels = [(0, 1)]
    while levels[-1][1] < (int(weights.max()) if len(weights) else 1):
        levels.append((levels[-1][1], 2 * levels[-1][1]))
    seed, doc, rate, reach = [], [], [], []
    with np.errstate(over="ignore"):
        for k, (low, high) in enumerate(levels):
            own = weights > low
            seed.append(mix(digests[own] + np.uint64(k + 1) * _G1))
            doc.append(docs[own])
            rate.append(np.full(int(own.sum()), float(high - low)))
            reach.append((weights[own] - low) / (high - low))  # share of the block that the weight covers
        seed, doc, rate, reach = (np.concatenate(x) for x in (seed, doc, rate, reach))
        point, step = np.zeros(len(seed)), 0
        while len(seed):
            step += 1
            h = mix(seed + np.uint64(step) * _G3)
            point = point - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            if step > 1:  # in the first round most registers are still open
                keep = point < sig.max(axis=1)[doc]
                seed, doc, rate, reach, point, h = (x[keep] for x in (seed, doc, rate, reach, point, h))
            g = mix(h + _G1)
            place = (g >> np.uint64(40)).astype(np.float64) * 2.0**-24
            inside = place < reach
            register = (g & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
            np.minimum.at(flat, doc[inside] * registers + register[inside].astype(np.int64), point[inside])
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A digest of each band of each signature, (texts, bands); bands of a text without shingles are meaningless."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G1, bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(bits.shape[2]):
            out = mix(out ^ bits[:, :, i] * _G3)
    return out


def numbered(digests: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bags as sets: the i-th occurrence of a shingle in a text is an element of its own."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    nth = np.arange(total) - np.repeat(first, counts)
    with np.errstate(over="ignore"):
        return mix(np.repeat(digests, counts) + nth.astype(np.uint64) * _G1), np.repeat(docs, counts)


_SIGNED = "doc_id bigint, uid bigint, digest string, keys array<bigint>, n_shingles bigint"


def sign(units: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (doc_id, uid, digest, text) with band keys and the size of the bag in place of the text."""

    @serves("near dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col, 1_000_000):
                digests, docs, counts = bags(*shingle_digests(texts))
                sizes = np.bincount(docs, weights=counts, minlength=len(texts)).astype(np.int64)
                sig = signatures(digests, docs, counts, len(texts))
                made = [_lists(band_keys(sig).view(np.int64), pa.int64()), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *made], names=["doc_id", "uid", "digest", "keys", "n_shingles"])

    return units.select("doc_id", "uid", "digest", text_col).mapInArrow(partition, _SIGNED)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if len(rows) else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def bag_sets(units: DataFrame, text_col: str = "text") -> DataFrame:
    """uid and bag (array of digests of numbered shingles) for units (uid, text)."""

    @serves("near dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, text_col, 1_000_000):
                elements, docs = numbered(*bags(*shingle_digests(texts)))
                offsets = np.searchsorted(docs, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int64)))], names=["uid", "bag"])

    return units.select("uid", text_col).mapInArrow(partition, "uid bigint, bag array<bigint>")


def components(edges: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(uid, comp) of every node of the edges (a, b): the least uid that it is connected with.

    Every round each node takes the least label around it, then the label of its label; rounds end when nothing
    changes. Each round is a written table. A hub's neighbours are reduced before the shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edge_path = stored(both, f"{name}-edges")
    labels, path = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("uid"), F.least("a", "m").alias("comp")), f"{name}-labels")
    while True:
        around = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(around.withColumnRenamed("a", "uid"), "uid").select("uid", "comp", F.least("comp", "m").alias("low"))
        hop = labels.select(F.col("uid").alias("low"), F.col("comp").alias("next"))
        new, new_path = stored(low.join(hop, "low").select("uid", "comp", F.least("low", "next").alias("new")), f"{name}-labels")
        changed = new.where("new <> comp").limit(1).count()
        drop_path(labels.sparkSession, path)
        labels, path = new.select("uid", F.col("new").alias("comp")), new_path
        if not changed:
            drop_path(labels.sparkSession, edge_path)
            return labels, path


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose whole bags have the similarity: overlap over union of the multisets."""
    left, right = (sets.select(F.col("uid").alias(c), F.col("bag").alias(f"bag_{c}")) for c in "ab")
    small, large = F.least(F.size("bag_a"), F.size("bag_b")), F.greatest(F.size("bag_a"), F.size("bag_b"))
    both = pairs.join(left, "a").join(right, "b").where(small >= similarity * large)
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.where(shared >= similarity * (F.size("bag_a") + F.size("bag_b") - shared)).select("a", "b")


def leader_pairs(members: DataFrame, labels: DataFrame, first: bool) -> DataFrame:
    """Distinct pairs of a bucket's leader with every member of another component.

    At first the leader is the bucket's least uid, later the least one outside that one's component.
    """
    own = members.join(labels, "uid")
    if first:
        leads = own.groupBy("key").agg(F.min("uid").alias("a"), F.min_by("comp", "uid").alias("lead_comp"))
    else:
        main = own.groupBy("key").agg(F.min_by("comp", "uid").alias("main"))
        leads = own.join(main, "key").where("comp <> main").groupBy("key").agg(F.min("uid").alias("a"), F.min_by("comp", "uid").alias("lead_comp"))
    pairs = own.join(leads, "key").where("comp <> lead_comp")
    return pairs.select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b")).distinct()


def residual_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of one bucket and two components; of several from a text to one component, one.

    Members outside the component of the bucket's least uid are the queries. They meet all members in blocks, so no task
    holds more than a block of each, however large the bucket; whole bags are compared and only links leave the task.
    """
    own = members.join(labels, "uid")
    facts = own.groupBy("key").agg(F.min_by("comp", "uid").alias("main"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = own.join(facts.select("key", "main", "n"), "key").withColumn("out", F.col("comp") != F.col("main"))
    outs = rows.where("out").groupBy("key").agg(F.count("*").alias("n_out"))
    rows = rows.join(outs, "key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("uid", "key"), blocks(n)).cast("int")
    queries = rows.where("out").select("key", "uid", "comp", F.lit(True).alias("query"), place("n_out").alias("i"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("j"))
    held = rows.select("key", "uid", "comp", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), blocks("n_out") - 1)).alias("i"), place("n").alias("j"))
    units = queries.unionByName(held).join(sets, "uid").select("key", "i", "j", "uid", "comp", "query", "bag")
    return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "a bigint, b bigint").distinct()


@serves("near dedup")
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the units of sorted rows, one after another."""
    rest = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rows = new if rest is None else pa.concat_tables([rest, new])
        unit = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        starts = np.append(0, np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1)
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield from _links(rows.slice(begin, end - begin))
        rest = rows.slice(int(starts[-1]))
    if rest is not None:
        yield from _links(rest)


def _links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    uid, comp, query = rows.column("uid").to_numpy(), rows.column("comp").to_numpy(), rows.column("query").to_numpy(zero_copy_only=False)
    lists = rows.column("bag").combine_chunks()
    stops = lists.offsets.to_numpy().astype(np.int64)
    flat, stops, sizes = lists.flatten().to_numpy(), stops - stops[0], np.diff(stops)
    q, m = np.flatnonzero(query), np.flatnonzero(~query)
    # Elements of the members in order, each with its owner: a query's overlap with all of them is counted in one pass.
    elements = np.concatenate([flat[stops[i] : stops[i + 1]] for i in m]) if len(m) else flat[:0]
    owner = np.repeat(np.arange(len(m)), sizes[m])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    found: list[tuple[int, int]] = []
    for i in q:
        bag = flat[stops[i] : stops[i + 1]]
        low, high = np.searchsorted(elements, bag, "left"), np.searchsorted(elements, bag, "right")
        n = high - low
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        shared = np.bincount(owner[at], minlength=len(m))
        near = np.flatnonzero((shared >= SIMILARITY * (len(bag) + sizes[m] - shared)) & (comp[m] != comp[i]))
        _, one = np.unique(comp[m[near]], return_index=True)
        found += [(min(uid[i], x), max(uid[i], x)) for x in uid[m[near[one]]]]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_md5, class_id, class_size, kept.

    Classes are the connected components of links: pairs of texts of a weighted Jaccard similarity of SIMILARITY or more over their bags of
    SHINGLE-word shingles (a shorter text is one shingle). Rows with one text are one node and always in one class, so are all texts without words,
    null and empty ones among them. class_id is the least doc_id of a class (null only where all are), kept marks one row of
    each class: least doc_id, nulls last, then least text_md5; of rows that repeat both, one. An empty table gives no rows; further columns are left out.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    first, path1 = stored(sign(plain.select("doc_id", F.monotonically_increasing_id().alias("uid"), text_digest(F.col("text")).alias("digest"), "text")), "signed")
    # Rows with one text are one node, the least uid among them; texts without words too.
    node = F.when(F.col("n_shingles") == 0, F.lit("")).otherwise(F.col("digest"))
    rows = first.withColumn("node", node)
    nodes, _ = stored(rows.groupBy("node").agg(F.min("uid").alias("uid")), "nodes")
    signed = rows.where("n_shingles > 0").join(nodes.select("uid"), "uid")
    signed, path2 = stored(signed.select("uid", "doc_id", "digest", "keys"), "units")
    banded = signed.select("uid", F.explode("keys").alias("key"))
    # Written first, as are the classes below: a join of two plain exchanges can be split where one key has very many rows.
    shared, path5 = stored(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members, path3 = stored(banded.join(shared, "key").select("key", "uid"), "members")
    wanted = members.select("uid").distinct().join(signed.select("uid", "doc_id", "digest"), "uid").select("uid", F.col("doc_id").alias("w_id"), F.col("digest").alias("w_digest"))
    texts = plain.withColumn("digest", text_digest(F.col("text")))
    # Joined on the id too, so that the rows of a group of copies go to many tasks; only one of them is wanted.
    texts = texts.join(wanted, (F.col("digest") == F.col("w_digest")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("uid", "text")
    sets, path4 = stored(bag_sets(texts).dropDuplicates(["uid"]), "bags")
    labels, label_path = stored(members.select("uid").distinct().withColumn("comp", F.col("uid")), "labels")
    edges = None
    for turn in range(LEADER_ROUNDS + 1):
        found = residual_links(members, labels, sets) if turn == LEADER_ROUNDS else verified(leader_pairs(members, labels, turn == 0), sets)
        found, _ = stored(found, "links")
        edges = found if edges is None else edges.unionByName(found)
        grown, new_path = components(edges, "near")
        joined = members.select("uid").distinct().join(grown, "uid", "left").select("uid", F.coalesce("comp", "uid").alias("comp"))
        labels, old = stored(joined, "labels")[0], label_path
        drop_path(docs.sparkSession, old)
        label_path = new_path
    for path in (path2, path3, path4, path5):
        drop_path(docs.sparkSession, path)
    comps = nodes.join(labels, "uid", "left").select("node", F.coalesce("comp", "uid").alias("comp"))
    placed, _ = stored(rows.select("doc_id", "digest", "uid", "node").join(comps, "node").select("doc_id", F.col("digest").alias("text_md5"), "uid", "comp"), "placed")
    drop_path(docs.sparkSession, path1)
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_md5", "uid")
    classes = placed.groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("class_size"))
    classes, _ = stored(classes.select("comp", F.col("best.doc_id").alias("class_id"), F.col("best.uid").alias("best_uid"), "class_size"), "classes")
    return placed.join(classes, "comp").select("doc_id", "text_md5", "class_id", "class_size", (F.col("uid") == F.col("best_uid")).alias("kept"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``near_duplicates``, with all columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # own names: a column of docs may have any
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    keep = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_md5").alias("k_md5"))
    rows = docs.toDF(*names).withColumn("d", text_digest(F.col(at[text_col]))).withColumn("i", F.col(at[id_col]).cast("bigint"))
    rows = rows.join(keep, (F.col("d") == F.col("k_md5")) & F.col("i").eqNullSafe(F.col("k_id")), "left_semi").dropDuplicates(["d", "i"])
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
