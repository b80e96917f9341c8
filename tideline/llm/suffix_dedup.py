"""Removal of repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A text is a sequence of symbols, its bytes or its words. A passage of ``least`` symbols is named by its anchor, the string of
``gram`` symbols in it with the least digest: equal passages have equal anchors at equal places. The occurrences of an
anchor, ordered by what follows, are the anchor's interval in a suffix array of the corpus; with the symbols before them they
are that part of its Burrows-Wheeler transform. All intervals are extended backwards breadth-first, a symbol at a time: where
each symbol's rows begin in its interval, and their rank there, give the rows of the longer strings. Common prefixes
come by increasing value: first those of what follows, found symbol by symbol, then, at every extension, one more than
the least of the rows between. Extension stops as soon as ``least`` can be reached no more, and where an occurrence is
alone in its interval.

Only the occurrences of anchors found in two contexts or more enter, once for each distinct context; an anchor whose
contexts are all equal repeats throughout. An interval too large for one task is split by how far the passages
reach before the anchor: those that reach far share much of what precedes, the others of what follows, so each half falls into
intervals of longer strings, which are extended, or split again, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_path, row_keys, stored, table
from .worker import serves


class Passage(NamedTuple):
    """What counts as repeated: strings of ``least`` symbols, which are the text's bytes or its words; ``gram`` of them name one."""

    least: int = 400
    gram: int = 32
    words: bool = False

    @property
    def width(self) -> int:
        """Bytes that a symbol takes in what is stored of a context."""
        return 8 if self.words else 1


BYTES, WORDS = Passage(), Passage(50, 8, True)
#: Intervals of more rows than this are split before they are gathered.
HOT = 20_000
#: Bytes, or symbols, worked on at once.
CHUNK = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place."""
    for shift in (32, 29):
        x ^= x >> np.uint64(shift)
        x *= _M
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Digests of all strings of symbols: sums of (symbol + 1) * odd ** place modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        inverse = pow(base, -1, 1 << 64)
        up, self.down = np.full(len(data), base, np.uint64), np.full(len(data) + 1, inverse, np.uint64)
        up[:1] = self.down[:1] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(self.down, out=self.down)
        up *= data.astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(up, out=self.sums[1:])

    def fixed(self, n: int) -> np.ndarray:
        """Digests of the substrings of length n at every place."""
        out = self.sums[n:] - self.sums[:-n]
        out *= self.down[: len(out)]
        return mix(out)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values)
    blocks = np.append(values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to) of the words of texts laid end to end, and how many words stand before each of ``bounds``; no word crosses one."""
    ink = ~_SPACE[data]
    opens, shuts = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1]
    shuts[:-1] &= ~ink[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    opens[inner] = ink[inner]
    shuts[inner - 1] = ink[inner - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return begin, end, np.searchsorted(begin, bounds)


def symbols(data: np.ndarray, bounds: np.ndarray, kind: Passage) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts laid end to end, bytes or digests of words, and their bounds."""
    if not kind.words:
        return data, bounds
    begin, end, at = words_of(data, bounds)
    out = np.zeros(len(begin), np.uint64)
    k = 0
    while k < len(begin):  # some CHUNK bytes at a time, so that a long text takes no more memory than several short ones
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + CHUNK, "right")))
        low, high = begin[k], end[stop - 1]
        with np.errstate(over="ignore"):
            out[k:stop] = Rolling(data[low:high], 0x9FB21C651E98DF25).of(begin[k:stop] - low, end[k:stop] - low)
        k = stop
    return out, at


def anchors(data: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, digest, place, first, last, context) of the anchors of texts laid end to end, as symbols; bounds has where each begins, and the end.

    An anchor names the passages that begin at first to last: those in which nothing lies below its digest and no equal gram to
    its right, so every passage has one anchor. context is a digest of all symbols of these passages and of the anchor's place in them.
    """
    width = least - gram + 1
    sizes = np.diff(bounds)
    passages = np.maximum(sizes - least + 1, 0)
    if not passages.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    with np.errstate(over="ignore"):
        rolling = Rolling(data, 0x5851F42D4C957F2D)
        digests = rolling.fixed(gram)
        lows = least_in_windows(digests, width)
        # The least digest of a passage lies at a place where the greatest of the lows around is the place's own digest.
        around = np.zeros(len(digests) + width - 1, np.uint64)
        around[width - 1 : width - 1 + len(lows)] = lows
        places = np.flatnonzero(~least_in_windows(~around, width) == digests)
        # Runs of passages of one text with one least digest.
        valid = np.zeros(len(lows) + 1, np.int8)
        own = passages > 0
        begin = bounds[:-1][own]
        np.add.at(valid, begin, 1)
        np.add.at(valid, begin + passages[own], -1)
        inside = np.cumsum(valid[:-1]) > 0
        new = np.append(True, lows[1:] != lows[:-1])
        new[begin] = True
        edge = new.copy()
        edge[1:] |= inside[1:] != inside[:-1]
        starts = np.flatnonzero(edge)
        stops = np.append(starts[1:], len(lows))
        starts, stops = starts[inside[starts]], stops[inside[starts]]
        # In a run, each place of its digest holds until the next one enters.
        key = np.lexsort((places, digests[places]))
        places = places[key]
        sorted_digests = digests[places]
        left, right = (np.searchsorted(sorted_digests, lows[starts], side) for side in ("left", "right"))
        # Only places from the run's start to the end of its last passage matter.
        n = right - left
        run = np.repeat(np.arange(len(starts)), n)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + left[run]
        place = places[at]
        after = np.where(at + 1 < right[run], places[np.minimum(at + 1, len(places) - 1)], np.iinfo(np.int64).max)
        first = np.maximum(place - width + 1, starts[run])
        last = np.minimum(np.minimum(place, stops[run] - 1), after - width)
        ok = first <= last
        digest, place, first, last = lows[starts][run][ok], place[ok], first[ok], last[ok]
        text = np.searchsorted(bounds, first, "right") - 1
        context = mix(rolling.of(first, last + least) + (place - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    base = bounds[text]
    return text, digest.view(np.int64), place - base, first - base, last - base, context.view(np.int64)


def _matrix(parts: list[bytes], width: int, most: int) -> np.ndarray:
    """Symbols of ``parts``, a row each, filled up with zeros."""
    size = most * width
    pad = bytes(size)
    return np.frombuffer(b"".join([(x + pad)[:size] for x in parts]), "<u8" if width == 8 else np.uint8).reshape(len(parts), most)


def expand(group: np.ndarray, before: list[bytes], after: list[bytes], span: np.ndarray, copies: np.ndarray, kind: Passage) -> np.ndarray:
    """Which passages around each occurrence of an anchor are repeated: (occurrence, symbols before the anchor) as a boolean matrix.

    group names the anchor, before (its last symbol last) and after are the symbols around it, span + 1 the passages that it names
    (the longest extension is all of before), copies how often the same context occurs. Occurrences with copies are repeated throughout.
    """
    m, width = len(group), kind.width
    most = kind.least - kind.gram
    hits = np.zeros((m, most + 1), bool)
    amax = np.fromiter(map(len, before), np.int64, m) // width
    amin = amax - span
    rlen = np.fromiter(map(len, after), np.int64, m) // width
    for r in np.flatnonzero(copies > 1):
        hits[r, amin[r] : amax[r] + 1] = True
    rights = _matrix(after, width, most)
    if width == 1:
        lefts = _matrix([x[::-1] for x in before], 1, most)  # the symbol before the anchor first
        coded, sigma = rights, 256
    else:
        lefts = _matrix([np.frombuffer(x, "<u8")[::-1].tobytes() for x in before], width, most)
        known, code = np.unique(np.stack([rights, lefts]), return_inverse=True)
        rights, lefts = code.reshape(2, m, most).astype(np.int32)
        coded, sigma = rights.astype(">u4"), len(known)
    size = most * coded.dtype.itemsize
    key = np.empty((m, size + 4), np.uint8)
    key[:, :4] = np.unique(group, return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(m, 4)
    key[:, 4:] = np.ascontiguousarray(coded).view(np.uint8).reshape(m, size)
    rows = np.argsort(key.view(f"S{size + 4}").ravel(), kind="stable")  # the suffix array's order
    # Common prefixes of what follows, of neighbours in one interval, by increasing value.
    inner = np.append(False, group[rows[1:]] == group[rows[:-1]])
    lcp = np.where(inner, most, -1)
    rest = np.flatnonzero(inner)
    stop = np.minimum(rlen[rows[rest]], rlen[rows[rest - 1]])
    for n, column in enumerate(np.ascontiguousarray(rights.T)):
        if not len(rest):
            break
        parted = (column[rows[rest]] != column[rows[rest - 1]]) | (stop <= n)
        lcp[rest[parted]] = n
        rest, stop = rest[~parted], stop[~parted]
    for a, column in enumerate([*np.ascontiguousarray(lefts.T), None]):
        best = lcp.copy()
        best[:-1] = np.maximum(best[:-1], np.where(inner[1:], lcp[1:], -1))
        hit = (best >= most - a) & (amin[rows] <= a)
        hits[rows[hit], a] = True
        # Rows stay whose left side goes on, and that could still reach the least length.
        kept = np.flatnonzero((amax[rows] > a) & (amax[rows] + best >= most))
        if not len(kept):
            break
        # They go to where their symbol's rows begin in the interval, plus their rank among these.
        interval = np.cumsum(~inner)[kept]
        symbol = column[rows[kept]].astype(np.int64)
        order = np.argsort(interval * sigma + symbol, kind="stable")
        old = kept[order]
        inner = np.append(False, (interval[order[1:]] == interval[order[:-1]]) & (symbol[order[1:]] == symbol[order[:-1]]))
        # The common prefix of new neighbours is the least of those between them, and the symbol put before it.
        near = old[1:] == old[:-1] + 1
        low = np.full(len(old), -1)
        low[1:][near] = lcp[old[1:][near]]
        far = np.flatnonzero(inner[1:] & ~near) + 1
        if len(far):
            low[far] = np.minimum.reduceat(np.append(lcp, most), np.stack([old[far - 1] + 1, old[far] + 1], 1).ravel())[::2]
        lcp = np.where(inner, low, -1)
        rows = rows[kept][order]
        among = inner | np.append(inner[1:], False)  # others are alone in their interval
        if not among.all():
            rows, inner, lcp = rows[among], inner[among], lcp[among]
        if not len(rows):
            break
    return hits


def _large(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def _buffers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column of some CHUNK bytes: (from, to, bytes, bounds); nulls are empty."""
    column = _large(pa.compute.fill_null(column, ""))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


_ANCHOR = "k1 bigint, k2 bigint, digest bigint, place int, first int, last int, context bigint"


def _find(kind: Passage):
    @serves("suffix dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, bounds in _buffers(batch.column(2)):
                sequence, at = symbols(data, bounds, kind)
                # Of a long text, the passages that begin in some CHUNK symbols at a time.
                long = len(at) == 2 and len(sequence) > CHUNK + kind.least
                for low in range(0, len(sequence) - kind.least + 1, CHUNK) if long else (0,):
                    part = sequence[low : low + CHUNK + kind.least - 1] if long else sequence
                    text, digest, place, first, last, context = anchors(part, np.array([0, len(part)]) if long else at, kind.least, kind.gram)
                    rows = pa.array(text + begin)
                    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(digest), *(pa.array((x + low).astype(np.int32)) for x in (place, first, last)), pa.array(context)]
                    yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "digest", "place", "first", "last", "context"])

    return partition


_CONTEXT = "digest bigint, context bigint, copies bigint, n bigint, place int, span int, bytes binary"


def _cut_contexts(kind: Passage):
    """Rows (text, wanted: list of anchors) to the symbols of each wanted anchor's passages."""

    @serves("suffix dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in _buffers(batch.column(0)):
                sequence, at = symbols(data, bounds, kind)
                raw, width = memoryview(np.ascontiguousarray(sequence)).cast("B"), kind.width
                wanted = batch.column(1).slice(begin, end - begin)
                counts = np.diff(wanted.offsets.to_numpy())
                flat = wanted.flatten()
                for k in range(0, len(flat), 4096):
                    digest, context, copies, place, first, last, contexts = (flat.slice(k, 4096).field(i) for i in range(7))
                    base = np.repeat(at[:-1], counts)[k : k + 4096]
                    f = first.to_numpy().astype(np.int64)
                    size = last.to_numpy() - f + kind.least
                    cut = [bytes(raw[a:b]) for a, b in zip(((base + f) * width).tolist(), ((base + f + size) * width).tolist(), strict=True)]
                    columns = [digest, context, copies, contexts, pa.array((place.to_numpy() - f).astype(np.int32)), pa.array((size - kind.least).astype(np.int32)), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "context", "copies", "n", "place", "span", "bytes"])

    return partition


_PIECE = ["digest", "context", "copies", "place", "span", "bytes", "piece", "shift", "low", "high"]


def _halves(pieces: DataFrame, kind: Passage) -> DataFrame:
    """Contexts, each cut to the passages that reach low to the middle and those that reach further to high symbols before the anchor.

    Equal passages of one half have their first low and last least - gram - high symbols around the anchor in common: they name the new piece.
    """
    size = lambda n: n * kind.width
    middle = F.expr("(low + high) div 2").cast("int")
    ranges = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
    rows = pieces.select("digest", "context", "copies", "place", "span", "shift", "bytes", F.explode(ranges).alias("r")).select("*", "r.low", "r.high")
    rows = rows.withColumns({"fewest": F.greatest(F.col("place") - F.col("span"), "low"), "most": F.least("place", "high")}).where("fewest <= most")
    fewest, most, skipped = F.col("fewest"), F.col("most"), F.col("place") - F.col("most")
    rows = rows.select(
        "digest", "context", "copies", most.alias("place"), (most - fewest).alias("span"),
        F.substring("bytes", size(skipped) + 1, size(most - fewest + kind.least)).alias("bytes"),
        (F.col("shift") + skipped).alias("shift"), "low", "high",
    )
    common = F.substring("bytes", size(F.col("place") - F.col("low")) + 1, size(F.col("low") - F.col("high") + kind.least))
    return rows.withColumn("piece", F.xxhash64("digest", "low", "high", common)).select(*_PIECE)


def _extended(pieces: DataFrame, kind: Passage) -> DataFrame:
    """The repeated passages of contexts, a piece in a task."""
    rows = pieces.select("piece", "digest", "context", "copies", "place", "span", "shift", "bytes")
    return rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(_expanded(kind), _STARTS)


def _starts_of(cut: DataFrame, kind: Passage, hot: int) -> tuple[DataFrame, list[str]]:
    """(digest, context, starts) of contexts of anchors, and the tables that hold them; intervals of more than ``hot`` rows are split."""
    pieces = cut.select("*", F.col("digest").alias("piece"), F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(kind.least - kind.gram).alias("high"))
    out, path = stored(_extended(pieces.where(F.col("n") <= hot), kind), "starts")
    paths, before = [path], []
    large = pieces.where(F.col("n") > hot)
    if large.isEmpty():
        return out, paths
    # A context that occurs twice repeats throughout, whatever piece it comes to.
    whole = large.where("copies > 1").select("digest", "context", F.array(F.struct(F.lit(0).alias("lo"), F.col("span").alias("hi"))).alias("starts"))
    known, path = stored(whole, "starts")
    out, large = out.unionByName(known), large.dropDuplicates(["digest", "context"])
    paths.append(path)
    while True:  # the range is halved each time
        split, path0 = stored(_halves(large, kind), "halves")
        sizes, path1 = stored(split.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        sized, path2 = stored(split.join(sizes, "piece"), "pieces")
        for path in (path0, path1, *before):
            drop_path(split.sparkSession, path)
        before = [path2]
        # Where the range is one symbol's, the piece is the passage itself.
        one = sized.where("low = high").select("digest", "context", F.array(F.struct(F.col("shift").alias("lo"), F.col("shift").alias("hi"))).alias("starts"))
        found, path = stored(_extended(sized.where("low < high").where(F.col("n") <= hot), kind).unionByName(one), "starts")
        out = out.unionByName(found)
        paths.append(path)
        large = sized.where("low < high").where(F.col("n") > hot)
        if large.isEmpty():
            drop_path(split.sparkSession, path2)
            return out, paths


_STARTS = "digest bigint, context bigint, starts array<struct<lo:int,hi:int>>"
_RANGE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _expanded(kind: Passage):
    """Contexts sorted by piece to the passages in them that are repeated, as ranges of starts from the first passage on.

    A piece holds all passages of an anchor, or those of its contexts that share what names the piece; shift passages of a context stand before its own.
    """

    def work(rows: pa.Table) -> pa.RecordBatch:
        # A context comes once, but for texts whose row is repeated.
        _, once = np.unique(np.stack([rows.column(c).to_numpy() for c in ("piece", "digest", "context")]), axis=1, return_index=True)
        rows = rows.take(pa.array(once))
        piece, digest, context = (rows.column(c).to_numpy() for c in ("piece", "digest", "context"))
        copies, place, span, shift = (rows.column(c).to_numpy().astype(np.int64) for c in ("copies", "place", "span", "shift"))
        data = rows.column("bytes").to_pylist()
        at = place.tolist()
        width, gram = kind.width, kind.gram
        hits = expand(piece, [b[: p * width] for b, p in zip(data, at, strict=True)], [b[(p + gram) * width :] for b, p in zip(data, at, strict=True)], span, copies, kind)
        edge = np.diff(hits.astype(np.int8), axis=1, prepend=0, append=0)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        keep = np.flatnonzero(np.bincount(row, minlength=len(digest)))
        offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(digest))[keep])).astype(np.int32)
        first = place[row] + shift[row]
        lo, hi = first - (end - 1), first - begin
        ranges = pa.StructArray.from_arrays([pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["lo", "hi"])
        return pa.RecordBatch.from_arrays([pa.array(digest[keep]), pa.array(context[keep]), pa.ListArray.from_arrays(pa.array(offsets), ranges)], names=["digest", "context", "starts"])

    @serves("suffix dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HOT:
                rows = pa.Table.from_batches(held)
                piece = rows.column("piece").to_numpy()
                edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
                if len(edges):
                    yield work(rows.slice(0, int(edges[-1])))
                    held = rows.slice(int(edges[-1])).combine_chunks().to_batches()
                    n = sum(map(len, held))
        if n:
            yield work(pa.Table.from_batches(held))

    return partition


_RUNS = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))


def _runs(data: bytes, spans: list[dict] | None, kind: Passage) -> list[dict]:
    """Spans of symbols, in any order, to maximal runs as places of bytes."""
    runs: list[list[int]] = []
    for f, t in sorted((x["f"], x["t"]) for x in spans or ()):
        if runs and f <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], t)
        else:
            runs.append([f, t])
    if kind.words and runs:
        begin, end, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        runs = [[int(begin[f]), int(end[t - 1])] for f, t in runs]
    return [{"f": f, "t": t} for f, t in runs]


def _cutter(text_at: int, taken: list[tuple[int, Passage]], as_text: bool):
    """Rows with a text and lists of spans: the runs of each list in its place, and what is left of the text without the first list's."""

    @serves("suffix dedup")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = _large(pa.compute.fill_null(part.column(text_at), "")).to_pylist()
                columns = dict(enumerate(part.columns))
                for i, kind in taken:
                    columns[i] = pa.array([_runs(data, spans, kind) for data, spans in zip(texts, part.column(i).to_pylist(), strict=True)], _RUNS)
                kept = []
                for data, runs in zip(texts, columns[taken[0][0]].to_pylist(), strict=True):
                    edges = [0, *(x for r in runs for x in (r["f"], r["t"])), len(data)]
                    left = b"".join([data[f:t] for f, t in zip(edges[::2], edges[1::2], strict=True)])
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                columns[text_at] = pa.array(kept, pa.string() if as_text else pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=part.schema.names)

    return partition


def spans_of(keyed: DataFrame, text_col: str, kind: Passage, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans) of the rows of ``keyed`` (named by k1, k2) that have repeated passages: (f, t) in symbols, not merged."""
    spark, least = keyed.sparkSession, kind.least
    texts = keyed.select("k1", "k2", F.col(text_col).alias("text"))
    found, path1 = stored(texts.mapInArrow(_find(kind), _ANCHOR), "anchors")
    # Written first: a join of two plain exchanges can be split where one digest has very many rows.
    often, path0 = stored(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "often")
    repeated, path2 = stored(found.join(often, "digest"), "repeated")
    drop_path(spark, path0)
    drop_path(spark, path1)
    one = F.min(F.struct("k1", "k2", "place", "first", "last")).alias("one")
    grouped, path0 = stored(repeated.groupBy("digest", "context").agg(F.count("*").alias("copies"), one), "grouped")
    sizes, path1 = stored(grouped.groupBy("digest").agg(F.count("*").alias("n")), "sizes")
    contexts, path3 = stored(grouped.join(sizes, "digest").select("digest", "context", "copies", "n", "one.*"), "contexts")
    drop_path(spark, path0)
    drop_path(spark, path1)
    # The only context of an anchor stands in two places or more, so all its passages are repeated.
    whole = contexts.where("n = 1").select("digest", "context", F.array(F.struct(F.lit(0).alias("lo"), (F.col("last") - F.col("first")).alias("hi"))).alias("starts"))
    wanted = contexts.where("n > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("digest", "context", "copies", "place", "first", "last", "n")).alias("wanted"))
    cut, path4 = stored(texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_cut_contexts(kind), _CONTEXT), "cut")
    found, held = _starts_of(cut, kind, hot)
    drop_path(spark, path4)
    starts = found.unionByName(whole)
    spans = repeated.join(starts, ["digest", "context"]).select("k1", "k2", "first", F.explode("starts").alias("s"))
    spans = spans.select("k1", "k2", F.struct((F.col("first") + F.col("s.lo")).alias("f"), (F.col("first") + F.col("s.hi") + least).alias("t")).alias("span"))
    spans, _ = stored(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "spans")
    for path in (path2, path3, *held):
        drop_path(spark, path)
    return spans


def remove_repeats(docs: DataFrame, text_col: str = "text", kind: Passage = BYTES, mark: dict[str, Passage] | None = None, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """``docs`` with kept (binary) and removed (array of (f, t), bytes from f to before t, maximal runs) in place of the text.

    With ``as_text`` kept is a string; bytes of characters that a cut has split are left out of it. ``mark`` names further
    columns like removed, of passages of other kinds, which are found but not cut out.

    Every byte is removed that lies in a string of ``kind.least`` symbols (bytes of the text as UTF-8, or words between ASCII white
    space with what parts them) that begins anywhere else too, in the same text
    or another; strings do not cross texts and are judged on the input. Overlapping occurrences count. A null text is empty; texts shorter
    than that stay whole; of equal texts nothing is left that is long enough. Repeated rows count as texts of their own. An empty
    table gives no rows. Columns named kept, removed or as in ``mark`` are replaced, all others pass through.
    """
    kinds = {"removed": kind, **(mark or {})}
    docs = docs.drop("kept", *kinds)
    names = [f"c{i}" for i, c in enumerate(docs.columns)]  # own names: a column of docs may have any
    text = names[docs.columns.index(text_col)]
    plain = docs.toDF(*names)
    # Rows are named by all of their content, so that only equal rows share a name.
    rows = keyed = plain.select(*row_keys(*(F.col(n) for n in names)), "*")
    for i, own in enumerate(kinds.values()):
        rows = rows.join(spans_of(keyed, text, own, hot).withColumnRenamed("spans", f"s{i}"), ["k1", "k2"], "left")
    rows = rows.select(*names, *(f"s{i}" for i in range(len(kinds))))
    runs = T.ArrayType(T.StructType([T.StructField("f", T.IntegerType()), T.StructField("t", T.IntegerType())]))
    schema = T.StructType([T.StructField(f.name, T.StringType() if as_text else T.BinaryType()) if f.name == text else f for f in plain.schema])
    schema = T.StructType([*schema, *(T.StructField(f"s{i}", runs) for i in range(len(kinds)))])
    cut = rows.mapInArrow(_cutter(names.index(text), [(len(names) + i, own) for i, own in enumerate(kinds.values())], as_text), schema)
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if n != text]
    return cut.select(*back, F.col(text).alias("kept"), *(F.col(f"s{i}").alias(c) for i, c in enumerate(kinds)))


def covered(runs: str) -> Column:
    """Bytes in a column of runs."""
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["t"] - r["f"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns follow 400 bytes; n_passages and passage_bytes tell of runs of 50 words or more that stand elsewhere too, which may be shorter."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), mark={"passages": WORDS})
    return cut.select(
        "doc_id",
        (F.octet_length("kept") + covered("removed")).cast("bigint").alias("n_bytes"),
        covered("removed").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("bigint").alias("n_passages"),
        covered("passages").alias("passage_bytes"),
    )
