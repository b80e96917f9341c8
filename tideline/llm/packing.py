"""Packing of token ids into windows of fixed length, with a bounded number of open windows.

Each partition keeps ``open_windows`` windows. A document's rest goes where it leaves the least
room; when it fits nowhere and no window may be opened, the fullest is topped up with the
document's head and emitted. What stays open at the end of the partitions is merged.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table
from .tokens import encoder, text_chunks, vocabulary
from .worker import serves

#: Partitions whose open windows are merged in one task: at most 64 x 32 windows of 4096 ids, 34 MB.
MERGED_PARTITIONS, OPEN_WINDOWS = 64, 32
_MERGED_IDS = 1 << 60
_PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, first_id: int) -> None:
        self.size, self.most, self.next_id = size, most, first_id
        self.open: list[tuple[int, int]] = []  # (room, window), the fullest first
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def window(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def emit(self, window: int, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((*p, window, offset))
            offset += p[2]

    def place(self, doc_id: int | None, ids: bytes) -> None:
        n, start = len(ids) // 4, 0

        def cut(length: int) -> tuple:
            return doc_id, start, length, ids[4 * start : 4 * (start + length)], n

        while n - start >= self.size:
            self.emit(self.window(), [cut(self.size)])
            start += self.size
        while left := n - start:
            at = bisect_left(self.open, (left, -1))
            if at < len(self.open):
                room, window = self.open.pop(at)
            elif len(self.open) < self.most:
                room, window = self.size, self.window()
                self.held[window] = []
            else:
                room, window = self.open.pop(0)
            piece = cut(min(left, room))
            self.held[window].append(piece)
            start += piece[2]
            if room > piece[2]:
                insort(self.open, (room - piece[2], window))
            else:
                self.emit(window, self.held.pop(window))

    def flush(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def merged(pieces: list[tuple], size: int, first_id: int) -> list[tuple]:
    """Pieces laid end to end in full windows; the last, shorter rest in windows of powers of two, so that none is padded."""
    total, out, window, offset = sum(p[2] for p in pieces), [], first_id, 0
    room = size if total >= size else 1 << max(0, total.bit_length() - 1)
    for doc_id, start, length, ids, n in pieces:
        done = 0
        while done < length:
            k = min(length - done, room - offset)
            out.append((doc_id, start + done, k, ids[4 * done : 4 * (done + k)], n, window, offset))
            done, offset, total = done + k, offset + k, total - k
            if offset == room:
                window, offset = window + 1, 0
                room = size if total >= size else 1 << max(0, total.bit_length() - 1)
    return out


def _rows(pieces: list[tuple], more: tuple[str, ...] = (), values: tuple = ()) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) if pieces else [[]] * len(_ARROW)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays + [pa.array([v] * len(pieces), pa.int64()) for v in values], names=[*_ARROW.names, *more])


def pack(docs: DataFrame, vocab: str, end_id: int, size: int = 4096, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids, those of the file ``vocab`` and then ``end_id``, lie in pieces without gap or
    overlap; so do a sequence's pieces. Sequences hold ``size`` ids, but for the rests of the final merge, whose lengths are
    powers of two: nothing is padded. A null or empty text has the end id alone; documents with equal or null ids are packed
    one by one; an empty table gives no rows; further columns are left out.
    """

    @serves("packing")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, enc, end = TaskContext.get().partitionId(), encoder(vocab), end_id.to_bytes(4, "little")
        packer = Packer(size, open_windows, (own + 1) << 32)
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    packer.place(doc_id, ids + end)
                yield _rows(packer.flush(), ("left",), (None,))
        open_ = [(*p, w, 0) for w, ps in packer.held.items() for p in ps]
        yield _rows(open_, ("left",), (own // MERGED_PARTITIONS,))

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        pieces = sorted(zip(*(group.column(n).to_pylist() for n in ("sequence_id", *_ARROW.names[:5])), strict=True), key=lambda p: (p[0], p[1] is None, p[1] or 0, p[2]))
        rows = merged([p[1:] for p in pieces], size, _MERGED_IDS | (key[0].as_py() << 32))
        return pa.Table.from_batches([_rows(rows)])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col))
    first, _ = stored(plain.mapInArrow(partition, f"{_PIECE}, left bigint"), "packed")
    rest = first.where(F.col("left").isNotNull()).groupBy("left").applyInArrow(merge, _PIECE)
    return first.where(F.col("left").isNull()).drop("left").unionByName(rest)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
