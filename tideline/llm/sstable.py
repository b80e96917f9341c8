"""Sorted-string-table shards of token ids, keyed by document.

A shard: data blocks (entries in key order with prefix-compressed keys, zstandard, CRC-32), a sparse index with
each block's last key, a Bloom filter over the keys, and a footer. A lookup reads the footer, asks the filter,
finds the block by binary search in the index and the entry by binary search over the block's restart points.

    block   entry* restart:u32* n_restarts:u32, compressed, then crc32:u32 of the compressed bytes
    entry   shared:varint unshared:varint value_bytes:varint key_suffix value
    key     empty for a null id, else 8 bytes, big-endian, sign bit flipped; equal keys stand side by side
    value   ids as little-endian integers of the width that the footer names
    footer  index_at, index_bytes, filter_at, filter_bytes, n_docs, n_ids: u64; id_width, n_hashes: u32; magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, table
from .tokens import encoder, text_chunks, vocabulary
from .worker import serves

MAGIC, FOOTER = b"TLSST001", struct.Struct("<6Q2I8s")
BLOCK_BYTES, RESTART_EVERY, BITS_PER_KEY, N_HASHES = 64 << 10, 16, 10, 7
#: Estimated input bytes a shard.
SHARD_BYTES = 32 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_bits(keys: np.ndarray, n_bits: int, n_hashes: int) -> np.ndarray:
    """Positions in the filter, (keys, hashes), by double hashing; keys as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        step = h * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        return (h[:, None] + np.arange(n_hashes, dtype=np.uint64) * step[:, None]) % np.uint64(n_bits)


def bloom_key(key: bytes) -> int:
    return int.from_bytes(key, "big") if key else 2**64 - 1


class ShardWriter:
    """Writes entries that come in key order to an open stream."""

    def __init__(self, out, id_width: int) -> None:
        self.out, self.id_width, self.at = out, id_width, 0
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []
        self.n_ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must come in order")
        shared = 0
        if self.count % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.keys.append(bloom_key(key))
        self.n_ids += len(value) // self.id_width
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = self.pack.compress(raw)
            self.out.write(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append((self.last, self.at, len(data) + 4))
            self.at += len(data) + 4
            self.block, self.restarts, self.count = bytearray(), [], 0

    def close(self) -> None:
        self.end_block()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = np.zeros(max(64, len(self.keys) * BITS_PER_KEY + 7 & ~7), np.uint8)
        bits[bloom_bits(np.array(self.keys, np.uint64), len(bits), N_HASHES).ravel()] = 1
        filter_ = np.packbits(bits).tobytes()
        self.out.write(index + filter_ + FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_), len(self.keys), self.n_ids, self.id_width, N_HASHES, MAGIC))


class Shard:
    """A shard opened for reading, from any file that can be read at a position."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        self.index_at, n, self.filter_at, self.filter_bytes, self.n_docs, self.n_ids, self.id_width, self.n_hashes, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at, self.index = file.read_at(n, self.index_at), 0, []
        while at < n:
            k, at = read_varint(data, at)
            key, at = data[at : at + k], at + k
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, offset, length))
        self.filter = None

    def block(self, i: int) -> bytes:
        _, at, n = self.index[i]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("damaged block")
        return zstandard.ZstdDecompressor().decompress(data[:-4])

    @staticmethod
    def entries(raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end, key = len(raw) - 4 * (int.from_bytes(raw[-4:], "little") + 1), b""
        while at < end:
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            yield key, raw[at + more : at + more + n]
            at += more + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.entries(self.block(i))

    def may_hold(self, key: bytes) -> bool:
        if self.filter is None:
            self.filter = np.unpackbits(np.frombuffer(self.file.read_at(self.filter_bytes, self.filter_at), np.uint8))
        return bool(self.filter[bloom_bits(np.array([bloom_key(key)], np.uint64), len(self.filter), self.n_hashes)].all())

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, several if it was written more than once."""
        found: list[bytes] = []
        if not self.may_hold(key):
            return found
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            raw = self.block(i)
            n = int.from_bytes(raw[-4:], "little")
            restarts = struct.unpack(f"<{n}I", raw[-4 - 4 * n : -4])
            at = max(0, bisect_left(restarts, key, key=lambda p, raw=raw: next(self.entries(raw, p))[0]) - 1)
            for k, v in self.entries(raw, restarts[at]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def _shards(docs: DataFrame) -> int:
    """Shards for the plan's own estimate of its input; no job is run for it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1_000_000, max(8, -(-size // SHARD_BYTES))) if size < 1 << 60 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_shards(docs: DataFrame, path: str, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[str, int, int]]:
    """Encodes every document, appends ``end_id`` and writes the shards; (file, documents, ids) of each in key order.

    Documents go in ascending id order, nulls first, rows with one id by a digest of their texts. A null or empty text
    has the end id alone. An empty table gives no shard. Further columns are left out. A task writes
    under a name of its own and moves the file when it is whole, so a task that is run again does no harm.
    """

    @serves("sorted shards")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, own = encoder(vocab), TaskContext.get().partitionId()
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, tmp = f"{root}/shard-{own:07d}.sst", f"{root}/.{own}-{uuid.uuid4().hex}"
        writer = None
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                if writer is None:
                    stream = store.open_output_stream(tmp)
                    writer = ShardWriter(stream, width)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    writer.add(key_of(doc_id), np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"file": [f"shard-{own:07d}.sst"], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]})

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col), F.xxhash64(text_col).alias("tie"))
    ranged = plain.repartitionByRange(shards or _shards(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    made = ranged.mapInArrow(write, "file string, n_docs bigint, n_ids bigint").collect()  # a row a shard
    return sorted((r.file, r.n_docs, r.n_ids) for r in made)


def read_shards(spark: SparkSession, path: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit)."""
    places, before = [], 0
    for file, _, n_ids in shards:
        places.append((file, before))
        before += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    shard = Shard(f)
                    for i in range(len(shard.index)):
                        rows = []
                        for key, value in shard.entries(shard.block(i)):
                            ids = np.frombuffer(value, f"<u{shard.id_width}").astype("<u4")
                            rows.append((id_of(key), start, len(ids), ids.tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame(places, "file string, start bigint").repartition(max(1, len(places)))
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op7_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    shards = write_shards(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), 0)
    return read_shards(spark, path, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
