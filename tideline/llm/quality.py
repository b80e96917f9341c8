"""Quality rules: words and lines, then bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import text_chunks

#: Allowed ratios (bytes to compressed bytes, level 3) by length: from this many bytes on, least and most. Short texts
#: compress badly whatever they hold and have no least ratio. Prose lies well inside each band; encoded or random data
#: lies below, repeated words, lines or templates lie above.
BANDS = (
    (0, 0.0, 2.0),
    (128, 0.0, 2.4),
    (256, 1.02, 2.6),
    (512, 1.15, 3.0),
    (1024, 1.3, 3.3),
    (2048, 1.4, 3.6),
    (4096, 1.45, 4.0),
    (16384, 1.5, 4.6),
    (65536, 1.5, 5.2),
)
#: Chunks of this many bytes and the rest after the last of them are judged one by one, each by the band of its own length; a document
#: goes when more than this share of them is outside its band.
CHUNK_BYTES, BAD_CHUNKS = 4096, 0.3
#: Base rules: fewest words, and most words (per cent) in 5-word windows found more than once.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5

_SPACE = re.compile("[\x20\x09-\x0d]")
_SYMBOLS = b"#*$%&|<>"
_STARTS = [b[0] for b in BANDS]
_COLUMNS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("verdict", pa.string()),
]
_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, verdict string"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + window - max(reach, i)
            reach = i + window
    return total


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    full = [x for x in lines if x.split()]
    return len(full) - len(set(full))


def outside(ratio: float, n_bytes: int) -> str | None:
    """Why a ratio is outside its band, if it is."""
    _, least, most = BANDS[bisect_right(_STARTS, n_bytes) - 1]
    return "incompressible" if ratio < least else "repetitive" if ratio > most else None


def compression_verdict(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, str]:
    """Whole ratio, chunks with the shorter last one, chunks outside their band, and the verdict: ok, incompressible, repetitive or chunks."""
    if not data:
        return 0.0, 0, 0, "ok"
    ratio = len(data) / len(compressor.compress(data))
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    n, bad = len(chunks), sum(outside(len(c) / len(compressor.compress(c)), len(c)) is not None for c in chunks)
    return ratio, n, bad, outside(ratio, len(data)) or ("chunks" if bad > BAD_CHUNKS * n else "ok")


def judged(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    data = text.encode()
    words = data.split()  # of bytes: splits at \x20 and \x09-\x0d only
    n, repeat = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED * n
    ratio, chunks, bad, verdict = compression_verdict(data, compressor)
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    return n, chars, symbols, duplicate_lines(data), repeat, failed, not failed and verdict == "ok", ratio, chunks, bad, verdict


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its counts, base_failed, kept, and what the compression bands saw.

    A null or empty text has no words and fails. Repeated rows, equal or null ids are judged one by one; an empty table
    gives no rows; further columns are left out. The work on a text is linear in its length.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                rows = [judged(t, compressor) for t in texts]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(n for n, _ in _COLUMNS)])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(partition, _SCHEMA)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
