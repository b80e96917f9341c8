"""Byte-pair encoding by traversal of a trie of distinct words, and decoding.

A prefix has one last token: the only one whose pair with the last token of the prefix before it
no merge would cross. New words go into a trie, a depth-first walk gives every node that token,
so what words share at their beginning is worked out once, and a word's ids are read back from its end.
"""

from __future__ import annotations

import gc
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import WordEncoder, text_chunks, vocabulary
from .worker import caches, serves

WORD_END = "</w>"
#: Longer words are walked alone, without nodes of their own.
LONG_WORD = 256
#: Words of texts that the library splits are remembered up to this number.
MOST_PIECES = 100_000


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where it can be printed, else one from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]) -> None:
        self.size = max(vocab.values()) + 1
        self.rank = [-1] * self.size  # of the merge that makes a token; -1 for single bytes
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.merged: dict[int, int] = {}  # of two tokens, the rank of their merge
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merged[i * self.size + j] = r
            self.rank[k], self.parts[k] = r, (i, j)
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.known: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at a token's left (0) or right (1) edge while it is made, each with the rank that ends it."""
        key = (token, side)
        if key not in self.edges:
            out, end = [], 1 << 60
            while True:
                out.append((token, end))
                if self.parts[token] is None:
                    break
                end, token = self.rank[token], self.parts[token][side]
            self.edges[key] = out
        return self.edges[key]

    def crossing(self, a: int, b: int) -> int | None:
        """The first merge that would join an edge of ``a`` with an edge of ``b``, if any."""
        first = None
        for x, x_end in self.edge(a, 1):
            for y, y_end in self.edge(b, 0):
                r = self.merged.get(x * self.size + y)
                # Of equal merges the left one comes first: it is past one in a, before one in b.
                if r is not None and r < x_end and r <= y_end and (first is None or r < first):
                    first = r
        return first

    def stand(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self.crossing(a, b) is None
        return found

    def reachable(self, token: int) -> bool:
        """Whether the token's own string is encoded as this token alone."""
        return self.parts[token] is None or self.crossing(*self.parts[token]) == self.rank[token]


class TrieEncoder(WordEncoder):
    """The ids of WordEncoder, with the words' ids found in a trie, and each word's decoded text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.kind != "word":
            raise ValueError("the vocabulary must mark word ends")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.to_chars = {b: c for b, c in byte_characters().items()}
        self.tokens = [""] * self.vocab_size
        for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = t
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(WORD_END) and self.merges.reachable(i)}
        self.final = {t[: -len(WORD_END)]: i for t, i in vocab.items() if t.endswith(WORD_END) and self.merges.reachable(i)}
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)
        self.width = [0] * self.vocab_size
        for t, i in [*self.inner.items(), *self.final.items()]:
            self.width[i] = len(t)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.vocab_size)]
        self.pieces: dict[str, tuple[bytes, str]] = {}  # of words that the library split, already as byte characters

    @staticmethod
    def _sizes(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By the last three characters (fewer at a word's start), the sizes of tokens that may end there, the largest first."""
        found: dict[str, set[int]] = defaultdict(set)
        for t in tokens:
            found[t[-3:]].add(len(t))
        out = {}
        for tail, own in found.items():
            shorter = {n for n in (1, 2) if n < len(tail) and tail[-n:] in tokens}
            out[tail] = tuple(sorted(own | shorter, reverse=True))
        return out

    @staticmethod
    def _short(tokens: dict[str, int], sizes: dict[str, tuple[int, ...]], tail: str) -> tuple[int, ...]:
        """Sizes for a tail that no longer token ends in; kept for the next time."""
        found = sizes[tail] = tuple(n for n in (3, 2, 1) if n <= len(tail) and tail[-n:] in tokens)
        return found

    def as_chars(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.to_chars)

    def walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of words given as byte characters."""
        # A trie has no cycles: its nodes go when the walk ends, and the collector would only trace them again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._walk(words)
        finally:
            if collecting:
                gc.enable()

    def _walk(self, words: Iterable[str]) -> dict[str, list[int]]:
        root: dict = {}
        out: dict[str, list[int]] = {}
        longest = 0
        for w in words:
            if len(w) > LONG_WORD:
                last = [-1] * len(w)
                for d in range(1, len(w)):
                    last[d] = self.last_inner(w, d, last)
                out[w] = self.read_back(w, last)
                continue
            node = root
            for c in w[:-1]:
                child = node.get(c)
                if child is None:
                    child = node[c] = (w, {})
                node = child[1]
            node.setdefault(None, []).append(w)  # None cannot be a character
            longest = max(longest, len(w))
        last = [-1] * (longest + 1)  # of the prefixes on the way to the current node
        stack: list[tuple[str, dict, int]] = [("", root, 0)]
        fit, inner, sizes = self._fit, self.inner, self.inner_sizes
        while stack:
            w, node, d = stack.pop()
            if d:
                last[d] = fit(w, d, last, inner, sizes)
            for c, child in node.items():
                if c is None:
                    for w in child:
                        out[w] = self.read_back(w, last)
                else:
                    stack.append((*child, d + 1))
        return out

    def last_inner(self, w: str, d: int, last: list[int]) -> int:
        """The last token of the first d characters of a word that goes on, given those of all shorter prefixes."""
        return self._fit(w, d, last, self.inner, self.inner_sizes)

    def _fit(self, w: str, d: int, last: list[int], tokens: dict[str, int], sizes: dict[str, tuple[int, ...]]) -> int:
        tail = w[d - 3 if d > 3 else 0 : d]
        known, size = self.merges.known, self.merges.size
        for n in sizes.get(tail) or self._short(tokens, sizes, tail):
            if n <= d and (t := tokens.get(w[d - n : d])) is not None:
                if n == d:
                    return t
                before = last[d - n]
                fits = known.get(before * size + t)
                if fits or (fits is None and self.merges.stand(before, t)):
                    return t
        raise ValueError("the vocabulary lacks a byte")

    def read_back(self, w: str, last: list[int]) -> list[int]:
        """The ids of a whole word: its last token, which bears the word end, then the last token of what is before it, and so on."""
        at, width = len(w), self.width
        t = self._fit(w, at, last, self.final, self.final_sizes)
        ids = [t]
        at -= width[t]
        while at:
            t = last[at]
            ids.append(t)
            at -= width[t]
        ids.reverse()
        return ids

    def entry(self, ids: Sequence[int]) -> tuple[bytes, str]:
        id_bytes, tokens = self.id_bytes, self.tokens
        return b"".join([id_bytes[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def learn(self, words: Iterable[str]) -> None:
        own = list(words)
        chars = [self.as_chars(w) for w in own]
        found = self.walk(chars)
        for w, c in zip(own, chars, strict=True):
            self.cache[w] = self.entry(found[c])

    def parts(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text, word by word, of a text that the library splits."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        for i, part in enumerate(self.special_at.split(text)):
            if i % 2:
                yield self.id_bytes[self.special_ids[part]], part
                continue
            words = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))] if part else []
            for w, ids in self.walk(set(words).difference(self.pieces)).items():
                self.pieces[w] = self.entry(ids)
            yield from (self.pieces[w] for w in words)

    def encode_decode(self, texts: Sequence[str]) -> Iterator[tuple[bytes, str]]:
        """Of each text, its ids (little-endian unsigned 32-bit) and the text that they decode to, tokens joined by spaces."""
        for text, found in zip(texts, self.found(texts), strict=True):
            entries = list(self.parts(text)) if found is None else found
            ids, decoded = zip(*entries, strict=True) if entries else ((), ())
            yield b"".join(ids), " ".join(decoded)

    def decode(self, ids: Sequence[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) does: this vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


_encoders: dict[str, TrieEncoder] = {}
caches.append(_encoders.clear)


def trie_encoder(path: str) -> TrieEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (little-endian unsigned 32-bit integers), decoded.

    A null or empty text has no ids and decodes to an empty text. Equal or null doc_ids are encoded row by row; an empty
    table gives no rows; further columns are left out. Strings of special tokens in a text become their ids, as in the library.
    """

    @serves("trie")
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(vocab)
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                ids, decoded = zip(*enc.encode_decode(texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(partition, "doc_id bigint, ids binary, decoded string")


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
