"""Encoding with a public tokenizer of the ``tokenizers`` library, a word at a time.

Both vocabularies used here split a text into words that are encoded independently. A worker keeps
the ids of the words it has met; the library encodes the others, many in one call. Texts with
characters for which the split below is not certain to be the library's go to it whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Sequence

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .worker import caches

#: Characters whose classes are fixed in every Unicode version in use; I with dot is left out, as it lower-cases to two.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_OTHER_CHARS = re.compile("[^\x00-\x1b\x20-įı-ſ]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PATTERNS = {
    "byte": f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+",
    "word": f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+",
}
#: Words that a worker remembers; when there are more, those of up to SHORT characters stay, as longer ones seldom come again.
CACHE_WORDS, SHORT = 600_000, 9
#: Characters split at once, and new words put into one text for the library.
CHUNK_CHARS, JOINED_WORDS = 1_500_000, 500


class WordEncoder:
    """Ids of whole texts as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "word" if spec["normalizer"] else "byte"
        self.pattern = re.compile(_PATTERNS[self.kind])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_start = os.path.commonprefix(self.special)  # most texts lack even that
        self.vocab_size = self.library.get_vocab_size()
        self.cache: dict = {}  # what is remembered of words
        if self.kind == "word":
            self.ends = np.zeros(self.vocab_size, bool)
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        else:
            self.newline = self.library.encode("\n", add_special_tokens=False).ids[0]

    def split(self, text: str) -> list[str] | None:
        """The text's words; None where the library has to split it."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if _OTHER_CHARS.search(text):
                    return None
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or (self.special_start in text and any(s in text for s in self.special)):
            return None
        return self.pattern.findall(text.lower() if self.kind == "word" else text)

    def learn(self, words: Iterable[str]) -> None:
        """Puts the ids of new words into the cache."""
        own, cache = list(words), self.cache
        if self.kind == "byte":
            alone = [w for w in own if w.isspace()]
            for w, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, "<u4").tobytes()
            own = [w for w in own if not w.isspace()]
        if not own:
            return
        # A line feed, or the end of a word, keeps the words apart in texts of a few hundred words, which the library takes faster than one long text or single words.
        joint = "\n" if self.kind == "byte" else " "
        texts = [joint.join(own[i : i + JOINED_WORDS]) for i in range(0, len(own), JOINED_WORDS)]
        found = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        if self.kind == "byte":
            line = np.array([self.newline], "<u4")
            ids = np.concatenate([x for part in found for x in (part, line)])
            stops = np.flatnonzero(ids == self.newline)
            starts = np.append(0, stops[:-1] + 1)
        else:
            ids = np.concatenate(found)
            stops = np.flatnonzero(self.ends[ids]) + 1
            starts = np.append(0, stops[:-1])
        if len(stops) != len(own):
            raise ValueError("the vocabulary does not keep words apart")
        raw = ids.tobytes()
        cache.update(zip(own, (raw[a:b] for a, b in zip((starts * 4).tolist(), (stops * 4).tolist(), strict=True)), strict=True))

    def found(self, texts: Sequence[str]) -> list[list | None]:
        """What is known of each text's words, in order; None for texts that the library splits."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {w: v for w, v in self.cache.items() if len(w) <= SHORT}
            if len(self.cache) > CACHE_WORDS // 2:
                self.cache = {}
        cache, get = self.cache, self.cache.get
        words = [self.split(t) for t in texts]
        out: list[list | None] = [None if w is None else list(map(get, w)) for w in words]
        # One lookup a word; only the places of unknown ones are visited again.
        gaps = [[] if f is None else [k for k, v in enumerate(f) if v is None] for f in out]
        new: set[str] = set()
        for w, ks in zip(words, gaps, strict=True):
            new.update([w[k] for k in ks])
        self.learn(new)
        for w, f, ks in zip(words, out, gaps, strict=True):
            for k in ks:
                f[k] = cache[w[k]]
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [self.whole(t) if f is None else b"".join(f) for t, f in zip(texts, self.found(texts), strict=True)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, WordEncoder] = {}
caches.append(_encoders.clear)


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file; it lasts until the worker turns to another operator."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices of about ``most`` characters with their texts, nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    begin = 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), most, "right")))
        part = batch.slice(begin, end - begin)
        yield part, [t or "" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; installed on every machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
