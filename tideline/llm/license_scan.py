"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of BLOCK words, one every half of that, so that any half a block and one word more in a row lie whole in
one; longer templates are held against blocks of twice as many words, or four times, and so on. Tokens
are ordered by their frequency over the corpus, the rarest first. A block can only hold enough of a
template if they share one of the template's first tokens in that order (prefix filter), if it is large enough (length
filter), and if enough tokens are left after the first that they share (positional filter); the rest is counted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .tokens import text_chunks

BLOCK = 64
#: Share of a template's distinct words that a block has to hold.
CONTAINMENT = 0.85
#: Phrases that count wherever their words stand in a row.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and wording of license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
)
#: Templates go to every executor; more words than this are refused.
MOST_TEMPLATE_WORDS = 1_000_000

#: Words are runs of 0-9, a-z and bytes from 0x80 on, after A-Z is lower-cased; other bytes part them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand in a row."""
    found, at = [], -1
    anchor = max(range(len(phrase)), key=lambda i: len(phrase[i]))
    while True:
        try:
            at = words.index(phrase[anchor], at + 1)
        except ValueError:
            return found
        begin = at - anchor
        if begin >= 0 and words[begin : begin + len(phrase)] == phrase:
            found.append(begin)


class TemplateIndex:
    """Templates with their tokens in corpus order, the rarest first, and the prefixes by token."""

    def __init__(self, templates: tuple[tuple[str, str], ...], counts: dict[bytes, int], threshold: float, block: int = BLOCK) -> None:
        self.block, self.step = block, block // 2
        sets = [sorted(set(words_of(text))) for _, text in templates]
        vocabulary = sorted({w for s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in templates]
        self.tokens = [frozenset(self.rank[w] for w in s) for s in sets]
        self.needed = [ceil(threshold * len(s) - 1e-9) for s in sets]
        self.least = min(self.needed, default=0)
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.tokens):
            for place, r in enumerate(sorted(s)[: len(s) - self.needed[t] + 1]):
                self.prefix.setdefault(r, []).append((t, place))
        self.prefix_words = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word of the block, shared tokens) of every block that meets the threshold."""
        if self.prefix_words.isdisjoint(words):
            return []
        hits = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) is not None]
        last = max(0, -(-(len(words) - self.block) // self.step))
        blocks = {b for i, r in hits if r in self.prefix for b in (i // self.step, i // self.step - 1) if 0 <= b <= last}
        found = []
        for b in sorted(blocks):
            begin, end = bisect_left(hits, (b * self.step, -1)), bisect_left(hits, (b * self.step + self.block, -1))
            block = sorted({r for _, r in hits[begin:end]})
            if len(block) < self.least:
                continue
            tried: set[int] = set()
            own = set(block)
            for j, r in enumerate(block):
                for t, place in self.prefix.get(r, ()):
                    if t in tried:
                        continue
                    tried.add(t)  # the first token that they share
                    if 1 + min(len(self.tokens[t]) - place, len(block) - j) - 1 >= self.needed[t]:
                        shared = len(self.tokens[t] & own)
                        if shared >= self.needed[t]:
                            found.append((t, b * self.step, shared))
        return found


def by_block(templates: tuple[tuple[str, str], ...]) -> dict[int, list[int]]:
    """Templates by the number of words in the blocks that they are held against: the least that is sure to hold them whole."""
    out: dict[int, list[int]] = {}
    for t, (_, text) in enumerate(templates):
        size = BLOCK
        while len(words_of(text)) > size // 2 + 1:
            size *= 2
        out.setdefault(size, []).append(t)
    return out


def template_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """Over all documents, how many hold each word of the templates: as many numbers as the templates have words."""
    wanted = frozenset(w for _, text in templates for w in words_of(text))
    if len(wanted) > MOST_TEMPLATE_WORDS:
        raise ValueError("too many template words to send to every executor")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in text_chunks(batch, text_col):
                for t in texts:
                    counts.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    rows = docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int64()), ("first_word", pa.int64()), ("containment", pa.float64())]))
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_SCHEMA = (
    "doc_id bigint, n_words bigint, places array<struct<label:string,word:bigint>>, "
    "matches array<struct<label:string,template:bigint,first_word:bigint,containment:double>>"
)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, places of the phrases, and every block that meets a template's threshold.

    A null or empty text has no words and no matches. Equal or null doc_ids are scanned row by row, repeated rows too; an
    empty table gives no rows; further columns are left out. A notice that insertions stretch beyond half a block can be
    missed at a block's edge.
    """
    counts = template_counts(docs, templates, text_col)
    phrases = [(label, words_of(p)) for p, label in PHRASES]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [(own, TemplateIndex(tuple(templates[t] for t in own), counts, threshold, block)) for block, own in by_block(templates).items()]
        for batch in batches:
            for part, texts in text_chunks(batch, text_col):
                sizes, places, matches = [], [], []
                for t in texts:
                    words = words_of(t)
                    sizes.append(len(words))
                    places.append([{"label": label, "word": i} for label, p in phrases for i in phrase_places(words, p)])
                    matches.append([{"label": index.labels[k], "template": own[k], "first_word": b, "containment": n / len(index.tokens[k])} for own, index in indexes for k, b, n in index.matches(words)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(places, _PLACE), pa.array(matches, _MATCH)], names=["doc_id", "n_words", "places", "matches"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(partition, _SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    word = F.transform("places", lambda p: p["word"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
