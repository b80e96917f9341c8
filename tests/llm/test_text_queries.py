"""The registered queries against SQL, libraries and brute force on the small tables; the stages of the pipeline one by one."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import base_failed, compression_kept, cut, license_labels, near_classes, phrase_places, repeated_spans, repeated_words, repeated_words_spans
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import registry, shared
from tideline.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in shared.table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name]).select(*columns).fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r.class_id for r in registry.queries()["op1_near_duplicates"](spark, SF).collect()}
    ids = sorted(texts)
    classes = near_classes([texts[i] for i in ids])
    least = {}
    for n, i in enumerate(ids):
        least[classes[n]] = min(i, least.get(classes[n], i))
    assert got == {i: least[classes[n]] for n, i in enumerate(ids)}


def test_suffix_dedup(spark, texts):
    ids = sorted(texts)
    raw = [texts[i].encode() for i in ids]
    spans = repeated_spans(raw, 400)
    words = repeated_words_spans(raw, 50)
    want = {i: (len(t), len(t) - len(cut(t, s)), len(s), hashlib.sha256(cut(t, s)).hexdigest(), len(w), len(t) - len(cut(t, w))) for i, t, s, w in zip(ids, raw, spans, words, strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.passage_bytes) for r in registry.queries()["op9_suffix_dedup"](spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_quality(spark, texts):
    rows = registry.queries()["op4_compression_bands"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        words = t.encode().split()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), repeated_words(words))
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        assert r.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))
        assert r.base_failed == base_failed(words) and r.kept == (not r.base_failed and compression_kept(t.encode()))
    assert {r.kept for r in rows} == {True, False}


def test_license_scan(spark, texts):
    rows = registry.queries()["op5_license_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in shared.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        words, places = phrase_places(texts[r.doc_id])
        at = [i for _, i in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        base = {label for label, _ in places}
        own, best = license_labels(words)
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | own)))
        assert r.score == pytest.approx(1.0 if at else best)
    assert any(r.base_labels for r in rows) and any(r.labels != r.base_labels for r in rows)


def test_toxicity(spark):
    """Held-out rows of the 10,000 documents: who is scored, and how well."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in registry.queries()["op6_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in shared.table(spark, sf, "labels").collect()}
    assert len(rows) == shared.table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    own = [(rows[i].predicted, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    hits = sum(p and y for p, y in own)
    assert hits >= 0.9 * sum(p for p, _ in own) and hits >= 0.75 * sum(y for _, y in own)


def test_tokens(spark, texts):
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want, at = {}, 0
    for i in sorted(texts):
        ids = lib.encode(texts[i], add_special_tokens=False).ids + [0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.queries()["op7_sorted_shards"](spark, SF).collect()} == want
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, encoded = {}, {}
    for r in registry.queries()["op3_packing"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in registry.queries()["op8_bpe_trie"](spark, SF).collect():
        encoded[r.doc_id] = (r.n_tokens, r.ids_sha256, r.decoded_sha256)
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert encoded[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        full, end = np.array([*ids, 2], "<u4"), 0
        for start, length, crc in sorted(pieces[i]):
            assert start == end and crc == zlib.crc32(full[start : start + length].tobytes())
            end += length
        assert end == len(full)


def test_pipeline(spark):
    docs = shared.table(spark, SF, "documents")
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = shared.stored(stage(spark, docs, SF), "t")
        if name != "packing":
            assert docs.columns == shared.table(spark, SF, "documents").columns
        kept[name] = docs.collect()
    normal = lambda r: (r.text or "").translate({ord(c): None for c in " \t\n\x0b\f\r"})
    assert {r.doc_id for r in kept["toxicity"]} <= {r.doc_id for r in before} and len(kept["toxicity"]) > 0.8 * len(before)
    best = {}
    for r in kept["toxicity"]:
        k = (-len(r.text or ""), r.doc_id)
        best[normal(r)] = min(k, best.get(normal(r), k))
    assert {r.doc_id for r in kept["exact dedup"]} == {i for _, i in best.values()}
    rows = sorted(kept["exact dedup"], key=lambda r: r.doc_id)
    classes = near_classes([r.text or "" for r in rows])
    least = {}
    for n, r in enumerate(rows):
        least.setdefault(classes[n], r.doc_id)
    assert {r.doc_id for r in kept["near dedup"]} == set(least.values())
    rows = sorted(kept["near dedup"], key=lambda r: r.doc_id)
    raw = [(r.text or "").encode() for r in rows]
    want = {r.doc_id: cut(t, s).decode("utf-8", "ignore") for r, t, s in zip(rows, raw, repeated_words_spans(raw, 50), strict=True)}
    assert {r.doc_id: r.text for r in kept["suffix dedup"]} == want
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert sum(r.length for r in kept["packing"]) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in want.values())
