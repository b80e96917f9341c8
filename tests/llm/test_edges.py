"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import bag, cut, near_classes, repeated_spans, repeated_words, repeated_words_spans, text
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import bpe_trie, chat_format, exact_dedup, license_scan, minhash, packing, quality, shared, sstable, suffix_dedup, toxicity
from tideline.llm.tokens import vocabulary

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(1, 9))) for _ in range(400)]
PROSE = " ".join(RNG.choice(WORDS) for _ in range(150))
LONG = " ".join(RNG.choice(WORDS) for _ in range(40_000))
ROWS = [
    (None, None),
    (None, "an id is missing here"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PROSE),
    (5, PROSE + " "),
    (6, PROSE.replace(WORDS[0], "zzz", 1) + " tail"),
    (7, LONG),
    (8, LONG[5000:9000]),
    (9, "Ünïcode — “quotes” 日本語 <|endoftext|> <|im_end|> 😀"),
    (9, "Ünïcode — “quotes” 日本語 <|endoftext|> <|im_end|> 😀"),
    (10, "x" * 5000),
    (11, "Licensed under the Apache License, Version 2.0. All rights reserved. cc by CC-BY!"),
    (12, "same words same words same words same words same words same words"),
]
SCHEMA = "doc_id bigint, text string"
EXTRA = ["kept", "removed", "score", "predicted", "k1", "digest", "uid", "text_sha256", "n_chars", "c0", "won", "ids", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows above with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select(*(F.lit(f"own {n}").alias(n) for n in EXTRA), "doc_id", "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumn("kept", F.lit(1))


def key(x):
    return (x is None, x or 0)


def test_exact_dedup(spark, docs, empty):
    def index():
        return exact_dedup.DigestIndex(spark, shared.new_path(spark, "t"), 4)

    got = exact_dedup.dedup(docs, index()).collect()
    normal = lambda t: text(t).translate({ord(c): None for c in exact_dedup.WHITESPACE})
    groups = {}
    for i, t in ROWS:
        groups.setdefault(normal(t), []).append((-len(text(t)), i is None, i or 0))
    assert len(got) == len(ROWS)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(own)
        assert (r.keep_id, r.group_size) == (None if best[1] else best[2], len(own))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.survivors(docs, index())
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert {r.kept for r in kept.select("kept").collect()} == {"own kept"}
    assert exact_dedup.dedup(empty, index()).count() == 0 and exact_dedup.survivors(empty, index()).count() == 0


def test_index_persists_between_batches(spark):
    path = shared.new_path(spark, "t")
    first = spark.createDataFrame([(5, "a b"), (6, "c")], SCHEMA)
    second = spark.createDataFrame([(1, "ab  "), (2, "d"), (3, "d")], SCHEMA)
    exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4)).collect()
    index = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.dedup(second, index).collect()}
    assert got == {1: (5, False, 1), 2: (2, True, 2), 3: (2, False, 2)}
    assert index.entries().count() == 3
    # the index side of the anti-join is read in its buckets: no exchange above its scan
    plan = second.select(F.sha2("text", 256).alias("digest")).hint("merge").join(index.entries().select("digest"), "digest", "left_anti")
    assert "Bucketed: true" in plan._jdf.queryExecution().executedPlan().toString() or "SelectedBucketsCount" in plan._jdf.queryExecution().toString()


def test_a_batch_can_be_run_again(spark):
    path = shared.new_path(spark, "t")
    batches = {1: [(5, "a b"), (6, "c"), (7, "c ")], 2: [(1, "ab  "), (2, "d"), (3, "d")], 3: []}
    for n in (1, 2, 2, 1, 3, 2):
        index = exact_dedup.DigestIndex(spark, path, 4)
        got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(spark.createDataFrame(batches[n], SCHEMA), index, batch=n).collect()}
        assert got == {1: {5: (5, True), 6: (7, False), 7: (7, True)}, 2: {1: (5, False), 2: (2, True), 3: (2, False)}, 3: {}}[n]
        kept = exact_dedup.survivors(spark.createDataFrame(batches[n], SCHEMA), index, batch=n)
        index.close()
        assert {r.doc_id for r in kept.collect()} == {i for i, (_, k) in got.items() if k}
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert index.entries().count() == index.entries().select("digest").distinct().count() == 3


def test_near_duplicates(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    classes = near_classes([text(t) for _, t in ROWS])
    names = {}
    for n, (i, _) in enumerate(ROWS):
        names.setdefault(classes[n], []).append(i)
    want = sorted(((i, min((x for x in names[classes[n]]), key=key), len(names[classes[n]])) for n, (i, _) in enumerate(ROWS)), key=lambda r: (key(r[0]), r[2]))
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=lambda r: (key(r[0]), r[2])) == want
    assert sum(r.kept for r in got) == len(names)
    kept = minhash.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == len(names)
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, empty, hot):
    got = suffix_dedup.remove_repeats(docs, mark={"spans": suffix_dedup.WORDS}, hot=hot)
    assert got.columns == [c for c in EXTRA if c not in ("kept", "removed", "spans")] + ["doc_id", "kept", "removed", "spans"]
    texts = [text(t).encode() for _, t in ROWS]
    spans, words = repeated_spans(texts, 400), repeated_words_spans(texts, 50)
    want = sorted(((i, cut(t, s), s, w) for (i, _), t, s, w in zip(ROWS, texts, spans, words, strict=True)), key=lambda r: (key(r[0]), r[1]))
    runs = lambda c: [(x.f, x.t) for x in c]
    assert sorted(((r.doc_id, bytes(r.kept), runs(r.removed), runs(r.spans)) for r in got.collect()), key=lambda r: (key(r[0]), r[1])) == want
    assert suffix_dedup.remove_repeats(empty, mark={"spans": suffix_dedup.WORDS}, hot=hot).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
@pytest.mark.parametrize("kind", [suffix_dedup.Passage(12, 4), suffix_dedup.Passage(6, 2, True)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, kind, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)  # texts longer than that are read in parts
    rng = random.Random(hot)
    letters = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    shared_parts = [letters(n) for n in (5, 14, 30, 60, 200)]
    rows = [(n, "".join(rng.choice([letters(rng.randint(0, 40)), rng.choice(shared_parts), "ab " * 20]) for _ in range(rng.choice([0, 1, 4, 30])))) for n in range(60)]
    texts = [t.encode() for _, t in rows]
    found = (repeated_words_spans if kind.words else repeated_spans)(texts, kind.least)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), kind=kind, hot=hot).collect()
    assert {r.doc_id: ([(x.f, x.t) for x in r.removed], bytes(r.kept)) for r in got} == {n: (s, cut(t, s)) for (n, _), t, s in zip(rows, texts, found, strict=True)}


def test_shared_passages_of_over_fifty_words(spark):
    """Passages of 51 to 70 words, most of them shorter than 400 bytes, each in three texts of its own words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    parts = [prose(rng.randint(51, 70)) for _ in range(20)]
    assert any(len(p) < 400 for p in parts)
    rows = [(3 * n + k, f"{prose(60)} {p}\n{prose(40)}") for n, p in enumerate(parts) for k in range(3)] + [(100 + n, f"{prose(90)} {prose(49)}") for n in range(20)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), kind=suffix_dedup.WORDS, as_text=True).collect()}
    for i, t in rows:
        assert got[i].kept == (t.replace(parts[i // 3], "") if i < 100 else t)


def test_cut_through_a_character_leaves_valid_text(spark):
    body = "é" * 300
    df = spark.createDataFrame([(1, "aé" + body), (2, "b" + body + "z")], SCHEMA)
    for r in suffix_dedup.remove_repeats(df, as_text=True).collect():
        r.kept.encode()
        assert "�" not in r.kept


def test_packing(docs, empty):
    vocab = vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs, vocab, 2, size=64, open_windows=3).collect()
    enc = bpe_trie.trie_encoder(vocab).library
    ids = [enc.encode(text(t), add_special_tokens=False).ids + [2] for _, t in ROWS]
    whole, windows = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64 and end & (end - 1) == 0  # full, or a power of two: nothing is padded
    single = {(i, len(x)): np.array(x, "<u4").tobytes() for (i, _), x in zip(ROWS, ids, strict=True) if i not in (9, None)}
    for k, want in single.items():
        assert b"".join(p for _, p in sorted(whole[k])) == want
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert packing.pack(empty, vocab, 2).count() == 0


def test_quality(docs, empty):
    got = sorted(quality.judge(docs).collect(), key=lambda r: (key(r.doc_id), r.n_words))
    for r, (_, t) in zip(got, sorted(ROWS, key=lambda x: (key(x[0]), len(text(x[1]).encode().split()))), strict=True):
        words = text(t).encode().split()
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), repeated_words(words))
        assert r.n_symbols == sum(text(t).count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert not (r.kept and r.base_failed)
    verdicts = {r.doc_id: r.verdict for r in got}
    assert verdicts[4] == verdicts[7] == "ok" and verdicts[10] == "repetitive"
    assert quality.judge(empty).count() == 0


def test_random_text_is_incompressible():
    import zstandard

    noise = "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    c = zstandard.ZstdCompressor(level=3)
    assert quality.compression_verdict(noise.encode(), c)[3] == "incompressible"
    assert quality.compression_verdict((LONG[:30_000] + noise * 3).encode(), c)[3] == "chunks"
    assert quality.duplicate_lines(b"a\n\n\na\n \n b\na") == 2


def test_bytes_after_the_last_whole_chunk_are_judged():
    import base64

    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    words = (" ".join(random.Random(1).choices(WORDS[:60], k=3000))).encode()
    noise = base64.b64encode(random.Random(1).randbytes(3000))[:3800]
    clean = quality.compression_verdict(words[:7896], c)
    assert clean[1:] == (2, 0, "ok")
    for data in (words[:4096] + noise, noise + words[:4096]):
        ratio, n, bad, verdict = quality.compression_verdict(data, c)
        assert quality.outside(ratio, len(data)) is None and (n, bad, verdict) == (2, 1, "chunks")
    ratio, n, bad, verdict = quality.compression_verdict(words[:4096] + b"same line\n" * 50, c)
    assert quality.outside(ratio, 4596) is None and (n, bad, verdict) == (2, 1, "chunks")
    assert quality.compression_verdict(words[:4096], c)[1:] == (1, 0, "ok")


def test_license_scan(docs, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect() if r.doc_id is not None}
    assert {m.label for m in got[11].matches} == {"apache"} and sorted(p.label for p in got[11].places) == ["cc-by", "cc-by", "reserved"]
    assert got[1].n_words == got[2].n_words == 0 and not got[7].matches
    assert license_scan.scan(empty).count() == 0


def test_every_block_is_compared():
    """The filtered join finds what comparing every block with every template finds."""
    rng = random.Random(5)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()} | set(WORDS[:20]))
    counts = {w.encode(): rng.randint(1, 50) for w in pool}
    for threshold in (0.3, 0.6, 0.85):
        index = license_scan.TemplateIndex(license_scan.TEMPLATES, counts, threshold)
        sets = [{w.encode() for w in t.split()} for _, t in license_scan.TEMPLATES]
        for n in (0, 1, 30, 64, 65, 300):
            words = [rng.choice(pool).encode() for _ in range(n)]
            want = []
            for b in range(max(0, -(-(n - 64) // 32)) + 1):
                block = set(words[32 * b : 32 * b + 64])
                want += [(t, 32 * b, len(s & block)) for t, s in enumerate(sets) if len(s & block) >= threshold * len(s) - 1e-9]
            assert sorted(index.matches(words)) == sorted(want)


def test_toxicity(spark, docs, empty):
    bad, rows = ["idiot", "scum", "moron"], []
    for i in range(600):
        words = [RNG.choice(WORDS) for _ in range(40)]
        if i % 4 == 0:
            words[5:5] = RNG.sample(bad, 2)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int"))
    model = toxicity.train(table.drop("toxic"), labels, allowed=~toxicity.held_out())
    assert 0 < len(model.index) < 1 << toxicity.BITS
    scored = toxicity.score(table, model).where(toxicity.held_out()).collect()
    assert sum((r.score >= 0.7) == (r.toxic == 1) for r in scored) >= 0.97 * len(scored)
    got = toxicity.score(docs, model).select("doc_id", "score", "predicted").collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(table.drop("toxic"), labels.limit(0))
    assert blank.scores(["anything"]) == [0.5]


def test_long_templates_are_found_across_block_edges(spark, empty):
    templates = tuple((f"t{n}", " ".join(f"w{n}x{i}" for i in range(n))) for n in (33, 34, 65, 66, 500))
    assert {k: len(v) for k, v in license_scan.by_block(templates).items()} == {64: 1, 128: 2, 256: 1, 1024: 1}
    rows = [(1000 * n + at, " ".join(["filler"] * at + [t]) + " end") for n, (_, t) in enumerate(templates) for at in range(0, 600, 29)]
    for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA), templates, threshold=1.0).collect():
        assert {m.template for m in r.matches} == {r.doc_id // 1000}
    assert license_scan.scan(empty, templates).count() == 0


def test_few_labels_set_the_bias_with_every_row(monkeypatch):
    seen, cut = [], toxicity._cut

    def recorded(logits, labels):
        seen.append((len(logits), int(labels.sum())))
        return cut(logits, labels)

    monkeypatch.setattr(toxicity, "_cut", recorded)
    rng = random.Random(5)
    for n, want in ((120, [(120, 30)]), (400, [(100, 25)]), (24, [])):
        labels = [int(i % 16 in (0, 5, 10, 15)) for i in range(n)]
        texts = [" ".join(rng.choices(WORDS, k=20) + ["scum"] * y) for y in labels]
        seen.clear()
        toxicity.fit([(texts, labels)])
        assert seen == want


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} word{i}") for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(table, x, allowed=~toxicity.held_out()) for x in (labels, flipped))
    assert np.array_equal(a.index, b.index) and np.array_equal(a.weight, b.weight) and a.bias == b.bias
    assert {r.doc_id for r in table.where(toxicity.held_out()).collect()} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_sorted_shards(spark, docs, empty):
    path, vocab = shared.new_path(spark, "t"), vocabulary("byte_bpe_50k.json")
    shards = sstable.write_shards(docs, path, vocab, 0, shards=3)
    got = sorted(sstable.read_shards(spark, path, shards).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocab)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, lib.encode(text(t), add_special_tokens=False).ids + [0]) for i, t in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    none = shared.new_path(spark, "t")
    assert sstable.read_shards(spark, none, sstable.write_shards(empty, none, vocab, 0)).count() == 0


def test_shard_lookup(tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(1)
    keys = sorted({int(k) for k in rng.integers(-(2**40), 2**40, 3000)})
    out = fs.LocalFileSystem().open_output_stream(str(tmp_path / "s.sst"))
    w = sstable.ShardWriter(out, 2)
    w.add(sstable.key_of(None), b"\x07\x00")
    values = {k: rng.integers(0, 60000, int(rng.integers(1, 60))).astype("<u2").tobytes() for k in keys}
    for k in keys:
        w.add(sstable.key_of(k), values[k])
        if k % 7 == 0:
            w.add(sstable.key_of(k), b"\x01\x00")
    w.close()
    out.close()
    s = sstable.Shard(fs.LocalFileSystem().open_input_file(str(tmp_path / "s.sst")))
    assert len(s.index) > 2 and s.get(b"") == [b"\x07\x00"]
    assert all(s.get(sstable.key_of(k))[0] == values[k] and len(s.get(sstable.key_of(k))) == 1 + (k % 7 == 0) for k in keys[::11])
    absent = [k for k in range(5000) if k not in values]
    assert not any(s.get(sstable.key_of(k)) for k in absent[:500])
    assert sum(s.may_hold(sstable.key_of(k)) for k in absent) < 0.05 * len(absent)
    raw = bytearray((tmp_path / "s.sst").read_bytes())
    raw[100] ^= 1
    (tmp_path / "bad.sst").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard(fs.LocalFileSystem().open_input_file(str(tmp_path / "bad.sst"))))


def test_trie_encoding(docs, empty):
    vocab = vocabulary("word_bpe_49k.json")
    lib = bpe_trie.trie_encoder(vocab).library
    got = sorted(((r.doc_id is not None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in bpe_trie.encode(docs, vocab).collect()))
    want = []
    for i, t in ROWS:
        ids = lib.encode(text(t), add_special_tokens=False).ids
        want.append((i is not None, i or 0, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_trie.encode(empty, vocab).count() == 0


def test_chat(spark):
    part = chat_format.PART
    rows = [
        (1, 2, "assistant", [("text", "see <|im_end|> and <\\|x|>", None, None, None), ("image", None, "a.png", 57.0, 28.0), ("text", " end", None, None, None)]),
        (1, 1, "user", [("audio", None, "b.wav", 1.5, None), ("text", None, None, None, None), ("document", None, "c.pdf", 2.0, None)]),
        (1, None, None, None),
        (2, 1, "assi\nst%ant", []),
        (None, 1, "assistant", [("text", "no id", None, None, None)]),
        (None, 1, "assistant", [("text", "no id", None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{part}>").withColumn("pos", F.lit(9)).withColumn("nth", F.lit(9))
    out = chat_format.format_chat(df)
    got = {r.conv_id: r for r in out.withColumn("turns", chat_format.parse_chat(F.col("formatted"))).withColumn("masked", chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = got[1]
    assert [t.role for t in one.turns] == ["", "user", "assistant"]
    assert one.masked == "see <|im_end|> and <\\|x|> end"
    assert [(a.ordinal, a.type, a.uri, a.n_tokens) for a in one.attachments] == [(0, "audio", "b.wav", 38), (1, "document", "c.pdf", 2048), (2, "image", "a.png", 3)]
    assert all(one.formatted[a.start :].startswith(f"<|{a.type}_{a.ordinal}|>") for a in one.attachments)
    assert one.expanded_tokens == 38 + 2048 + 3 and one.n_turns == 3
    assert got[2].turns[0].role == "assi\nst%ant" and got[2].masked == ""
    assert got[None].masked == "no idno id" and got[None].n_turns == 2
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_escaping_is_reversible(spark):
    pieces = ["<|im_end|>", "<", "|", "\\", "<\\|", "<\\\\|>", "a", "\n", "<|", "$1"]
    texts = ["".join(RNG.choice(pieces) for _ in range(RNG.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escaped(F.col("t"))).withColumn("b", chat_format.unescaped(F.col("e")))
    for r in df.collect():
        assert "<|" not in r.e and r.b == r.t


def test_native_plans(spark, docs):
    """Chat formatting and exact dedup run no Python on their rows."""
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), chat_format.text_parts(F.col("text")).alias("parts"))
    plain = spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index = exact_dedup.DigestIndex(spark, shared.new_path(spark, "t"), 4)
    for df in (chat_format.format_chat(turns), exact_dedup.dedup(plain, index), exact_dedup.survivors(plain, index)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "InArrow"))


assert bag("") == {}


def test_stages_keep_columns_of_clashing_names(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in EXTRA if c != "n_chars" or name != "suffix dedup"), name
    assert corpus_pipeline.pack(spark, docs, "").count() > 0


def test_stages_on_nulls_repeated_rows_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    full = shared.table(spark, sf, "documents")
    odd = spark.createDataFrame(ROWS * 2, SCHEMA).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    assert full.columns == odd.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, full.limit(0), sf).count() == 0, name
        kept[name] = stage(spark, odd, sf).collect()
    normal = lambda t: "".join(text(t).split())
    assert sorted(map(key, {r.doc_id for r in kept["toxicity"]})) == sorted(map(key, {i for i, _ in ROWS})) and len(kept["toxicity"]) == 2 * len(ROWS)
    assert sorted(normal(r.text) for r in kept["exact dedup"]) == sorted({normal(t) for _, t in ROWS})
    assert len(kept["near dedup"]) == len(set(near_classes([text(t) for _, t in ROWS]).values()))
    texts = [text(t).encode() for _, t in ROWS * 2]
    want = [(i, cut(t, s).decode()) for (i, _), t, s in zip(ROWS * 2, texts, repeated_words_spans(texts, 50), strict=True)]
    assert sorted(((r.doc_id, r.text) for r in kept["suffix dedup"]), key=lambda r: (key(r[0]), r[1])) == sorted(want, key=lambda r: (key(r[0]), r[1]))
    assert {r.n_chars - len(r.text) for r in kept["suffix dedup"]} == {0}
    lib = bpe_trie.trie_encoder(vocabulary("word_bpe_49k.json")).library
    assert sum(r.length for r in kept["packing"]) == sum(len(lib.encode(t.decode(), add_special_tokens=False).ids) + 1 for t in texts)
