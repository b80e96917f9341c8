"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

import zstandard

from tideline.llm import license_scan, quality


def text(x):
    return x or ""


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def bag(t):
    words = re.findall(rb"[^\x00-\x20\x7f]+", t.encode().lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_classes(texts, least=0.8):
    """Component of each text: links by weighted Jaccard similarity; texts without words belong together."""
    bags = [bag(t) for t in texts]
    links = []
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            shared = sum((a & b).values())
            if (not a and not b) or (a and b and shared >= least * (sum(a.values()) + sum(b.values()) - shared)):
                links.append((i, j))
    return union(links, range(len(texts)))


def repeated_spans(texts, least):
    """Maximal runs of bytes covered by strings of ``least`` bytes that begin twice or more."""
    places = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - least + 1):
            if places[t[i : i + least]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + least
                else:
                    runs.append([i, i + least])
        out.append([tuple(r) for r in runs])
    return out


def repeated_words_spans(texts, least):
    """Maximal runs of words covered by strings of ``least`` words that begin twice or more, as places of bytes."""
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    tokens = [tuple(m.group() for m in w) for w in words]
    return [[(w[f].start(), w[t - 1].end()) for f, t in runs] for w, runs in zip(words, repeated_spans(tokens, least), strict=True)]


def cut(t, spans):
    at, out = 0, b""
    for f, e in spans:
        out += t[at:f]
        at = e
    return out + t[at:]


def repeated_words(words, size=5):
    windows = defaultdict(list)
    for i in range(len(words) - size + 1):
        windows[tuple(words[i : i + size])].append(i)
    return len({i + k for places in windows.values() if len(places) > 1 for i in places for k in range(size)})


def base_failed(words):
    return len(words) < 10 or 100 * repeated_words(words) > 20 * len(words)


def compression_kept(data):
    """Whether the whole text and enough of its chunks of 4096 bytes lie in the bands of their length."""

    def inside(part):
        ratio = len(part) / len(zstandard.ZstdCompressor(level=3).compress(part))
        low, high = next((low, high) for least, low, high in reversed(quality.BANDS) if len(part) >= least)
        return low <= ratio <= high

    if not data:
        return True
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    return inside(data) and sum(not inside(c) for c in chunks) <= 0.3 * len(chunks)


def phrase_places(t):
    """The words of a text, and (label, place) of the fixed phrases."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    phrases = (("cc-by", b"cc by"), ("gpl", b"general public license"), ("reserved", b"all rights reserved"))
    return words, [(label, i) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def license_labels(words):
    """Labels of the templates that a block of 64 words, one every 32, holds 0.85 of, and the best share of those."""
    labels, best = set(), 0.0
    for b in range(max(0, -(-(len(words) - 64) // 32)) + 1):
        block = set(words[32 * b : 32 * b + 64])
        for label, t in license_scan.TEMPLATES:
            own = set(t.encode().split())
            if len(own & block) >= 0.85 * len(own) - 1e-9:
                labels.add(label)
                best = max(best, len(own & block) / len(own))
    return labels, best
