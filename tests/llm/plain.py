"""Plain versions of operators that several tests compare with."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_failed(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def chained_xxh64(*parts):
    """XXH64 of strings in Spark's way: each hash seeds the next."""
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def log_ratios(docs, trusted, buckets, smoothing, relative):
    """doc_id -> mean log ratio of its n-grams."""
    raw, target, grams = np.zeros(buckets), np.zeros(buckets), {}
    for doc_id, text in docs.items():
        words = WORDS.findall(text or "")
        held = [chained_xxh64(w) % buckets for w in words]
        held += [chained_xxh64(w, v) % buckets for w, v in zip(words, [*words[1:], ""])]
        grams[doc_id] = held
        np.add.at(raw, held, 1)
        if doc_id in trusted:
            np.add.at(target, held, 1)
    smoothing = max(smoothing, relative * target.sum() / buckets)
    ratio = np.log((target + smoothing) / (raw * target.sum() / raw.sum() + smoothing))
    return {d: ratio[g].mean() if g else 0.0 for d, g in grams.items()}


def word_edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def line_drops(docs, min_words):
    """doc_id -> numbers of the lines that go; documents in the order given."""
    seen, exact, out = {}, set(), {}
    for doc_id, text in docs.items():
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(w for w in WORDS.findall(line.lower()))
            if not words:
                continue
            near = [s for size in (-1, 0, 1) for s in seen.get(len(words) + size, ())] if len(words) >= min_words else []
            if words in exact or any(len(s) >= min_words and word_edits(words, s) <= 1 for s in near):
                gone.append(n)
            if words not in exact:
                exact.add(words)
                seen.setdefault(len(words), []).append(words)
        if gone:
            out[doc_id] = gone
    return out


def fingerprint(text):
    words = WORDS.findall(lower_ascii(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, bits):
    ids = list(range(len(marks)))

    def root(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return [root(i) for i in range(len(marks))]


def hit_words(text, items, window=10):
    """Places of the hit words of a text, and how many words it has."""
    words = ITEM_WORDS.findall(lower_ascii(text))
    hit = set()
    for item in items:
        own = ITEM_WORDS.findall(lower_ascii(item))
        size = min(window, len(own))
        windows = {tuple(own[p : p + size]) for p in range(len(own) - size + 1)} if size else set()
        for q in range(len(words) - size + 1 if size else 0):
            if tuple(words[q : q + size]) in windows:
                hit |= set(range(q, q + size))
    return hit, len(words)
