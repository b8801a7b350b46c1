"""The pipeline's near-dedup stage against all pairs by exact Jaccard similarity."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from threatloom.llm import similar, simhash  # noqa: E402


def shingles(text):
    words = plain.WORDS.findall(plain.lower_ascii(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """Per text the least number of its component."""
    sets, part = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return [root(i) for i in range(len(texts))]


def near_copies(draw, n):
    """Documents, copies edited in ever more places, a passage in many, and odd ones."""
    words = [f"w{i}" for i in range(400)]
    passage = draw.choices(words, k=30)
    bases = [draw.choices(words, k=draw.randint(6, 250)) for _ in range(n // 4)]
    texts = [None, "", " ", "one", "One ", "a b c d", "a b c d e"]
    while len(texts) < n:
        own = list(draw.choice(bases[:3] if draw.random() < 0.3 else bases))
        for _ in range(draw.randint(0, max(1, len(own) // 30))):
            own[draw.randrange(len(own))] = draw.choice(words)
        if draw.random() < 0.2:
            own[draw.randrange(len(own)) :] = passage
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_equals_all_pairs(spark, sf_dir, seed):
    texts = near_copies(random.Random(seed), 160)
    want = components(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.similar_groups(frame).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in simhash.stage(spark, frame, sf_dir).collect()) == sorted(set(want))
    # fingerprints within four bits do not tell these groups
    assert components(texts) != plain.components([plain.fingerprint(t) for t in texts], 4)


def test_links_of_fingerprints_come_first(spark, sf_dir, monkeypatch):
    """The stage's first candidates are the links of the pivot tables; the exact join is left what they leave apart."""
    texts = near_copies(random.Random(3), 120)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, verified, own, close = [], [], similar._similar_pairs, simhash.near_links

    def links(marks):
        asked.append({r.fp for r in marks.collect()})
        return close(marks)

    def pairs(candidates, *rest):
        kept = own(candidates, *rest)
        verified.append(kept.count())
        return kept

    monkeypatch.setattr(simhash, "near_links", links)
    monkeypatch.setattr(similar, "_similar_pairs", pairs)
    kept = sorted(r.doc_id for r in simhash.stage(spark, frame, sf_dir).collect())
    assert kept == sorted(set(components(texts)))
    assert [{fp % (1 << 64) for fp in fps} for fps in asked] == [{plain.fingerprint(t) for t in texts}]
    assert len(verified) == 3 and verified[0] > 0
