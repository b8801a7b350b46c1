"""The pipeline, stage by stage, against plain versions on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from threatloom.llm import decontaminate, line_dedup, quality_rules, tokens  # noqa: E402
from threatloom.llm.scratch import store  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = out[name] = store(function(spark, docs, sf_dir), name)
    return out


def texts_of(frame):
    return {r.doc_id: r.text for r in frame.orderBy("doc_id").collect()}


def test_columns(stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_quality(spark, sf_dir, stages):
    docs = texts_of(stages["documents"])
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    ratios = plain.log_ratios(docs, trusted, quality_rules.BUCKETS, quality_rules.SMOOTHING,
                              quality_rules.RELATIVE_SMOOTHING)
    want = {d for d, t in docs.items() if not plain.base_failed(t) and ratios[d] >= quality_rules.THRESHOLD}
    close = {d for d in docs if abs(ratios[d] - quality_rules.THRESHOLD) < 2e-6}
    got = texts_of(stages["quality_rules"])
    assert set(got) - close == want - close and all(got[d] == docs[d] for d in got)


def test_lines(stages):
    docs = texts_of(stages["quality_rules"])
    drops = plain.line_drops(docs, line_dedup.MIN_WORDS)
    want = {}
    for doc_id, text in docs.items():
        if doc_id in drops:
            text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drops[doc_id])
        if doc_id not in drops or plain.WORDS.search(text):
            want[doc_id] = text
    assert texts_of(stages["line_dedup"]) == want


def test_near_duplicates(stages):
    docs = texts_of(stages["line_dedup"])
    ids = list(docs)
    groups = plain.components([plain.fingerprint(t) for t in docs.values()], 4)
    assert texts_of(stages["simhash_near_dedup"]) == {ids[c]: docs[ids[c]] for c in set(groups)}


def test_decontamination(spark, sf_dir, stages):
    docs = texts_of(stages["simhash_near_dedup"])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = texts_of(stages["decontamination"])
    n_hit = 0
    for doc_id, text in docs.items():
        hit, n = plain.hit_words(text, items)
        if len(hit) > decontaminate.MAX_COVERAGE * n:
            assert doc_id not in got
            continue
        words = plain.ITEM_WORDS.findall(plain.lower_ascii(text))
        left = [w for i, w in enumerate(words) if i not in hit]
        assert plain.ITEM_WORDS.findall(plain.lower_ascii(got.pop(doc_id))) == left
        n_hit += bool(hit)
    assert not got or set(got) <= set()
    assert n_hit


def test_packing(stages):
    docs, own = texts_of(stages["decontamination"]), tokens.word_bpe()
    parts: dict = {}
    for r in stages["packing"].collect():
        assert len(r.ids) == r.length
        parts.setdefault(r.doc_id, {})[r.start] = r.ids
    assert set(parts) == set(docs)
    for doc_id, text in docs.items():
        assert [i for _, ids in sorted(parts[doc_id].items()) for i in ids] == own.document(text).tolist()
