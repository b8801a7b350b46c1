"""Archive packages, and what the classifiers learn."""

from __future__ import annotations

import hashlib
import io
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.llm import rule_ensemble, toxicity, warc
from threatloom.session import run_dir

LONG = "x" * 1200
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2\r\nX: y", LONG), (3, None, LONG), (4, "u", "short"), (5, "u", "short"),
    (6, "é", "é" * 700), (7, "u", None), (8, "u", ""), (9, "v", "é" * 700), (None, "w", "no id"), (4, "u", "short"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "id long, url string, text string")


def test_round_trip(spark, pages):
    manifest = warc.write_packages(pages.repartition(2), run_dir(spark, "warc"), package_bytes=500)
    assert manifest.count() > 2 and sum(r.records for r in manifest.collect()) == len(PAGES)
    rows = warc.read_records(warc.record_index(manifest)).collect()
    assert len(rows) == len(PAGES)
    last = {LONG: "3", "é" * 700: "9"}
    by_id = {r.record_id: r for r in rows}
    for page_id, url, text in PAGES:
        row = by_id[None if page_id is None else str(page_id)]
        payload = (text or "").encode()
        assert (row.payload_bytes, row.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = text in last and last[text] != str(page_id)
        assert row.record_type == ("revisit" if revisit else "response")
        assert row.refers_to == (last[text] if revisit else None)
        assert row.payload == (None if revisit else payload)
        assert row.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_packages_are_zip_files(spark, pages):
    [row] = warc.write_packages(pages.coalesce(1), run_dir(spark, "warc")).collect()
    data = open(row.package.removeprefix("file://").removeprefix("file:"), "rb").read()
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        assert package.testzip() is None and package.namelist() == [warc.ARCHIVE, warc.INDEX]
        assert {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}
        members = warc.stored_members(row.package)
        for name, member in members.items():
            assert data[member.offset : member.offset + member.size] == package.read(name)


def test_foreign_packages(tmp_path):
    """A plain ZIP with a comment, other members and no index."""
    records = [warc.gzip_member(warc.warc_record(str(i), "u", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None)) for i in range(5)]
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("pages/pages.jsonl", "{}" * 500, zipfile.ZIP_DEFLATED)
        package.writestr("archive/one.warc.gz", b"".join(records[:3]), zipfile.ZIP_STORED)
        package.writestr("archive/two.warc.gz", b"".join(records[3:]), zipfile.ZIP_STORED)
        package.comment = b"PK\x05\x06 in a comment"
    found = [warc.parse_record(zlib.decompress(warc.read_range(path, a, n), 31)) for a, n in warc.package_entries(path)]
    assert [r["record_id"] for r in found] == list("01234") and [len(r["payload"]) for r in found] == [0, 1, 2, 3, 4]


def _package(path, name, data, how=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w") as package:
        package.writestr(name, data, how)
    return str(path)


def _records(sizes):
    return [warc.warc_record(str(i), "u", b"p" * n, hashlib.sha1(b"p" * n).hexdigest(), None) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("range_bytes", [64, 700, 4 << 20])
def test_plain_archives(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(warc, "RANGE_BYTES", range_bytes)
    sizes = [0, 1, 5000, 3, 700]
    path = _package(tmp_path / "plain.wacz", "archive/a.warc", b"".join(_records(sizes)))
    rows = warc.read_records(warc.record_index(spark.createDataFrame([(path,)], "package string"))).collect()
    assert sorted((r.record_id, len(r.payload)) for r in rows) == [(str(i), n) for i, n in enumerate(sizes)]


def test_archives_that_lose_records_raise(tmp_path):
    plain, packed = b"".join(_records([10, 2000])), b"".join(map(warc.gzip_member, _records([10, 2000])))
    for name, data, how, message in [
        ("archive/a.warc.gz", packed, zipfile.ZIP_DEFLATED, "compressed"), ("archive/a.warc", plain, zipfile.ZIP_DEFLATED, "compressed"),
        ("archive/a.warc.gz", packed[:-9], zipfile.ZIP_STORED, "cut off"), ("archive/a.warc", plain[:-9], zipfile.ZIP_STORED, "cut off"),
        ("archive/a.warc", plain + b"tail", zipfile.ZIP_STORED, "no record"),
    ]:
        path = _package(tmp_path / "lossy.wacz", name, data, how)
        with pytest.raises(ValueError, match=f"lossy.wacz.*{message}"):
            list(warc.package_entries(path))


def test_own_columns_of_pages(spark, pages):
    clashing = pages.selectExpr("*", "'x' AS refers_to", "'y' AS digest", "1 AS _bytes", "2 AS _n")
    manifest = warc.write_packages(clashing, run_dir(spark, "warc"))
    rows = warc.read_records(warc.record_index(manifest)).collect()
    assert len(rows) == len(PAGES) and {r.refers_to for r in rows} == {None, "3", "9"}


@pytest.mark.parametrize("data", [b"", b"no zip at all, but long enough to look for the end record"])
def test_broken_packages(tmp_path, data):
    path = tmp_path / "broken.zip"
    path.write_bytes(data)
    with pytest.raises(ValueError, match="broken.zip"):
        list(warc.package_entries(str(path)))


def test_empty_pages(spark, pages):
    manifest = warc.write_packages(pages.limit(0), run_dir(spark, "warc"))
    assert warc.read_records(warc.record_index(manifest)).count() == 0


# -- classifiers -------------------------------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("Stup1d ѕtuрid ＳＴＵＰＩＤ ștupíd $tup!d").split()[:4] == ["stupid"] * 4
    assert toxicity.fold(None) == ""


def test_exceptions_cover_hits():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 3.0}, {toxicity.fold("idio"): 2.0}, ("trash can",))
    matcher = toxicity.Matcher(lexicon)
    assert matcher.hits("a trash can")[0] == 0 and matcher.hits("a trash")[0] == 3.0
    assert matcher.hits("idiotic 1d1ots, tr4sh!")[0] == 7.0
    assert toxicity.Matcher(toxicity.Lexicon({}, {})).hits("anything")[0] == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abc", "ba", "cab", "bab", "c"]), max_size=30))
def test_hits_by_brute_force(words):
    lexicon = toxicity.Lexicon({"ab": 1.0, "cab": 2.0}, {"ba": 0.5, "ab": 0.25}, ("ab c", "c ab ba", "bab bab"))
    phrases = [p.split() for p in lexicon.exceptions]
    covered, total, hits = set(), 0.0, 0
    for i in range(len(words)):
        for p in phrases:
            covered |= set(range(i, i + len(p))) if words[i : i + len(p)] == p else set()
    for i, word in enumerate(words):
        weights = [lexicon.words[word]] if word in lexicon.words else []
        weights += [w for stem, w in lexicon.stems.items() if word.startswith(stem)]
        if weights and i not in covered:
            total, hits = total + max(weights), hits + 1
    got = toxicity.Matcher(lexicon).hits(" ".join(words))
    assert (got[0], got[1], len(got[2])) == (pytest.approx(total), len(words), hits)


def test_many_phrases_in_one_text():
    matcher = toxicity.Matcher(toxicity.Lexicon({toxicity.fold("trash"): 3.0}, {}, ("trash can",)))
    began = time.monotonic()
    assert matcher.hits("trash can " * 100_000 + "trash")[0] == 3.0
    assert time.monotonic() - began < 20  # hours if each hit met each phrase


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (rule_ensemble, "quality")])
def test_held_out(spark, module, label):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = module.query(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.label for r in rows) / len(rows) >= 0.9
