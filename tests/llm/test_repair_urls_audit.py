"""Conversation repair, URL filters and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom.llm import auction, conversation_repair, filter_audit, url_filters
from threatloom.llm import queries as registered

# -- auction ------------------------------------------------------------------------------------------------------


def cheapest_by_search(turns):
    """Edits popped in order of cost and letters: the first that end in a legal conversation."""
    heap, bound = [(0, "", 0, 0)], 2 * len(turns)  # all deleted
    while True:
        cost, letters, at, state = heapq.heappop(heap)
        if at > len(turns):
            return cost, letters
        nexts = [(5, "I", at, auction.STEP[state, auction.WANTED[state]])]
        if at == len(turns) and state in (0, 3):
            nexts.append((0, "", at + 1, state))
        if at < len(turns):
            initial, more = turns[at].lower(), 5 if turns[at].isupper() else 0
            nexts.append((2, "D", at + 1, state))
            nexts.append((1 + more, "R", at + 1, auction.STEP[state, auction.WANTED[state]]))
            if (state, initial) in auction.STEP:
                nexts.append((more, "K", at + 1, auction.STEP[state, initial]))
        for step, letter, *place in nexts:
            if cost + step <= bound:
                heapq.heappush(heap, (cost + step, letters + letter, *place))


@settings(max_examples=300, deadline=None)
@given(st.text("suaxSUAX", max_size=8))
def test_edits_equal_a_search(turns):
    assert auction.cheapest_edits(turns) == cheapest_by_search(turns)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_change_nothing(size):
    rng = random.Random(size)
    for _ in range(200):
        turns = "".join(rng.choice("suaxUAuaua") for _ in range(rng.randint(0, 14)))
        blocks = [auction.block_edits(turns[i : i + size]) for i in range(0, len(turns), size)]
        cost, states = auction.route([b[:2] for b in blocks], 0, None)
        letters = "".join(b[2][s][t] for b, s, t in zip(blocks, states, states[1:])) + auction.END[states[-1]]
        assert (cost, letters) == auction.cheapest_edits(turns)


def test_prices_are_distances():
    turns = "uusaXaAu"
    arcs = auction._lattice(turns)
    goal = 4 * len(turns) + 3
    useful, price = auction._towards(arcs, goal), [0] * len(arcs)
    cost = auction.auction(useful, 0, goal, price)
    assert all(price[i] <= c + price[j] for i, out in enumerate(useful) for _, c, j in out)
    node, paid = 0, 0
    for letter in auction.traced(useful, 0, goal, price):
        _, step, node = next(arc for arc in useful[node] if arc[0] == letter)
        paid += step
    assert (node, paid) == (goal, cost) and cost == price[0]


# -- conversations ------------------------------------------------------------------------------------------------


def broken(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind, (_, _, role, text) = zlib.crc32(":".join(spaced[:2]).encode()) % 20, spaced
        held = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """Counts, cost, audit and digest of one conversation, by a table of the least (cost, audit) per state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen, best = Counter(), set(), {0: (0, "", ())}

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    def insertions(table):
        for state in (0, 1, 3, 2, 3):
            if state in table:
                cost, audit, kept = table[state]
                wanted = auction.WANTED[state]
                put(table, auction.STEP[state, wanted], (cost + 5, audit + "I", (*kept, auction.ROLE[wanted] + ":")))

    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
        faults[fault] += 1
        seen.add((role, text))
        insertions(best)
        after: dict = {}
        for state, (cost, audit, kept) in best.items():
            put(after, state, (cost + 2, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more, initial, wanted = 5 if fault else 0, role[:1], auction.WANTED[state]
            if (state, initial) in auction.STEP:
                put(after, auction.STEP[state, initial], (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            put(after, auction.STEP[state, wanted], (cost + more + 1, audit + "R", (*kept, f"{auction.ROLE[wanted]}:{text}")))
        best = after
    insertions(best)
    cost, audit, kept = min((best[s] for s in (0, 3) if s in best), key=lambda e: e[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)


def summaries_of(frame, **options):
    pieces = conversation_repair.repair(conversation_repair.damage(frame), **options)
    rows = conversation_repair.summaries(pieces).collect()
    return {None if r[0] == "n" else int(r[0][1:]): tuple(r)[1:] for r in rows}


TURNS = "conv_id long, turn long, role string, text string"


def test_query_equals_the_plain_version(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.query(spark, sf_dir).collect()}
    assert got == {conv: repaired(rows) for conv, rows in broken(map(tuple, table.collect())).items()}


@pytest.mark.parametrize("piece_rows", [2, 1024])
def test_a_long_conversation_in_pieces(spark, piece_rows):
    rng = random.Random(3)
    rows = [(7, i // 2, rng.choice(["system", "user", "assistant", "tool", "user"]), rng.choice(["a.", "b", "c!", " ", f"{i}?"]))
            for i in range(400)]
    rows += [(7, 500, "user", "the same.")] * 50 + [(8, i, "user", "hello.") for i in range(20)]
    rows += [(9, None, None, None), (9, None, "assistant", "x"), (None, 1, "user", "no id."), (None, None, "", "\t")]
    frame = spark.createDataFrame(rows, TURNS).repartition(8)
    got = summaries_of(frame.withColumn("th", F.lit("own")), piece_rows=piece_rows)
    assert got == {conv: repaired(held) for conv, held in broken(rows).items()}


def test_dropped_and_empty_conversations(spark):
    lost = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = summaries_of(spark.createDataFrame([(lost, 0, "user", "a.")], TURNS))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert summaries_of(spark.createDataFrame([], TURNS)) == {}


def test_repaired_turns_are_legal(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate(
        [("system", "s."), ("user", "u"), ("user", "v."), ("assistant", "a."), ("assistant", "a.")][c % 3 :])]
    pieces = conversation_repair.repair(spark.createDataFrame(rows, TURNS)).collect()
    by_conversation = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.conversation, p.part, p.piece)):
        by_conversation[p.conversation] += [t.role[0] for t in p.repaired]
    assert len(by_conversation) == 30
    assert all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in by_conversation.values())


# -- URLs ---------------------------------------------------------------------------------------------------------

URLS = [
    "https://example.org/en/123", "https://EXAMPLE.org/EN/123", "http://a.b.example.org/es/x?y=/fr/", "https://x.org", "x.org/",
    "https://x.org/", "ftp://de.com/de/1", "https://www.com/fr/", "https://notexample.org/es/", None, "", "://", "a://b://c/de/",
    "https://u@example.org:80/es/", "https://com/de/#/fr/", "https://a.com?/de/", "https://.org/", "https://example.org./es/",
    "mailto:x", "https://é.example.org/en/1\n2", "https://a..com/de/x", "https://" + "a." * 3000 + "com/de/",
]


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


@pytest.mark.parametrize("few", [True, False])
def test_urls_equal_the_plain_version(spark, few, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 1000 if few else 0)
    rules = [*url_filters.RULES, ("block", "com", ""), ("allow", "x.org", "/"), ("block", "x.org", "/"), ("allow", "a.b.example.org", "/es")]
    rows = [(n, url, "own") for n, url in enumerate(URLS * 2)] + [(None, "https://x.org/", "own")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string")
    table = spark.createDataFrame([*rules, (None, "org", "/"), ("block", None, "/")], "verdict string, host string, path string")
    got = [tuple(r) for r in url_filters.judge_urls(pages, table).select("page_id", *url_filters.RESULT).collect()]
    assert Counter(got) == Counter((n, *judged(url, rules)) for n, url, _ in rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.org/")], "page_id long, url string")
    none = url_filters.rule_table(spark).limit(0)
    assert [tuple(r) for r in url_filters.judge_urls(pages, none, default="block").collect()] == [
        (1, "https://a.org/", "a.org", "/", None, "block")]
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark)).collect() == []


# -- filter audit -------------------------------------------------------------------------------------------------


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper = sum("A" <= c <= "Z" for c in text)
    return "".join(letter for letter, fails in zip("ABCD", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text),
        bool(re.search("[#$%&*|]", text)))) if fails)


def audited(rows, good, toxic):
    """(part, order, step) -> the seven counts, by applying the filters document by document."""
    first: dict = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        text = text or ""
        fails = set(failures(text)) | ({"E"} if doc_id is not None and doc_id > first[text] else set())
        parts[lang or ""].append((fails, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                failing = sum(letter in d[0] for d in docs)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(d[0] == {letter} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
                sums[letter] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def audit_of(documents, labels):
    table = filter_audit.audit(filter_audit.coalition_removals(filter_audit.failure_counts(documents, labels)))
    return {tuple(r)[:3]: list(r)[3:] for r in table.collect()}


def test_audit_equals_the_plain_version(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, n)) + end for n in (20, 100, 130) for end in ("", " #", " ABCDEFG" * 30)]
    texts += [None, "", " \t", "a " * 120, " ".join(words * 3), "É" * 9 + "A", "x " * 99 + "\x1c" + "y"]
    rows = [(n % 40, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for n in range(150)]
    rows += [(None, texts[1], "en")] * 3 + [(200 + n, "copy", "de") for n in range(40)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 0, None), (None, 1, 1), (200, 1, 1), (39, 1, 0), (239, 1, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("own"))
    got = audit_of(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    assert got == audited(rows, good, toxic)


def test_audit_of_an_empty_table(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_of(documents, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == {}


@pytest.mark.parametrize("filters", [2, 3, 5])
def test_least_squares_gives_shapley_values(filters):
    rng = random.Random(filters)
    worth = [0] + [rng.randint(0, 50) for _ in range((1 << filters) - 1)]
    want = [Fraction(0)] * filters
    for order in itertools.permutations(range(filters)):
        before = 0
        for i in order:
            want[i] += Fraction(worth[before | 1 << i] - worth[before], factorial(filters))
            before |= 1 << i
    got = [sum(c * w for c, w in zip(row, worth)) for row in filter_audit.shapley_coefficients(filters)]
    assert got == want


# -- SQL ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_url_filters", "op13_filter_audit"])
def test_query_agrees_with_sql(spark, sf_dir, name, monkeypatch):
    import check_oracles

    monkeypatch.setitem(check_oracles.QUERIES, name, registered.QUERIES[name])
    monkeypatch.setitem(check_oracles.ORACLES, name, registered.ORACLES[name])
    assert check_oracles.compare(spark, check_oracles.duck(sf_dir), name, sf_dir) is None
