"""Secret scan: three base patterns, and a linear-chain conditional random field that tags tokens.

The field tags white-space separated tokens as begin, inside or outside of a secret, from their shape, two neighbours on
each side and features of the file. It is trained on a bounded sample of documents in which the base patterns mark the secrets.
Since it is to find what the patterns do not, each such secret is also shown in forms that no pattern reads: its name hidden or
another one, its sign another one, its value in another alphabet, within a URL or alone. Texts without secrets
give windows at any place, at tokens with digits, and with names of secrets that nothing follows. Of held-out windows without
secrets none may be tagged: `outside` gets the margin that needs. Texts are decoded line by line with Viterbi. Lines in which every token speaks for `outside` by more than the transitions of any
other path can gain need no decoding: their best path is known.

Base spans always stay; spans of the field that meet a base span are left out. Spans are in code points, the end is
exclusive. Nulls and empty texts have no spans; every row is scanned by its text alone. If the sample holds no
secret, the field adds none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm.scratch import store

KINDS = ("assign", "access", "hex", "crf")
#: Documents expected in the training sample, and the most windows of each kind taken from it.
TRAINING_DOCS = 16_000
TRAINING_WINDOWS = 1_500
WINDOW_TOKENS = 24

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_CLASS = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base patterns. The cheap tests before them only skip texts that cannot match."""
    if not text:
        return []
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode().translate(_HEX_CLASS):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(spans)


# -- features ----------------------------------------------------------------------------------------------------

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_NAMES = re.compile(r"pass(word|wd|phrase)?\b|pwd|secret|token|api_?key|credential|bearer|auth", re.IGNORECASE | re.ASCII)
_LENGTHS = (4, 8, 12, 16, 20, 32, 64)
_SHARES = (0.001, 0.15, 0.35, 0.6)
_CHANGES = (1, 2, 4, 8)
#: own features: length, kinds of characters, share of digits, changes between kinds, name of a secret, quoted, assigns
_OWN = len(_LENGTHS) + 1 + 16 + len(_SHARES) + 1 + len(_CHANGES) + 1 + 3
#: what a token is to its neighbours: nothing, name, assignment sign, name with sign, has digits, any other
_ROLES = 6
_FILE = 3
#: places of the neighbours whose roles are features
_NEAR = (-1, 1, -2, 2)
_OF_FILE = _OWN + len(_NEAR) * _ROLES
_N_FEATURES = _OF_FILE + _FILE
_STRIPPED = "\"'`.,;:()[]{}<>!?"


def _step(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def _named(text: str) -> bool:
    """Whether a text names secrets; every name has a part that is quickly looked for."""
    t = text.lower()
    if not ("pass" in t or "pwd" in t or "secret" in t or "token" in t or "api" in t or "credential" in t or "bearer" in t
            or "auth" in t):
        return False
    return bool(_NAMES.search(text))


class _ShapeTable(dict):
    """Code point -> a, A or 0 for letters and digits, itself otherwise; filled as code points are met."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        self[point] = out = "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else char
        return out


_SHAPE = _ShapeTable()


@lru_cache(maxsize=100_000)
def _shape_features(shape: str) -> tuple[tuple[int, ...], bool, bool]:
    """Indexes of the features that the shape decides, whether it assigns something, whether it has digits."""
    core = shape.strip(_STRIPPED) or shape
    kinds = ["aA0".find(c) % 4 for c in core]
    digits = kinds.count(2) / len(kinds)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    at, found = 0, []
    for value, width in (
        (_step(len(core), _LENGTHS), len(_LENGTHS) + 1), (sum(1 << k for k in set(kinds)), 16),
        (_step(digits, _SHARES), len(_SHARES) + 1), (_step(changes, _CHANGES), len(_CHANGES) + 1),
    ):
        found.append(at + value)
        at += width
    found += [at + 1] * (shape[0] in "\"'`") + [at + 2] * ("=" in core[1:-1] or ":" in core[1:-1])
    return tuple(found), shape[-1] in "=:" or shape == "=>", digits > 0


def own_features(token: str) -> tuple[tuple[int, ...], int]:
    """Indexes of a token's own features, and its role."""
    found, sign, digits = _shape_features(token.translate(_SHAPE))
    if _named(token):
        return (*found, _OWN - 3), 3 if sign else 1
    return found, 2 if sign else 4 if digits else 5


def file_features(text: str) -> list[int]:
    """Whether the file assigns, names secrets, has an access key mark."""
    return [i for i, on in enumerate(("=" in text, _named(text), "AKIA" in text)) if on]


# -- the field ---------------------------------------------------------------------------------------------------

class Crf(NamedTuple):
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label x next label
    first: np.ndarray

    def gain(self) -> float:
        """The most a token outside of `outside` can gain by transitions, on average over its run."""
        moves, stay = self.moves, self.moves[OUTSIDE, OUTSIDE]
        enter = max(moves[OUTSIDE, BEGIN], self.first[BEGIN] - self.first[OUTSIDE] + stay)
        run = enter + max(moves[BEGIN, OUTSIDE], moves[INSIDE, OUTSIDE], stay) - 2 * stay
        return max(0.0, run, moves[BEGIN:, BEGIN:].max() - stay)


def _design(tokens: list[str], begin: int, end: int, of_file: list[int]) -> np.ndarray:
    """Feature rows of tokens begin..end of a text."""
    out = np.zeros((end - begin, _N_FEATURES), np.float32)
    for n in range(begin, end):
        out[n - begin, list(own_features(tokens[n])[0])] = 1
        for k, step in enumerate(_NEAR):
            near = own_features(tokens[n + step])[1] if 0 <= n + step < len(tokens) else 0
            out[n - begin, _OWN + k * _ROLES + near] = 1
        out[n - begin, [_OF_FILE + f for f in of_file]] = 1
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(sequences: list[tuple[list[str], int, int, list[int], list[int]]], rounds: int = 120, rate: float = 0.15,
          ridge: float = 0.02) -> Crf | None:
    """Fit by gradient ascent (Adam) on the likelihood; a sequence is (tokens, begin, end, file features, labels)."""
    if not any(BEGIN in labels for *_, labels in sequences):
        return None
    size, steps = len(sequences), max(len(labels) for *_, labels in sequences)
    x = np.zeros((size, steps, _N_FEATURES), np.float32)
    gold, mask = np.zeros((size, steps), int), np.zeros((size, steps), bool)
    for n, (tokens, begin, end, of_file, labels) in enumerate(sequences):
        x[n, : end - begin] = _design(tokens, begin, end, of_file)
        gold[n, : len(labels)], mask[n, : len(labels)] = labels, True
    one_hot = np.eye(3)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    gold_moves = np.einsum("nti,ntj->ij", one_hot[:, :-1], one_hot[:, 1:] * pairs[..., None])
    banned = np.zeros((3, 3))
    banned[OUTSIDE, INSIDE] = -1e4  # a secret begins before it goes on
    ban_first = np.array([0.0, 0.0, -1e4])
    params = [np.zeros((_N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)]
    mean, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    flat = x.reshape(-1, _N_FEATURES)
    for turn in range(1, rounds + 1):
        moves, first = params[1] + banned, params[2] + ban_first
        emit = (flat @ params[0].astype(np.float32)).reshape(size, steps, 3).astype(float)
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, steps):
            step = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = _log_sum(ahead[:, -1], 1)
        for t in range(steps - 2, -1, -1):
            step = _log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        # beyond a sequence's end `ahead` repeats its last value, so that `back` there is 0
        own = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        joint = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * pairs[..., None, None]).sum((0, 1))
        slopes = [
            (flat.T @ (one_hot - own).reshape(-1, 3).astype(np.float32)) - ridge * size * params[0] / 100,
            gold_moves - expected - ridge * size * params[1] / 100,
            (one_hot - own)[:, 0].sum(0) - ridge * size * params[2] / 100,
        ]
        for p, g, m, v in zip(params, slopes, mean, spread):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Crf(params[0], params[1] + banned, params[2] + ban_first)


def viterbi(emit: np.ndarray, crf: Crf) -> list[int]:
    """Best labels of one sequence."""
    moves, score = crf.moves.tolist(), (emit[0] + crf.first).tolist()
    back: list[tuple[int, ...]] = []
    for row in emit[1:].tolist():
        best = [max((score[i] + moves[i][j], -i) for i in range(3)) for j in range(3)]
        back.append(tuple(-b[1] for b in best))
        score = [b[0] + e for b, e in zip(best, row)]
    labels = [max(range(3), key=lambda i: (score[i], -i))]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


class Tagger:
    """Decoder with a bounded table of the tokens seen."""

    def __init__(self, crf: Crf, bound: int = 300_000):
        self.crf, self.bound, self.gain = crf, bound, crf.gain()
        self.near = [crf.weights[_OWN + k * _ROLES : _OWN + (k + 1) * _ROLES] for k in range(len(_NEAR))]
        self.emissions: dict[tuple[int, ...], np.ndarray] = {}
        self._clear(bound)

    def _clear(self, size: int) -> None:
        self.places: dict[str, int] = {}
        self.own, self.role = np.zeros((size, 3)), np.zeros(size, np.int8)

    def _look_up(self, tokens: list[str]) -> np.ndarray:
        if len(self.places) + len(tokens) > len(self.role):
            self._clear(max(self.bound, len(tokens)))
        find = self.places.get
        ids = [find(t, -1) for t in tokens]
        if -1 in ids:
            for n, at in enumerate(ids):
                if at < 0:
                    at = self.places.get(tokens[n], -1)
                    if at < 0:
                        at = self.places[tokens[n]] = len(self.places)
                        found, self.role[at] = own_features(tokens[n])
                        self.own[at] = self._emission(found)
                    ids[n] = at
        return np.array(ids, np.int64)

    def _emission(self, found: tuple[int, ...]) -> np.ndarray:
        known = self.emissions.get(found)
        if known is None:
            known = self.emissions[found] = self.crf.weights[list(found)].sum(0)
        return known

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Spans of the field in one text."""
        tokens = text.split() if text else []
        if not tokens:
            return []
        ids = self._look_up(tokens)
        role = np.zeros(len(ids) + 4, np.int8)
        role[2:-2] = self.role[ids]
        emit = self.own[ids] + self.crf.weights[[_OF_FILE + f for f in file_features(text)]].sum(0)
        for step, weights in zip(_NEAR, self.near):
            emit += weights[role[2 + step : 2 + step + len(ids)]]
        open_tokens = np.flatnonzero(emit[:, OUTSIDE] - emit[:, 1:].max(1) <= self.gain)
        if not len(open_tokens):
            return []
        out, first, at = [], 0, 0
        for line in text.split("\n"):
            end = first + len(line.split())
            lo, hi = np.searchsorted(open_tokens, (first, end))
            if hi > lo:
                out += self._line_spans(line, at, viterbi(emit[first:end], self.crf))
            first, at = end, at + len(line) + 1
        return out

    @staticmethod
    def _line_spans(line: str, at: int, labels: list[int]) -> list[tuple[int, int]]:
        out, begin, end = [], None, 0
        for match, label in zip([*re.finditer(r"\S+", line), None], [*labels, OUTSIDE]):
            if label != INSIDE and begin is not None:
                text = line[begin:end]
                left = begin + len(text) - len(text.lstrip(_STRIPPED))
                right = begin + len(text.rstrip(_STRIPPED))
                out += [(at + left, at + right)] if right > left else []
                begin = None
            if label != OUTSIDE:
                begin = match.start() if begin is None else begin
                end = match.end()
        return out


# -- jobs --------------------------------------------------------------------------------------------------------

#: Forms a known secret is also shown in, with the labels of their tokens: `n` a name, `w` a word of the text, `v` the value.
_FORMS = (
    ("{w} = \"{v}\"", "001"), ("{n} is {v}", "122"), ("{n} -> {v}", "122"), ("{n}: '{v}'", "12"), ("{n} {v}", "12"),
    ("{w}_{n}={v}", "1"), ("https://{w}:{v}@{w}.example/{w}", "1"), ("{v}", "1"),
)
_OTHER_NAMES = ("pwd", "passphrase", "credential", "auth", "bearer", "password", "secret", "token", "api_key", "pass")


def _value(seed: str) -> str:
    """A value by a hash: base64, letters and digits, upper-case hex, or like a password, of 9 to 44 characters."""
    raw = hashlib.sha256(seed.encode()).digest()
    text = base64.b64encode(raw).decode()
    plain = "".join(c for c in text if c.isalnum())
    return (text, plain[: 16 + raw[1] % 20], raw.hex().upper()[: 24 + raw[1] % 20], plain[:9 + raw[1] % 6] + "7")[raw[0] % 4]


def _disguised(tokens: list[str], lo: int, hi: int, seed: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """The window around a secret (tokens lo..hi) with the secret in each of the other forms: centre, tokens, labels."""
    left, right = tokens[max(lo - WINDOW_TOKENS // 2, 0) : lo], tokens[hi : hi + WINDOW_TOKENS // 2]
    words = [w for w in (t.strip(_STRIPPED) for t in left + right) if w.isalpha()] or ["it"]
    for n, (form, labels) in enumerate(_FORMS):
        mark = int(hashlib.sha1(f"{seed}{n}".encode()).hexdigest(), 16)
        name = _OTHER_NAMES[mark % len(_OTHER_NAMES)]
        name = (name, name.capitalize(), name.upper(), name)[mark // 16 % 4]
        shown = form.format(n=name, w=words[mark // 64 % len(words)], v=_value(f"{seed}{n}")).split()
        yield len(left), [*left, *shown, *right], [*[0] * len(left), *map(int, labels), *[0] * len(right)]


def _window(tokens: list[str], labels: list[int], centre: int) -> dict:
    begin = max(centre - WINDOW_TOKENS // 2, 0)
    end = min(begin + WINDOW_TOKENS, len(tokens))
    near = max(begin - 2, 0)
    return {"tokens": tokens[near : end + 2], "begin": begin - near, "end": end - near, "labels": labels[begin:end]}


#: kinds of training windows: clean at any place, secrets as they stand, in other forms, at digits, at names
_PLACE, _KNOWN, _OTHER_FORM, _DIGITS, _NAME = range(5)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: around each base span of a text, as it stands and in other forms, and at places its hash decides."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            if not text or not text.strip():
                continue
            places = [m.span() for m in re.finditer(r"\S+", text)]
            tokens, spans = text.split(), base_spans(text)
            labels = [OUTSIDE] * len(tokens)
            starts = np.array([p[0] for p in places])
            digest = hashlib.sha1(text.encode()).hexdigest()
            mark, found = int(digest, 16), []
            for start, _, end in spans:
                lo = max(int(np.searchsorted(starts, start, "right")) - 1, 0)
                hi = int(np.searchsorted(starts, end, "left"))
                if any(labels[lo:hi]):
                    continue
                labels[lo:hi] = [BEGIN, *[INSIDE] * (hi - lo - 1)]
                found += [(_OTHER_FORM, *x) for x in _disguised(tokens, lo, hi, f"{digest}{lo}")]
                found.append((_KNOWN, lo, tokens, labels))
            found.append((_PLACE, mark % len(tokens), tokens, labels))
            if not spans:
                digits = [n for n, t in enumerate(tokens) if any("0" <= c <= "9" for c in t)]
                if digits:
                    found.append((_DIGITS, digits[mark % len(digits)], tokens, labels))
                elif mark % 4 == 0:
                    at = mark // 4 % len(tokens)
                    named = [*tokens[max(at - 20, 0) : at], _OTHER_NAMES[mark % len(_OTHER_NAMES)], *tokens[at : at + 20]]
                    found.append((_NAME, min(at, 20), named, [OUTSIDE] * len(named)))
            for n, (kind, centre, own, tags) in enumerate(found):
                rows.append(_window(own, tags, centre) | {
                    "of_file": file_features(text if own is tokens else " ".join(own)), "kind": kind,
                    "rank": f"{digest}{centre:09d}{n:06d}",
                })
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("tokens", pa.list_(pa.string())), ("begin", pa.int32()), ("end", pa.int32()),
            ("of_file", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("kind", pa.int32()),
            ("rank", pa.string())]))


def _with_margin(crf: Crf, clean: Sequence[tuple]) -> Crf:
    """The field with the least margin for `outside` that leaves windows without secrets untagged."""
    emits = [_design(tokens, begin, end, of_file) @ crf.weights for tokens, begin, end, of_file, _ in clean]
    margin = 0.0
    while margin < 16 and any(any(viterbi(e + [margin, 0, 0], crf)) for e in emits):
        margin += 1.0
    weights = crf.weights.copy()
    weights[: len(_LENGTHS) + 1, OUTSIDE] += margin  # each token has exactly one length
    return crf._replace(weights=weights)


def fit(documents: DataFrame, docs: int = TRAINING_DOCS, windows: int = TRAINING_WINDOWS) -> Crf | None:
    """Train on the texts of about `docs` documents that a hash chooses, each once, and at most `windows` windows of each kind.

    A fifth of the windows without secrets is held out for the margin.
    """
    total = documents.count()
    share = int(min(1.0, docs / max(total, 1)) * 1_000_000)
    chosen = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share
    sample = documents.select("text").where(chosen).distinct()  # copies would crowd out other texts
    found = store(sample.mapInArrow(
        _windows, "tokens array<string>, begin int, end int, of_file array<int>, labels array<int>, kind int, rank string"
    ), "secret-windows")
    rows = []
    for kind in range(5):  # bounded by `windows`
        rows += found.where(F.col("kind") == kind).orderBy("rank").limit(windows).collect()
    rows.sort(key=lambda r: (r.rank, r.kind))
    taught, held = [], []
    for r in rows:
        clean = r.kind != _OTHER_FORM and not any(r.labels)
        aside = clean and int(r.rank[:4], 16) % 5 == 0
        (held if aside else taught).append((r.tokens, r.begin, r.end, list(r.of_file), list(r.labels)))
    crf = train(taught)
    return crf and _with_margin(crf, held)


def apart(own: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """Those of the field's spans, which lie in order, that meet none of the base spans, in one pass over both."""
    out, n, reach = [], 0, 0
    for a, b in own:
        while n < len(spans) and spans[n][0] < b:
            reach = max(reach, spans[n][2])
            n += 1
        out += [(a, b)] if reach <= a else []
    return out


_taggers: dict[str, Tagger | None] = {}

SPANS = "spans array<struct<kind:string,start:int,end:int>>"


def _scanner(key: str, crf: Broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _taggers:
            _taggers.clear()
            _taggers[key] = Tagger(crf.value) if crf.value else None
        tagger = _taggers[key]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                if tagger:
                    spans += [(a, 3, b) for a, b in apart(tagger.spans(text), spans)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=batch.schema.names)

    return scan


def scan_secrets(documents: DataFrame, crf: Crf | None) -> DataFrame:
    """Documents with their `spans`, which replace a column of this name, by start and kind."""
    frame = documents.drop("spans").withColumn("spans", F.lit(None).cast(SPANS.split(" ", 1)[1]))
    shared = documents.sparkSession.sparkContext.broadcast(crf)
    return frame.mapInArrow(_scanner(uuid.uuid4().hex, shared), frame.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(documents, fit(documents))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
