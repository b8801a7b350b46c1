"""Function extraction over a corpus of source texts.

Finding the closing brace needs a walk over the text, so files go through
a small Python helper in `mapInArrow`; files are independent and never leave
their partition. Only the columns needed are sent to it. For labelled functions
lines and braces are found in slices of many texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threatloom.constants import LABELLED_HEADER
from threatloom.functions.text import label_from_name, long_enough
from threatloom.operators.embed import text_list, text_slices

_LABELLED = re.compile(LABELLED_HEADER, re.MULTILINE | re.IGNORECASE)
_BRACE = re.compile(r"[{}]")
#: ASCII white space becomes 1, a first letter of the types before a labelled name 2; the beginnings of these types.
_CLASSES = bytes(1 if chr(byte).isspace() else 2 if byte in b"VICSvics" else 0 for byte in range(128)) + bytes(128)
_TYPES = [int.from_bytes(word, "little") for word in (b"void", b"char", b"stat")]
_INT = int.from_bytes(b"int", "little")
#: Bytes of text looked at at once.
_SLICE_BYTES = 1 << 18

# Comments, preprocessor lines and literals: braces in them do not count. A literal may lack its end.
_NOT_CODE_START = re.compile(r"""[/"'#]""")
_COMMENT = re.compile(r"/(?:/(?:\\\n|[^\n])*|\*.*?(?:\*/|\Z))", re.DOTALL)
_DIRECTIVE = re.compile(r"#(?:\\\r?\n|[^\n])*")
_LITERALS = {
    '"': re.compile(r'"(?:\\.|[^"\\\n])*("?)', re.DOTALL),
    "'": re.compile(r"'(?:\\.|[^'\\\n])*('?)", re.DOTALL),
}
# What may stand in a header besides specifiers, name and parameters.
_HEADER_TOKEN = re.compile(r"\b(?:__attribute__|__declspec|alignas|_Alignas)\s*\(|\[\[|[()<>]")
_AFTER = re.compile(r"\s*(?:(?:const|volatile|noexcept|override|final)\b\s*)*")
_NAME = re.compile(r"(?<![\w:*&])[A-Za-z_]\w*\Z")
_PAREN = re.compile(r"[()]")
_NOT_NEWLINE = re.compile(r"[^\n]")
_MARKED = re.compile(r"<|\[\[|__attribute__|__declspec|alignas|_Alignas")
_NO_SPECIFIER = frozenset("()*&=,:#~[]<>+-/!?|^%.")
# Headers as most are, which need no closer look: words, a name and plain parameters, and statements with a condition.
_PLAIN = re.compile(r"\s*((?:[A-Za-z_]\w*\s+)+)([A-Za-z_]\w*)\s*\([^()<\[]*\)\s*\Z")
_STATEMENT = re.compile(r"\s*(?:if|for|while|switch)\s*\([^()\[]*\)\s*\Z")
_KEYWORDS = frozenset(("if", "for", "while", "switch", "return", "else", "do", "sizeof", "case"))

#: Texts -> place of a text and what is found in it, in order.
Finder = Callable[[pa.Array], Iterable[tuple[int, tuple]]]


def spans(files: DataFrame, finder: Finder, found: T.StructType, *, text: str = "text", carry: Sequence[str]) -> DataFrame:
    """Apply `finder` to all texts; each tuple it yields becomes a row next to the carried columns of its text."""
    source = files.select(*carry, text)
    schema = T.StructType([*[source.schema[c] for c in carry], *found.fields])
    types = to_arrow_schema(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, origin = [], []
            for at, hit in finder(batch.column(text)):
                rows.append(hit)
                origin.append(at)
            if rows:
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), types.types)]
                carried = batch.select(list(carry)).take(pa.array(origin))
                yield pa.RecordBatch.from_arrays([*carried.columns, *columns], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def one_by_one(finder: Callable[[str], Iterable[tuple]]) -> Finder:
    """A finder that looks at each text by itself."""

    def find(texts: pa.Array) -> Iterator[tuple[int, tuple]]:
        for at, value in enumerate(texts.to_pylist()):
            for hit in finder(value) if value else ():
                yield at, hit

    return find


def closing_braces(text: str) -> dict[int, int]:
    """Position of each opening brace that is closed -> position of its closing brace."""
    partner, still_open = {}, []
    for brace in _BRACE.finditer(text):
        if brace.group() == "{":
            still_open.append(brace.start())
        elif still_open:
            partner[still_open.pop()] = brace.start()
    return partner


def _labelled_spans(text: str) -> Iterator[tuple]:
    partner, last_end = None, 0
    for header in _LABELLED.finditer(text):
        opening = text.find("{", header.start())
        if opening < 0:
            return
        if partner is None:
            partner = closing_braces(text)
        start = _blank_lines_before(text, header.start(), last_end)
        last_end = header.end()
        # an unbalanced body leaves only the header text
        end = partner[opening] + 1 if opening in partner else opening
        yield header.group(1), text[start:end].strip(), start


def _blank_lines_before(text: str, start: int, last_end: int) -> int:
    """Where a header begins: with the blank lines before it."""
    if start - last_end > 1 and not text[start - 2].isspace():
        return start
    blank = len(text[last_end:start].rstrip()) + last_end
    if blank < start:
        start = blank if blank == 0 or text[blank - 1] == "\n" else text.index("\n", blank, start) + 1
    return start


def _labelled_in(texts: pa.Array) -> Iterator[tuple[int, tuple]]:
    """The labelled functions of all texts, as `_labelled_spans` finds them in each."""
    at = -1
    for part in text_slices(texts, _SLICE_BYTES):
        values = [value or "" for value in text_list(part)]
        ends = np.cumsum([0, *map(len, values)])
        data = "".join(values).encode("ascii", "replace")
        lines = _header_lines(data, ends[:-1])
        of_text = np.searchsorted(lines, ends).tolist()
        lines = lines.tolist()
        partner = _partners(data, ends[:-1]) if lines else {}
        for value, begin, first, last in zip(values, ends.tolist(), of_text, of_text[1:]):
            at += 1
            if not value.isascii():
                for hit in _labelled_spans(value):
                    yield at, hit
                continue
            last_end = 0
            for line in lines[first:last]:
                line -= begin
                header = _LABELLED.match(value, line) if line >= last_end else None
                if header is None:
                    continue
                opening = value.find("{", line)
                if opening < 0:
                    break
                start = _blank_lines_before(value, line, last_end)
                last_end = header.end()
                end = partner.get(begin + opening, begin + opening - 1) + 1 - begin
                yield at, (header.group(1), value[start:end].strip(), start)


def _header_lines(texts: bytes, begins: np.ndarray) -> np.ndarray:
    """Where the lines begin that hold a word which begins like a type, in ASCII texts that begin at some places.

    The pattern tells whether a header begins there.
    """
    data = np.frombuffer(texts + b"\0" * 4, np.uint8)
    kinds = np.frombuffer(texts.translate(_CLASSES), np.uint8)
    starts = np.ones(len(texts), bool)
    starts[1:] = kinds[:-1] == 1
    starts[begins[begins < len(texts)]] = True
    words = np.flatnonzero(starts & (kinds == 2))
    head = np.zeros(len(words), np.uint32)
    for place in range(4):
        head |= (data[words + place] | 32).astype(np.uint32) << np.uint32(8 * place)
    words = words[np.isin(head, _TYPES) | (head & 0xFFFFFF == _INT)]
    text = begins[np.searchsorted(begins, words, "right") - 1]
    newlines = np.concatenate(([-1], np.flatnonzero(data == 10)))
    return np.unique(np.maximum(newlines[np.searchsorted(newlines, words) - 1] + 1, text))


def _partners(texts: bytes, begins: np.ndarray) -> dict[int, int]:
    """As `closing_braces`, over texts that begin at some places."""
    data = np.frombuffer(texts, np.uint8)
    braces = np.flatnonzero((data == 123) | (data == 125))
    step = np.where(data[braces] == 123, 1, -1)
    text = np.searchsorted(begins, braces, "right")
    depth = np.cumsum(step)
    # depth within the text; a brace that closes none reaches a new lowest depth and counts for nothing
    first = np.flatnonzero(np.diff(text, prepend=-1))
    depth -= np.repeat(depth[first] - step[first], np.diff(first, append=len(braces)))
    span = len(braces) + 1
    lowest = np.minimum(np.minimum.accumulate(depth - 2 * span * text) + 2 * span * text, 0)
    before = np.concatenate(([0], lowest[:-1]))[: len(lowest)]
    before[first] = 0
    closes = lowest == before
    braces, step, key = braces[closes], step[closes], (text * span + depth - lowest + (step < 0))[closes]
    # of one text and level, braces open and close in turn
    order = np.argsort(key, kind="stable")
    key, opens, place = key[order], step[order] > 0, braces[order]
    closed = np.flatnonzero(opens[:-1] & ~opens[1:] & (key[:-1] == key[1:]))
    return dict(zip(place[closed].tolist(), place[closed + 1].tolist()))


def labelled_functions(files: DataFrame, *, text: str = "text", carry: Sequence[str]) -> DataFrame:
    """Functions whose name says `bad` or `good`, with label and offset.

    The walker counts every brace, also those inside strings and comments.
    """
    found = T.StructType([
        T.StructField("function_name", T.StringType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("start_offset", T.LongType()),
    ])
    functions = spans(files, _labelled_in, found, text=text, carry=carry)
    return functions.select(
        *carry,
        "function_name",
        "code_snippet",
        label_from_name(F.col("function_name")).alias("label"),
        "start_offset",
    )


def _code_only(text: str) -> str:
    """The text with comments, preprocessor lines and literals blanked, places and line ends unchanged.

    One pass from left to right. What was scanned in vain is not scanned again: behind a literal without an end no quote of
    its kind can end one, and behind a word no `#` of the line begins a directive.
    """
    parts, done, at, worded, open_until = [], 0, 0, -1, {}
    while hit := _NOT_CODE_START.search(text, at):
        start, mark = hit.start(), hit.group()
        at = start + 1
        if mark == "/":
            found = _COMMENT.match(text, start)
        elif mark == "#":
            found = None
            if start > worded:
                if text[text.rfind("\n", 0, start) + 1 : start].strip(" \t"):
                    end = text.find("\n", start)
                    worded = end if end >= 0 else len(text)
                else:
                    found = _DIRECTIVE.match(text, start)
        elif start < open_until.get(mark, 0):
            found = None
        else:
            found = _LITERALS[mark].match(text, start)
            if not found.group(1):
                open_until[mark], found = found.end(), None
        if found:
            at = found.end()
            span = found.group()
            parts += text[done:start], _NOT_NEWLINE.sub(" ", span) if "\n" in span else " " * len(span)
            done = at
    return "".join([*parts, text[done:]]) if parts else text


def _groups(header: str) -> list[tuple[int, int]]:
    """Outermost parentheses of a header: opening and closing place, in order."""
    found, depth, opening = [], 0, 0
    for hit in _PAREN.finditer(header):
        if hit.group() == "(":
            opening = opening if depth else hit.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                found.append((opening, hit.start()))
    return found


def _without_attributes(header: str) -> str:
    """The header with attributes and template arguments blanked, places unchanged.

    One pass with a stack of open parentheses, which tells those of attributes, and the angle brackets open between them:
    template arguments hold no parentheses but those of attributes.
    """
    spans: list[tuple[int, int]] = []
    parens: list[tuple[int, list[int]] | None] = []
    angles: list[int] = []
    at, closed = 0, True
    while hit := _HEADER_TOKEN.search(header, at):
        token, at = hit.group(), hit.end()
        if token == "[[":
            end = header.find("]]", at) if closed else -1
            closed = end >= 0
            if closed:
                spans.append((hit.start(), end + 2))
                at = end + 2
        elif token == "<":
            angles.append(hit.start())
        elif token == ">":
            if angles:
                spans.append((angles.pop(), at))
        elif token == "(":
            parens.append(None)
            angles = []
        elif token == ")":
            attribute = parens.pop() if parens else None
            angles = []
            if attribute:
                start, angles = attribute
                spans.append((start, at))
        else:
            parens.append((hit.start(), angles))
            angles = []
    if not spans:
        return header
    # spans lie apart or within each other
    spans.sort()
    parts, done = [], 0
    for start, end in spans:
        if end > done:
            parts += header[done:start], " " * (end - max(start, done))
            done = end
    return "".join([*parts, header[done:]])


def _definition(header: str) -> tuple[str, int] | None:
    """Name and place of the first specifier of a function whose body begins after `header`."""
    if "(" not in header or _STATEMENT.match(header):
        return None
    plain = _PLAIN.match(header)
    if plain and not _MARKED.search(header):
        start = plain.start(1)
        if plain.group(2) in _KEYWORDS or header[start : plain.end(1)].split(None, 1)[0] in _KEYWORDS:
            return None
        return plain.group(2), start
    clean = _without_attributes(header) if _MARKED.search(header) else header
    groups = _groups(clean)
    if not groups or not _AFTER.fullmatch(clean, groups[-1][1] + 1):
        return None
    head = clean[: groups[-1][0]].rstrip()
    name = _NAME.search(head)
    if not name or name.group() in _KEYWORDS:
        return None
    # specifiers are words, perhaps with a scope; anything else ends what belongs to this definition
    specifiers = head[: name.start()].replace("::", "__")
    first = next((len(specifiers) - at for at, c in enumerate(reversed(specifiers)) if c in _NO_SPECIFIER), 0)
    words = specifiers[first:].split()
    if not words or words[0] in _KEYWORDS:
        return None
    return name.group(), first + len(specifiers[first:]) - len(specifiers[first:].lstrip())


def _function_spans(text: str) -> Iterator[tuple]:
    code_only = _code_only(text)
    found: list[list] = []  # name, start, place of the closing brace, in order of the opening braces
    opened: list[list | None] = []
    begin = 0
    # the texts between braces do not overlap, so each is looked at once
    for brace in _BRACE.finditer(code_only):
        at, definition = brace.start(), None
        if code_only[at] == "{":
            header_at = max(begin, code_only.rfind(";", begin, at) + 1)
            if named := _definition(code_only[header_at:at]):
                definition = [named[0], header_at + named[1], None]
                found.append(definition)
            opened.append(definition)
        elif opened and (definition := opened.pop()):
            definition[2] = at
        begin = at + 1
    line, counted_to = 1, 0
    for name, start, closing in found:
        if closing is not None:
            line += text.count("\n", counted_to, start)
            counted_to = start
            code = text[start:closing + 1]
            yield name, code, line, line + code.count("\n")


def all_functions(files: DataFrame, *, text: str = "text", path: str = "file_path") -> DataFrame:
    """Every function definition with a plain name: name, code, first and last line (from 1), file.

    An approximation of the C grammar: attributes, scoped result types and nested parameter lists are
    understood; definitions returning a pointer, methods, K&R parameter lists and macro-made definitions are not found. Functions
    shorter than the minimum are dropped.
    """
    found = T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ])
    functions = spans(files, one_by_one(_function_spans), found, text=text, carry=[path])
    return functions.where(long_enough(F.col("code"))).select(
        "name", "code", "start_line", "end_line", F.col(path).alias("file_path")
    )
