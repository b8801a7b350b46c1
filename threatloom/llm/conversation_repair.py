"""Conversation repair: the cheapest edits that give every conversation the form system?, (user, assistant)+, or nothing.

Faults: a turn is blank, or repeats the role and text of an earlier one, or its last character does not end a sentence.
Blank and repeated turns are deleted; for the rest `auction` finds the cheapest of keep, rerole, delete and insert.

1. Equal rows are counted, which is the only step in which a frequent row could meet one task, and is combined before its
   shuffle. The first place of each role and text in a conversation is an aggregate of hashes; it goes through the next
   shuffle as a row of its own, beside the row it marks, so that no join gathers what is said often.
2. Rows are dealt by ranges of (conversation, turn, role, text hash), so that a conversation of any length lies in pieces in
   neighbouring tasks. A task solves conversations that lie wholly within it and fit one piece.
3. The first and last of a task, and long ones, give pieces of at most `PIECE_ROWS` rows or `PIECE_CHARS` characters with
   the least costs between all grammar states. These are chained per task and conversation, then per conversation, which
   gives the states at every end; then each piece is traced by itself. Nothing holds more than a piece, or a few numbers
   for each piece of one task, or for each task.

The result is in pieces (`conversation`, `part`, `piece`), most conversations in one, with `alone` true; `conversation` is
the id as text after `v`, or `n` for a null id.

Nulls in role and text are one space, so such a text is blank and such a role is no legal one; null turns come first and
count for no gap; turns of one number are in order of role and of the text's md5. A row with `copies` 0 only names its
conversation, which then has a piece without turns. Further columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threatloom.llm import auction
from threatloom.llm.scratch import store

WHITE = " \t\n\x0b\f\r"
PIECE_ROWS = 1024
PIECE_CHARS = 1 << 20
LEGAL = frozenset(("su", "ua", "au"))
_NEVER = -1  # a cost that cannot be had, in stored tables

_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_LONG, _STR = T.LongType(), T.StringType()
_TURN = T.StructType([T.StructField("role", _STR), T.StructField("text", _STR)])


def damage(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, copies) broken on purpose, each by a hash of its id and turn: one in twenty is lost
    (`copies` 0), emptied, robbed of its sentence ends, doubled or made a user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their number, dealt and sorted; before a turn that no earlier one equals stands its mark."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    there = copies.cast("long") > 0
    named = turns.select(
        conversation_key(F.col("conv_id")).alias("conversation"),
        F.when(there, F.col("turn").cast("long")).alias("turn"), F.when(there, role).alias("role"),
        F.when(there, F.md5(text)).alias("th"), F.when(there, text).alias("text"), copies.cast("long").alias("copies"),
    )
    keys = ["conversation", "turn", "role", "th"]
    counted = named.groupBy(*keys).agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    rows = counted.select(*keys, F.lit(1).alias("kind"), "copies", end.alias("end"), "text")
    # nulls first, and min() leaves them out: a struct keeps them
    at = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at")
    marks = counted.where("copies > 0").groupBy("conversation", "role", "th").agg(at).select(
        "conversation", F.col("at.turn").alias("turn"), "role", "th", F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("text"),
    )
    return rows.unionByName(marks).repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")


class _Piece:
    """Turns of one conversation in a row, and what is counted of them."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str | None, str, int]] = []  # letter (or D), role, text, copies
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.chars = 0
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, end: str, copies: int, first: bool) -> None:
        counts, initial = self.counts, role[:1]
        if turn is not None and turn != self.last_turn:
            counts["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_initial is None:
            self.first_initial = initial
        else:
            counts["illegal"] += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        counts["rows"] += copies
        counts["illegal"] += copies - 1  # no role may follow itself
        if not end:
            counts["blank"] += copies
            self.rows.append(("D", None, None, copies))
            return
        counts["duplicate"] += copies - first
        if first:
            letter = initial if initial in ("s", "u", "a") else "x"
            if end not in ".!?":
                counts["truncated"] += 1
                letter = letter.upper()
            self.rows.append((letter, role, text, 1))
            self.chars += len(text)
        if copies > first:
            self.rows.append(("D", None, None, copies - first))

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= PIECE_CHARS

    def letters(self) -> str:
        return "".join(letter for letter, *_ in self.rows if letter != "D")

    def record(self) -> dict:
        return self.counts | {
            "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_initial": self.first_initial, "last_initial": self.last_initial,
        }


def apply_edits(rows: list, edits: str, state: int) -> tuple[str, list[dict]]:
    """The whole audit, forced deletions included, and the turns that result. Of deletions and an insertion that may stand in
    either order the deletions come first."""
    audit, kept, at = [], [], 0

    def forced() -> None:
        nonlocal at
        while at < len(rows) and rows[at][0] == "D":
            audit.append("D" * rows[at][3])
            at += 1

    for edit in edits:
        forced()
        audit.append(edit)
        if edit == "I":
            wanted = auction.WANTED[state]
            kept.append({"role": auction.ROLE[wanted], "text": ""})
            state = auction.STEP[state, wanted]
            continue
        letter, role, text, _ = rows[at]
        at += 1
        if edit == "R":
            wanted = auction.WANTED[state]
            role, letter = auction.ROLE[wanted], wanted
        if edit != "D":
            state = auction.STEP[state, letter.lower()]
            kept.append({"role": role, "text": text})
    forced()
    return "".join(audit), kept


_ENDS = [("first_turn", _LONG), ("last_turn", _LONG), ("first_initial", _STR), ("last_initial", _STR)]
_PLACE = T.StructType([T.StructField("conversation", _STR), T.StructField("part", _LONG), T.StructField("piece", _LONG)])
_RECORD = T.StructType([
    *[T.StructField(c, _LONG) for c in _COUNTS], *[T.StructField(n, t) for n, t in _ENDS],
])
_DONE = T.StructType([
    T.StructField("cost", _LONG), T.StructField("audit", _STR), T.StructField("repaired", T.ArrayType(_TURN)),
])
_OPEN = T.StructType([
    T.StructField("costs", T.ArrayType(_LONG)), T.StructField("ranks", T.ArrayType(_LONG)),
    T.StructField("letters", _STR), T.StructField("roles", T.ArrayType(_STR)), T.StructField("texts", T.ArrayType(_STR)),
    T.StructField("copies", T.ArrayType(_LONG)),
])
_SOLVED = T.StructType([*_PLACE.fields, T.StructField("alone", T.BooleanType()), *_RECORD.fields, *_DONE.fields, *_OPEN.fields])


def _flat(costs: auction.Costs, ranks: auction.Ranks) -> dict:
    return {
        "costs": [_NEVER if c == float("inf") else int(c) for row in costs for c in row],
        "ranks": [r for row in ranks for r in row],
    }


def _square(costs: list[int], ranks: list[int]) -> tuple[auction.Costs, auction.Ranks]:
    rows = range(0, 16, 4)
    return (
        tuple(tuple(float("inf") if c == _NEVER else c for c in costs[i : i + 4]) for i in rows),
        tuple(tuple(ranks[i : i + 4]) for i in rows),
    )


def _open_row(place: dict, piece: _Piece) -> dict:
    letters, roles, texts, copies = zip(*piece.rows) if piece.rows else ((), (), (), ())
    return place | {"alone": False} | piece.record() | _flat(*auction.stretch(piece.letters())) | {
        "letters": "".join(letters), "roles": list(roles), "texts": list(texts), "copies": list(copies),
    }


def _whole_row(place: dict, piece: _Piece) -> dict:
    cost, edits = auction.cheapest_edits(piece.letters())
    audit, kept = apply_edits(piece.rows, edits, 0)
    forced = sum(copies for letter, _, _, copies in piece.rows if letter == "D") * auction.DELETE
    return place | {"alone": True} | piece.record() | {"cost": cost + forced, "audit": audit, "repaired": kept}


def _solved(piece_rows: int):
    """Whole conversations solved, pieces of others, from sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part = to_arrow_schema(_SOLVED), TaskContext.get().partitionId()
        out: list[dict] = []
        held = 0
        name, piece, number, mark, opening = None, _Piece(), 0, None, True

        def give(row: dict) -> None:
            nonlocal held
            out.append(row)
            held += piece.chars + 200

        def close(last: bool) -> None:
            place = {"conversation": name, "part": part, "piece": number}
            give(_open_row(place, piece) if opening or last or number else _whole_row(place, piece))

        for batch in batches:
            for row in batch.to_pylist():
                if row["conversation"] != name:
                    if name is not None:
                        close(False)
                        opening = False
                    name, piece, number, mark = row["conversation"], _Piece(), 0, None
                if row["kind"] == 0:
                    mark = row["turn"], row["role"], row["th"]
                    continue
                if row["copies"]:
                    if piece.full(piece_rows):
                        give(_open_row({"conversation": name, "part": part, "piece": number}, piece))
                        piece, number = _Piece(), number + 1
                    first = mark == (row["turn"], row["role"], row["th"])
                    piece.add(row["turn"], row["role"], row["text"], row["end"], row["copies"], first)
                if held > PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if name is not None:
            close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


_CHAIN = T.StructType([*_PLACE.fields[:2], *_OPEN.fields[:2]])
_WAY = T.StructType([*_PLACE.fields, T.StructField("before", _LONG), T.StructField("after", _LONG)])


def _chained(group: pa.Table) -> pa.Table:
    """A part's costs and ranks, from those of its pieces."""
    rows = sorted(group.to_pylist(), key=lambda r: r["piece"])
    whole = _square(rows[0]["costs"], rows[0]["ranks"])
    for row in rows[1:]:
        whole = auction.joined(whole, _square(row["costs"], row["ranks"]))
    return pa.Table.from_pylist([{k: rows[0][k] for k in ("conversation", "part")} | _flat(*whole)], to_arrow_schema(_CHAIN))


def _ways(group: pa.Table) -> pa.Table:
    """The states around each of the rows, which are the parts of a conversation or the pieces of a part."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    _, states = auction.route([_square(r["costs"], r["ranks"]) for r in rows], rows[0]["from"], rows[0]["to"])
    names = ("conversation", "part", "piece")
    found = [{k: r[k] for k in names} | {"before": s, "after": t} for r, s, t in zip(rows, states, states[1:])]
    return pa.Table.from_pylist(found, to_arrow_schema(_WAY))


_TRACED = T.StructType([*_PLACE.fields, T.StructField("alone", T.BooleanType()), *_RECORD.fields, *_DONE.fields])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their edits, from the states around them; the last of a conversation has the edits that end it."""
    schema = to_arrow_schema(_TRACED)
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            rows = list(zip(row["letters"], row["roles"], row["texts"], row["copies"]))
            letters = "".join(letter for letter, *_ in rows if letter != "D")
            cost, edits = auction.cheapest_edits(letters, row["before"], row["after"])
            if row["ends"]:
                edits += auction.END[row["after"]]
                cost += auction.INSERT * len(auction.END[row["after"]])
            audit, kept = apply_edits(rows, edits, row["before"])
            cost += auction.DELETE * sum(copies for letter, _, _, copies in rows if letter == "D")
            done = {f: row[f] for f in schema.names if f in row} | {"cost": cost, "audit": audit, "repaired": kept}
            yield pa.RecordBatch.from_pylist([done], schema)


def repair(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Pieces of every conversation of `turns` (conv_id, turn, role, text and perhaps `copies`): counts, cost, `audit` and the
    `repaired` turns, to be read in order of `part` and `piece`."""
    solved = store(_ordered(turns).mapInArrow(_solved(piece_rows), _SOLVED), "conversation-pieces")
    pieces = solved.where("NOT alone")
    narrow = pieces.select(*_PLACE.names, "costs", "ranks")
    parts = narrow.groupBy("conversation", "part").applyInArrow(_chained, _CHAIN)
    none = F.lit(None).cast("long")
    by_part = store(
        parts.select("conversation", "part", F.lit(0).cast("long").alias("piece"), "costs", "ranks",
                     F.lit(0).cast("long").alias("from"), none.alias("to"))
        .groupBy("conversation").applyInArrow(_ways, _WAY),
        "conversation-parts",
    )
    last = by_part.groupBy("conversation").agg(F.max("part").alias("last_part"))
    within = by_part.join(last, "conversation").select(
        "conversation", "part", F.col("before").alias("from"), F.col("after").alias("to"),
        (F.col("part") == F.col("last_part")).alias("ends"),
    )
    ways = narrow.join(within.drop("ends"), ["conversation", "part"]).groupBy("conversation", "part").applyInArrow(_ways, _WAY)
    final = narrow.groupBy("conversation", "part").agg(F.max("piece").alias("last_piece")).join(
        within.where("ends").select("conversation", "part"), ["conversation", "part"]
    )
    placed = store(
        ways.join(final, ["conversation", "part"], "left").select(
            *_WAY.names, (F.col("last_piece").isNotNull() & (F.col("piece") == F.col("last_piece"))).alias("ends")
        ),
        "conversation-ways",
    )
    traced = pieces.drop("cost", "audit", "repaired", "costs", "ranks").join(placed, _PLACE.names).mapInArrow(_traced, _TRACED)
    return solved.where("alone").select(*_TRACED.names).unionByName(traced)


_SUMMARY = T.StructType([
    T.StructField("conversation", _STR), *[T.StructField(c, _LONG) for c in ("gaps", *_COUNTS[1:5], "cost")],
    T.StructField("audit", _STR), T.StructField("repaired_sha256", _STR),
])


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation from its sorted pieces; texts go through the digest one piece at a time."""
    schema, held = to_arrow_schema(_SUMMARY), None

    def done(h: dict) -> pa.RecordBatch:
        row = {c: h["sums"][c] for c in (*_COUNTS[1:5], "cost")} | {
            "conversation": h["name"], "gaps": _gaps(h["first_turn"], h["last_turn"], h["sums"]["turns"]),
            "audit": "".join(h["audit"]), "repaired_sha256": h["digest"].hexdigest(),
        }
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if held is None or held["name"] != row["conversation"]:
                if held is not None:
                    yield done(held)
                held = {"name": row["conversation"], "sums": dict.fromkeys((*_COUNTS, "cost"), 0), "audit": [],
                        "digest": hashlib.sha256(), "any": False, "first_turn": None, "last_turn": None, "initial": None}
            sums = held["sums"]
            for c in sums:
                sums[c] += row[c]
            # what the cut between two pieces has hidden
            if held["initial"] is not None and row["first_initial"] is not None:
                sums["illegal"] += held["initial"] + row["first_initial"] not in LEGAL
            if row["last_initial"] is not None:
                held["initial"] = row["last_initial"]
            if row["first_turn"] is not None:
                sums["turns"] -= row["first_turn"] == held["last_turn"]
                held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
                held["last_turn"] = row["last_turn"]
            held["audit"].append(row["audit"])
            for turn in row["repaired"]:
                held["digest"].update((("\n" if held["any"] else "") + f"{turn['role']}:{turn['text']}").encode())
                held["any"] = True
    if held is not None:
        yield done(held)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the digest of the repaired turns.

    A digest has one order, so the pieces of a cut conversation are read by one task, one after the other; all others are
    summed up where they are.
    """
    joined = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    alone = pieces.where("alone").select(
        "conversation", gaps.alias("gaps"), *_COUNTS[1:5], "cost", "audit", F.sha2(joined, 256).alias("repaired_sha256")
    )
    cut = pieces.where("NOT alone").drop("alone").repartition("conversation").sortWithinPartitions(*_PLACE.names)
    return alone.unionByName(cut.mapInArrow(_summed, _SUMMARY))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = summaries(repair(damage(turns)))
    conv_id = F.when(F.col("conversation") != "n", F.substring("conversation", 2, 1 << 30))
    return found.select(
        conv_id.cast(turns.schema["conv_id"].dataType).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", "repaired_sha256",
    )
