"""Repair of conversations' structure by a forward Viterbi pass over four states of a grammar.

The roles of a sound conversation spell ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and
assistant. The states are what the repaired turns spell so far: nothing, a system turn, ending in
user, ending in assistant. Turn by turn each state carries the least cost and, of equal ones, the
first audit string: Keep, Rerole, Delete, Insert. Inserted turns close each turn's layer; two suffice
to get from any state to any other one that inserts can reach. A state and a letter tell the next
state, so an audit string tells the repaired turns.

Letters that all states have in common are decided: their turns are written and hashed, and leave the
memory. Of two paths with one cost at one turn neither begins with the other (it would have more
inserts, which cost), so comparing them as strings is right however they go on.

A conversation's turns come sorted into one task, as its hash needs them in order, but that task
streams them. Whether a turn repeats an earlier one is not remembered there: the first place of every
role and text is found beforehand by an aggregation and comes as a mark in front of its turn.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches, read

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing, system, user, assistant. Where a rerole or insert leads, and what it makes.
_NEXT = (2, 2, 3, 2)
_ROLE = ("", "", "user", "assistant")
#: By initial and state, where keeping a turn leads.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Letters after which the states' common beginning is looked for.
WINDOW = 64

_TEXT = re.compile(f"[^{SPACE}]")


def fault_of(text: str, first: bool) -> str | None:
    """A turn's first fault: blank, duplicate (if it isn't the first with its role and text) or truncated."""
    end = text.rstrip(" \t\n\x0b\x0c\r")
    if not end:
        return "blank"
    if not first:
        return "duplicate"
    return None if end[-1] in ".!?" else "truncated"


Paths = list[tuple[int, str] | None]


def _close(paths: Paths) -> None:
    """Inserted turns behind a layer's turn."""
    for state in (0, 1, 2, 3, 2):  # from nothing and system to user, on to assistant, and from there to user
        if (now := paths[state]) is not None:
            made, to = (now[0] + INSERT, now[1] + "I"), _NEXT[state]
            if paths[to] is None or made < paths[to]:
                paths[to] = made


def _step(paths: Paths, initial: str, fault: str | None) -> Paths:
    """The next layer. What no continuation can make the best is left out: from assistant all goes on that goes on from system, and from nothing, too, but for a system turn, whose deletion costs 4 at most."""
    out: Paths = [None if p is None else (p[0] + DELETE, p[1] + "D") for p in paths]
    if fault != "blank" and fault != "duplicate":
        more, kept = TRUNCATED if fault else 0, _KEPT.get(initial, {})
        for state, p in enumerate(paths):
            if p is None:
                continue
            cost, audit = p
            made, to = (cost + REROLE + more, audit + "R"), _NEXT[state]
            if out[to] is None or made < out[to]:
                out[to] = made
            to = kept.get(state)
            if to is not None:
                made = (cost + KEEP + more, audit + "K")
                if out[to] is None or made < out[to]:
                    out[to] = made
    _close(out)
    if (end := out[3]) is not None:
        if out[0] is not None and out[0][0] > end[0] + DELETE:
            out[0] = None
        if out[1] is not None and out[1][0] > end[0]:
            out[1] = None
    return out


class Conversation:
    """What is known of one conversation so far; ``write`` gets each repaired turn: edit, turn, role, text."""

    def __init__(self, write=None):
        self.paths: Paths = [(0, ""), None, None, None]
        _close(self.paths)
        self.state = 0  # at the end of what is decided
        self.waiting: deque[tuple] = deque()
        self.audit: list[str] = []
        self.hash, self.written, self.write = hashlib.sha256(), 0, write
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        fault = fault_of(text, first)
        if fault:
            self.faults[fault] += 1
        self.waiting.append((turn, role, text))
        self.paths = _step(self.paths, initial, fault)
        if len(self.waiting) % WINDOW == 0:
            self._decide(os.path.commonprefix([p[1] for p in self.paths if p]))

    def _decide(self, letters: str) -> None:
        for letter in letters:
            turn = role = text = None
            if letter != "I":
                turn, role, text = self.waiting.popleft()
            if letter == "D":
                continue
            if letter == "K":
                self.state = _KEPT[role[:1]][self.state]
            else:
                self.state = _NEXT[self.state]
                role = _ROLE[self.state]
            text = text or ""
            self.hash.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
            self.written += 1
            if self.write:
                self.write(letter, turn, role, text)
        if letters:
            self.audit.append(letters)
            self.paths = [p and (p[0], p[1][len(letters) :]) for p in self.paths]

    def end(self) -> tuple:
        cost, letters = min(p for p in (self.paths[0], self.paths[3]) if p)
        self.paths = [(cost, letters), None, None, None]
        self._decide(letters)
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


_TURNS = [("place", pa.int64(), "long"), ("edit", pa.string(), "string"), ("turn", pa.int64(), "long"), ("role", pa.string(), "string"), ("text", pa.string(), "string")]
_REPORT = [*((c, pa.int64(), "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string(), "string"), ("repaired_sha256", pa.string(), "string")]


def _stream(rows: DataFrame, every: DataFrame | None, names: tuple[str, str, str, str]) -> DataFrame:
    """conv, kind (0 the conversation itself, 1 a mark, 2 a turn), turn, role, digest, text, by conversation in order."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in names)
    turns = rows.select(conv.alias("conv"), F.lit(2).alias("kind"), turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), F.coalesce(text.cast("string"), F.lit(" ")).alias("text"))
    turns = turns.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    marks = turns.filter(F.col("text").rlike(_TEXT.pattern)).groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    marks = marks.select("conv", F.lit(1).alias("kind"), "first.turn", "role", "digest", F.lit(None).cast("string").alias("text"))
    known = (every if every is not None else rows.select(conv)).toDF("conv").distinct()
    none = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]
    stream = turns.select("conv", "kind", "turn", "role", "digest", "text").unionByName(marks).unionByName(known.select("conv", F.lit(0).alias("kind"), *none))
    order = [F.col("conv"), F.col("kind") > 0, F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("kind")]
    return stream.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "turn", "role", "digest", "text")


def _run(rows: DataFrame, every: DataFrame | None, names: tuple[str, str, str, str], turns: bool) -> DataFrame:
    stream = _stream(rows, every, names)
    kind = stream.schema["conv"].dataType.simpleString()
    fields = _TURNS if turns else _REPORT

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def records(it) -> Iterator[tuple]:
            now: Conversation | None = None
            conv, mark, out, n = None, None, [], 0

            def write(*turn) -> None:
                nonlocal n
                out.append((conv, n, *turn))
                n += 1

            for batch in it:
                for name, what, turn, role, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if what == 0:
                        if now is not None:
                            report = now.end()
                            yield from out if turns else [(conv, *report)]
                        conv, mark, n = name, None, 0
                        out.clear()
                        now = Conversation(write if turns else None)
                    elif what == 1:
                        mark = turn, role, digest
                    else:
                        now.add(turn, role, text, mark == (turn, role, digest))
                        if mark == (turn, role, digest):
                            mark = None
                        if out:
                            yield from out
                            out.clear()
            if now is not None:
                report = now.end()
                yield from out if turns else [(conv, *report)]

        first = next(it, None)
        if first is None:
            return
        schema = pa.schema([("conv", first.schema.field(0).type), *((c, t) for c, t, _ in fields)])
        yield from batches(schema, records(b for part in ([first], it) for b in part))

    made = stream.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} {k}" for c, _, k in fields))
    return made.withColumnRenamed("conv", names[0])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns: conversation, place from 0, edit (K, R or I), turn (null if inserted), role and text.

    Defined results: a conversation's turns go by turn, null ones first, then by role and text's SHA-256; a
    null role or text counts as one space; a null conversation is one like any other; a role of another
    initial than s, u or a is rerolled or deleted; repeated rows are duplicates; a text without anything
    but white space is blank; an empty table gives an empty result; other columns are not read.
    """
    return _run(rows, None, (conv_col, turn_col, role_col, text_col), True)


def repair_report(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``every`` (one column; by default those of ``rows``): its faults, and how it is repaired.

    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, the digest of the turns that
    ``repair`` gives, as ``role:text`` lines. A conversation without turns has zeros, an empty audit and the
    digest of the empty string. Otherwise as ``repair``.
    """
    return _run(rows, every, (conv_col, turn_col, role_col, text_col), False)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of conversation and turn: a few turns in twenty each are
    dropped, emptied, robbed of their full stops, repeated, or said by the user."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named[2].alias("role"), named[3].alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    conversations = read(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations.select("conv_id"))
