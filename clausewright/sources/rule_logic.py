"""Parses deployment logic such as ``1) IF A OR (B AND C) IS SET --> Answer = Standard``.

Parentheses group and AND binds tighter than OR. An ``Else`` branch always holds.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = re.compile(r"-{2,}>|→|->")
_ANSWER = re.compile(r"^\s*answer\s*=\s*(.*)$", re.IGNORECASE | re.DOTALL)
_HEAD = re.compile(r"^\s*(?:\d+\)\s*)?(?:(else)|if\s+(.+?)\s+is\s+set)\s*$", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"\(|\)|[^\s()]+")


def parse(text: str | None) -> list[dict]:
    """Branches in order: predicate, answer, is_else. Lines of another form are passed over."""
    out = []
    for line in (text or "").splitlines():
        sides = _ARROW.split(line, maxsplit=1)
        if len(sides) != 2:
            continue
        head, answer = _HEAD.match(sides[0]), _ANSWER.match(sides[1])
        if not head or not answer:
            continue
        otherwise = head.group(1) is not None
        predicate = {"op": "and", "args": []} if otherwise else to_predicate(head.group(2))
        out.append({"predicate": predicate, "answer": answer.group(1).strip(), "is_else": otherwise})
    return out


def branches(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a row for each branch of the logic in ``text``: branch (from 1), predicate (JSON), answer, is_else."""

    @F.pandas_udf("array<struct<branch:int,predicate:string,answer:string,is_else:boolean>>")
    def parsed(texts):
        import pandas as pd

        return pd.Series([[{"branch": k, "predicate": json.dumps(b["predicate"], separators=(",", ":")), "answer": b["answer"], "is_else": b["is_else"]} for k, b in enumerate(parse(t), 1)] for t in texts])

    return rows.select("*", F.inline(parsed(F.col(text))))


def to_predicate(expression: str) -> dict:
    """A tree of ``or``, ``and`` and ``field.exists``; a missing closing parenthesis is forgiven."""
    parts = _PART.findall(expression)
    at = 0

    def either() -> dict:
        return series("or", both)

    def both() -> dict:
        return series("and", single)

    def series(op: str, inner) -> dict:
        nonlocal at
        args = [inner()]
        while at < len(parts) and parts[at].lower() == op:
            at += 1
            args.append(inner())
        return args[0] if len(args) == 1 else {"op": op, "args": args}

    def single() -> dict:
        nonlocal at
        if at < len(parts) and parts[at] == "(":
            at += 1
            found = either()
            at += at < len(parts) and parts[at] == ")"
            return found
        name = parts[at] if at < len(parts) else ""
        at += 1
        return {"op": "field.exists", "args": [name.rstrip("*").rstrip(":")]}

    return either()
