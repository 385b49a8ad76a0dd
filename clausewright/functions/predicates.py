"""Compiles predicate trees ``{"op": ..., "args": [...]}`` to Catalyst columns.

A node becomes two columns: whether it holds, and whether evaluating it goes wrong. Both are never
null. Going wrong respects the order of evaluation, so ``or`` of a true and a faulty node holds
while the reverse is inconclusive. New operators are functions registered with ``@operator``; they
return columns and so stay within Catalyst.
"""

from __future__ import annotations

import fnmatch
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import cosine, safe_double

FIELD_TYPE = "struct<kind:string,s:string,d:double,b:boolean>"
CLAUSE_TYPE = "struct<id:string,label:string,text:string,embedding:array<float>>"


@dataclass(frozen=True)
class Context:
    """Where a predicate finds its inputs: columns of one row per agreement."""

    fields: Column | dict[str, Column] | None = None
    clauses: Column | None = None
    domain_name: Column | None = None
    party_role: Column | None = None
    doc_value: Column | None = None
    #: Text to vector on the driver, for literals, and text to a vector column, for field values.
    embed_literal: Callable[[str], list[float]] | None = None
    embed_column: Callable[[Column], Column] | None = None

    def field(self, name: str) -> Column:
        if isinstance(self.fields, dict):
            return self.fields.get(name, F.lit(None).cast(FIELD_TYPE))
        return F.lit(None).cast(FIELD_TYPE) if self.fields is None else F.try_element_at(self.fields, F.lit(name))

    def all_clauses(self) -> Column:
        return F.expr("array()").cast(f"array<{CLAUSE_TYPE}>") if self.clauses is None else F.coalesce(self.clauses, F.expr("array()").cast(f"array<{CLAUSE_TYPE}>"))

    @classmethod
    def standard(cls, **more) -> Context:
        """Columns named as ``context.build`` names them."""
        return cls(F.col("fields"), F.col("clauses"), F.col("domain.name"), F.col("doc.party_role"), F.col("doc.value"), **more)


@dataclass(frozen=True)
class Compiled:
    holds: Column
    fails: Column | None = None

    def verdict(self) -> Column:
        """True, false, or null where evaluation goes wrong."""
        return self.holds if self.fails is None else F.when(~self.fails, self.holds)


_OPERATORS: dict[str, Callable[[list, Context], Compiled]] = {}


def operator(name: str):
    def register(f):
        _OPERATORS[name] = f
        return f

    return register


def known() -> list[str]:
    return sorted(_OPERATORS)


def faulty() -> Compiled:
    return Compiled(F.lit(False), F.lit(True))


def compile_predicate(node: Any, ctx: Context) -> Compiled:
    """A node that isn't an operator is a literal and holds by its truth value."""
    if not isinstance(node, dict) or "op" not in node:
        return Compiled(F.lit(bool(node)))
    f = _OPERATORS.get(node["op"])
    if f is None:
        return faulty()
    try:
        return f(list(node.get("args") or []), ctx)
    except (IndexError, TypeError, ValueError):
        return faulty()


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _as_double(field: Column) -> Column:
    """What converting the value to a number gives; NaN compares false with everything."""
    d = F.when(field["kind"] == "string", safe_double(field["s"])).otherwise(field["d"])
    return F.when(~F.isnan(d), d)


def _as_text(field: Column) -> Column:
    return field["s"]


def _equals(field: Column, value: Any) -> Column:
    if value is None:
        return field.isNull()
    if isinstance(value, bool | int | float):
        return _sure(field["kind"].isin("number", "bool") & (field["d"] == float(value)) & ~F.isnan(field["d"])) if not math.isnan(value) else F.lit(False)
    if isinstance(value, str):
        return _sure((field["kind"] == "string") & (field["s"] == value))
    return F.lit(False)


@operator("field.exists")
def _exists(args, ctx):
    return Compiled(ctx.field(args[0]).isNotNull())


@operator("field.eq")
def _eq(args, ctx):
    return Compiled(_equals(ctx.field(args[0]), args[1]))


@operator("field.in")
def _in(args, ctx):
    field, options = ctx.field(args[0]), args[1]
    if isinstance(options, str):
        text = _sure(field["kind"] == "string")
        return Compiled(_sure(text & F.contains(F.lit(options), field["s"])), ~text)
    found = F.lit(False)
    for option in list(options):
        found = found | _equals(field, option)
    return Compiled(found)


@operator("field.gte")
def _gte(args, ctx):
    low = _number(args[1])
    return Compiled(F.lit(False) if low is None else _sure(_as_double(ctx.field(args[0])) >= low) & F.lit(not math.isnan(low)))


@operator("field.lte")
def _lte(args, ctx):
    high = _number(args[1])
    return Compiled(F.lit(False) if high is None else _sure(_as_double(ctx.field(args[0])) <= high) & F.lit(not math.isnan(high)))


@operator("field.between")
def _between(args, ctx):
    low, high = _number(args[1]), _number(args[2])
    if low is None or high is None or math.isnan(low) or math.isnan(high):
        return Compiled(F.lit(False))
    return Compiled(_sure(_as_double(ctx.field(args[0])).between(low, high)))


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that Java understands too."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] in "!]"))) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


@operator("field.matches")
def _matches(args, ctx):
    field, (kind, pattern) = ctx.field(args[0]), args[1:3]
    there = field.isNotNull()
    if kind == "glob":
        fnmatch.translate(pattern)
        return Compiled(_sure(_as_text(field).rlike(glob_regex(pattern))))
    if kind == "regex":
        if re.search(r"\(\?P[<=]|\(\?\(", pattern):  # syntax that only Python has
            return Compiled(F.lit(False), there)
        try:
            re.compile(pattern)
        except re.error:
            return Compiled(F.lit(False), there)
        return Compiled(_sure(_as_text(field).rlike(pattern)))
    return Compiled(F.lit(False), there)


@operator("field.value")
def _value(args, ctx):
    field = ctx.field(args[0])
    return Compiled(_sure(F.when(field["kind"] == "string", field["s"] != "").otherwise(field["d"] != 0)))


@operator("field.semantic_match")
def _semantic_match(args, ctx):
    if ctx.embed_literal is None or ctx.embed_column is None:
        return Compiled(F.lit(False))
    target, least = [float(x) for x in ctx.embed_literal(args[1])], float(args[2])
    if not target:
        return Compiled(F.lit(False))
    value = ctx.embed_column(_as_text(ctx.field(args[0])))
    return Compiled(_sure(cosine(value, F.array(*map(F.lit, target))) >= least))


@operator("clause.classified_as")
def _classified_as(args, ctx):
    return Compiled(F.exists(ctx.all_clauses(), lambda c: c["label"].eqNullSafe(F.lit(args[0]))))


@operator("clause.contains")
def _contains(args, ctx):
    needle = str(args[0]).lower()
    return Compiled(F.exists(ctx.all_clauses(), lambda c: F.contains(F.lower(F.coalesce(c["text"], F.lit(""))), F.lit(needle))))


@operator("clause.absent")
def _absent(args, ctx):
    return Compiled(~F.exists(ctx.all_clauses(), lambda c: c["label"].eqNullSafe(F.lit(args[0]))))


@operator("clause.similar_to")
def _similar_to(args, ctx):
    if ctx.embed_literal is None:
        return Compiled(F.lit(False))
    target, least = [float(x) for x in ctx.embed_literal(args[0])], float(args[1])
    if not target:
        return Compiled(F.lit(False))
    reference = F.array(*map(F.lit, target))
    there = lambda c: _sure((c["text"] != "") & (F.size(c["embedding"]) > 0))
    return Compiled(F.exists(ctx.all_clauses(), lambda c: there(c) & _sure(cosine(c["embedding"], reference) >= least)))


def _fold(args, ctx, stops_at: bool) -> Compiled:
    """Children in order: evaluation goes wrong only where no earlier child has decided the result."""
    total, fails, reached = F.lit(not stops_at), None, None
    for arg in args:
        child = compile_predicate(arg, ctx)
        if child.fails is not None:
            here = child.fails if reached is None else reached & child.fails
            fails = here if fails is None else fails | here
        total = total | child.holds if stops_at else total & child.holds
        going = ~child.holds if stops_at else child.holds
        reached = going if reached is None else reached & going
    return Compiled(total, fails)


@operator("and")
@operator("all_of")
def _and(args, ctx):
    return _fold(args, ctx, stops_at=False)


@operator("or")
@operator("any_of")
def _or(args, ctx):
    return _fold(args, ctx, stops_at=True)


@operator("not")
def _not(args, ctx):
    child = compile_predicate(args[0], ctx)
    return Compiled(~child.holds, child.fails)


@operator("if_then")
def _if_then(args, ctx):
    cause, effect = compile_predicate(args[0], ctx), compile_predicate(args[1], ctx)
    fails = cause.fails
    if effect.fails is not None:
        here = cause.holds & effect.fails
        fails = here if fails is None else fails | here
    return Compiled(~cause.holds | effect.holds, fails)


@operator("count")
def _count(args, ctx):
    sub, comparison, n = args
    one = lambda c: compile_predicate(sub, replace(ctx, clauses=F.array(c)))
    clauses = ctx.all_clauses()
    hits = F.size(F.filter(clauses, lambda c: one(c).holds))
    compare = {">=": hits >= n, ">": hits > n, "<=": hits <= n, "<": hits < n, "==": hits == n}
    if comparison not in compare:
        return faulty()
    probe = compile_predicate(sub, ctx)
    fails = F.exists(clauses, lambda c: _sure(one(c).fails)) if probe.fails is not None else None
    return Compiled(compare[comparison], fails)


@operator("domain.is")
def _domain_is(args, ctx):
    return Compiled((F.lit(None).cast("string") if ctx.domain_name is None else ctx.domain_name).eqNullSafe(F.lit(args[0])))


@operator("doc.party_role.is")
def _party_role_is(args, ctx):
    return Compiled((F.lit(None).cast("string") if ctx.party_role is None else ctx.party_role).eqNullSafe(F.lit(args[0])))


@operator("doc.value.gte")
def _doc_value_gte(args, ctx):
    low = _number(args[0])
    if low is None or ctx.doc_value is None:
        return Compiled(F.lit(False))
    return Compiled(_sure((ctx.doc_value >= low) & ~F.isnan(ctx.doc_value)) & F.lit(not math.isnan(low)))


def fields_of(node: Any) -> set[str]:
    """Names of the fields a tree refers to: the only ones a context needs."""
    if not isinstance(node, dict) or "op" not in node:
        return set()
    args = node.get("args") or []
    own = {args[0]} if str(node["op"]).startswith("field.") and args and isinstance(args[0], str) else set()
    return own.union(*(fields_of(a) for a in args))


def describe(node: Any) -> str:
    """The tree as a line of text."""
    if not isinstance(node, dict) or "op" not in node:
        return str(node)
    op, args = node["op"], list(node.get("args") or [])
    if op == "field.between" and len(args) == 3:
        return f"{args[0]} between {args[1]} and {args[2]}"
    if op == "field.eq" and len(args) == 2:
        return f"{args[0]} = {args[1]}"
    if op == "clause.classified_as" and args:
        return f"has clause {args[0]}"
    if op == "not" and args:
        return f"not ({describe(args[0])})"
    if op in ("and", "all_of"):
        return " and ".join(f"({describe(a)})" for a in args) or "always"
    if op in ("or", "any_of"):
        return " or ".join(f"({describe(a)})" for a in args) or "never"
    if op == "if_then" and len(args) == 2:
        return f"if ({describe(args[0])}) then ({describe(args[1])})"
    return f"{op}({', '.join(map(describe, args))})"
