"""Composite fields: fields derived from others, which may be composites themselves.

Definitions form a graph. It is put in order before anything is computed, a cycle is an error that
names its way round, and each level of the order becomes one select of columns, so a field that
several others use is computed once. What depends on a changed field, directly or through others, is
the cascade of that field; only its columns are computed anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Context, compile_predicate, fields_of
from .context import typed_field

#: In front of composites' columns.
PREFIX = "composite_"


def parts_of(definition: dict) -> list[str]:
    """The fields a definition reads: its parts, branches and those of its condition."""
    own = list(definition.get("parts") or [])
    own += [definition[k] for k in ("then", "otherwise") if definition.get(k) is not None]
    return list(dict.fromkeys([*own, *sorted(fields_of(definition.get("when")))]))


def levels(definitions: list[dict]) -> list[list[dict]]:
    """The definitions by level: those of a level read fields and earlier levels only.

    Names that no definition has are plain fields. Raises ValueError for a name that is defined twice
    and for a cycle.
    """
    named = {d["name"]: d for d in definitions}
    if len(named) < len(definitions):
        raise ValueError("a composite is defined twice")
    depth: dict[str, int] = {}

    def visit(name: str, way: tuple[str, ...]) -> int:
        if name in way:
            raise ValueError("composites form a cycle: " + " -> ".join([*way[way.index(name) :], name]))
        if name not in named:
            return -1
        if name not in depth:
            depth[name] = 1 + max((visit(p, (*way, name)) for p in parts_of(named[name])), default=-1)
        return depth[name]

    for name in named:
        visit(name, ())
    return [[d for d in definitions if depth[d["name"]] == k] for k in range(max(depth.values(), default=-1) + 1)]


def cascade(definitions: list[dict], changed: Iterable[str]) -> list[str]:
    """The composites that a change of these fields reaches, in the order in which they have to be computed."""
    reached = set(changed)
    out = []
    for level in levels(definitions):
        for d in level:
            if reached.intersection(parts_of(d)):
                reached.add(d["name"])
                out.append(d["name"])
    return out


def _folded(values: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    """All values that are there put together; null if none is."""
    out = values[0]
    for v in values[1:]:
        out = F.when(out.isNull(), v).when(v.isNull(), out).otherwise(f(out, v))
    return out


def value_of(definition: dict, ctx: Context) -> Column:
    """The composite as a field: null if nothing it needs is there.

    ``combine``: sum, mean, least, greatest, count (of parts that are there), all, any (parts are truth
    values), join (texts, ``separator`` between), or choose: the field ``then`` where the predicate
    ``when`` holds, else ``otherwise`` (null where its evaluation goes wrong). ``weights`` go with sum and
    mean. ``missing``: ``skip`` leaves out absent parts, ``null`` makes the composite absent with them.
    """
    how = definition["combine"]
    if how == "choose":
        branch = lambda k: ctx.field(definition[k]) if definition.get(k) is not None else ctx.field("")
        verdict = compile_predicate(definition["when"], ctx).verdict()
        return F.when(verdict, branch("then")).when(~verdict, branch("otherwise"))
    fields = [ctx.field(p) for p in definition["parts"]]
    if not fields:
        raise ValueError(f"the composite {definition['name']} has no parts")
    there = sum((f.isNotNull().cast("int") for f in fields), F.lit(0))
    whole = F.lit(True) if definition.get("missing", "skip") == "skip" else there == len(fields)
    if how == "count":
        return typed_field(F.when(whole, there.cast("double")), "number")
    if how in ("all", "any"):
        flags = [F.coalesce(f["b"], f["d"] != 0, F.lower(f["s"]).isin("true", "yes")) for f in fields]
        return typed_field(F.when(whole, _folded(flags, (lambda a, b: a & b) if how == "all" else (lambda a, b: a | b))), "bool")
    if how == "join":
        return typed_field(F.when(whole & (there > 0), F.concat_ws(definition.get("separator", " "), *(f["s"] for f in fields))), "string")
    numbers = [f["d"] for f in fields]
    known = sum((n.isNotNull().cast("int") for n in numbers), F.lit(0))
    whole = F.lit(True) if definition.get("missing", "skip") == "skip" else known == len(fields)
    if how in ("least", "greatest"):
        return typed_field(F.when(whole, _folded(numbers, F.least if how == "least" else F.greatest)), "number")
    weights = [float(w) for w in definition.get("weights") or [1.0] * len(numbers)]
    if len(weights) != len(numbers):
        raise ValueError(f"the composite {definition['name']} has not as many weights as parts")
    total = _folded([n * w for n, w in zip(numbers, weights, strict=True)], lambda a, b: a + b)
    if how == "mean":
        total = F.try_divide(total, _folded([F.when(n.isNotNull(), F.lit(w)) for n, w in zip(numbers, weights, strict=True)], lambda a, b: a + b))
    elif how != "sum":
        raise ValueError(f"composites can't be combined by {how}")
    return typed_field(F.when(whole, total), "number")


class _Fields(dict):
    """Composites by name; other names are the context's own fields."""

    def __init__(self, made: dict[str, Column], ctx: Context):
        super().__init__(made)
        self.ctx = ctx

    def get(self, name, default=None):
        return self[name] if name in self else self.ctx.field(name)


def attach(contexts: DataFrame, definitions: list[dict], ctx: Context | None = None, changed: Iterable[str] | None = None) -> tuple[DataFrame, Context]:
    """The contexts with a column for each composite, and the context in which rules find them as fields.

    With ``changed`` the contexts have the composites' columns from before, and only the cascade of these
    fields is computed anew. A composite hides a plain field of the same name only from what comes after it.
    """
    ctx = ctx or Context.standard()
    anew = None if changed is None else set(cascade(definitions, changed))
    made: dict[str, Column] = {}
    for level in levels(definitions):
        now = replace(ctx, fields=_Fields(dict(made), ctx))
        columns = {PREFIX + d["name"]: value_of(d, now) for d in level if anew is None or d["name"] in anew}
        if columns:
            contexts = contexts.withColumns(columns)
        made |= {d["name"]: F.col(PREFIX + d["name"]) for d in level}
    return contexts, replace(ctx, fields=_Fields(made, ctx))
