"""Versions of rules: what changed between two, as edits of the rule's document, and every version back from them.

A rule's document is a JSON object of its columns, the predicate as a tree within it. A diff lists edits
by path; parts of a tree that stay the same are not in it, however deep the change is.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truncated_id
from .store import SCHEMAS, Store

#: Columns that no revision is about.
FIXED = ("rule_id", "policy_id", "status", "version", "created_at", "updated_at")
COLUMNS = [c.split()[0] for c in SCHEMAS["policy_rules"].split(", ") if c.split()[0] not in FIXED]


def _same(before: Any, after: Any) -> bool:
    """Equal as JSON: false isn't 0, nor 1 1.0, however deep; the order of keys doesn't count."""
    return json.dumps(before, sort_keys=True) == json.dumps(after, sort_keys=True)


def diff(before: Any, after: Any, path: tuple = ()) -> list[dict]:
    """Edits that make ``after`` of ``before``: set (a value), drop (a key) and splice (of a list: at, drop, put)."""
    if _same(before, after):
        return []
    if isinstance(before, dict) and isinstance(after, dict):
        out = [{"edit": "drop", "path": [*path, k]} for k in before if k not in after]
        for k, v in after.items():
            out += diff(before[k], v, (*path, k)) if k in before else [{"edit": "set", "path": [*path, k], "value": v}]
        return out
    if isinstance(before, list) and isinstance(after, list):
        start = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if not _same(a, b)), min(len(before), len(after)))
        most = min(len(before), len(after)) - start
        end = next((i for i in range(most) if not _same(before[-1 - i], after[-1 - i])), most)
        old, new = before[start : len(before) - end], after[start : len(after) - end]
        if len(old) == len(new):
            return [e for i, (a, b) in enumerate(zip(old, new, strict=True)) for e in diff(a, b, (*path, start + i))]
        return [{"edit": "splice", "path": list(path), "at": start, "drop": len(old), "put": new}]
    return [{"edit": "set", "path": list(path), "value": after}]


def apply(document: Any, edits: list[dict]) -> Any:
    """The document after the edits; the one given is left as it is."""
    document = json.loads(json.dumps(document))
    for e in edits:
        if e["edit"] == "set" and not e["path"]:
            document = e["value"]
            continue
        at = document
        for k in e["path"] if e["edit"] == "splice" else e["path"][:-1]:
            at = at[k]
        if e["edit"] == "set":
            at[e["path"][-1]] = e["value"]
        elif e["edit"] == "drop":
            del at[e["path"][-1]]
        else:
            at[e["at"] : e["at"] + e["drop"]] = e["put"]
    return document


def documents(rules: DataFrame) -> DataFrame:
    """rule_id, version, document: the rules' columns as JSON, absent where null; predicates that parse are trees."""
    have = [c for c in COLUMNS if c in rules.columns]
    return rules.select("rule_id", F.coalesce(F.col("version"), F.lit(1)).alias("version") if "version" in rules.columns else F.lit(1).alias("version"), F.to_json(F.struct(*have)).alias("document"))


def _tree(document: str) -> dict:
    out = json.loads(document)
    try:
        out["predicate"] = json.loads(out["predicate"])
    except (KeyError, ValueError):
        pass
    return out


def _flat(document: dict) -> str:
    if "predicate" in document and not isinstance(document["predicate"], str):
        document = document | {"predicate": json.dumps(document["predicate"], separators=(",", ":"), ensure_ascii=False)}
    return json.dumps(document, separators=(",", ":"), ensure_ascii=False)


def revise(store: Store, edited: DataFrame, author: str, note: str, at: str) -> None:
    """The next version of each rule in ``edited`` (rule_id and new columns of the rule table), with its diff.

    Columns that ``edited`` lacks stay as they are. A rule whose document stays the same gets no version;
    unknown rules are left alone. Of rows that repeat a rule the first by content counts.
    """
    changed = [c for c in COLUMNS if c in edited.columns]
    one = edited.groupBy("rule_id").agg(F.min(F.struct(*changed)).alias("new"))
    now = store.rules().join(one, "rule_id")
    after = now.withColumns({c: F.col(f"new.{c}").cast(now.schema[c].dataType) for c in changed}).drop("new")
    both = documents(now).withColumnRenamed("document", "before").join(documents(after).select("rule_id", F.col("document").alias("after")), "rule_id")

    @F.pandas_udf("string")
    def edits(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(diff(_tree(b), _tree(a)), ensure_ascii=False) for b, a in zip(before, after, strict=True)], dtype=object)

    told = both.filter("before <> after").select("rule_id", (F.col("version") + 1).alias("next"), edits("before", "after").alias("diff"))
    rows = after.join(told, "rule_id").withColumn("version", F.col("next")).withColumn("updated_at", F.lit(at).cast("timestamp"))
    from ..functions.stored import stored

    rows = stored(rows, "revised")  # what is appended is read from the same tables
    store.append("rule_revisions", rows.select(truncated_id(F.col("rule_id"), F.col("next").cast("string")).alias("revision_id"), "rule_id", F.col("next").alias("revision_no"), "diff", F.lit(author).alias("author"), F.lit(note).alias("note"), F.lit(at).cast("timestamp").alias("created_at")))
    store.append("policy_rules", rows)


def history(store: Store) -> DataFrame:
    """rule_id, version, document: every version of every rule, from its first document and the diffs alone.

    A rule's revisions are people's edits; those of one rule are put together in one task.
    """
    first = documents(store.table("policy_rules").filter("coalesce(version, 1) = 1")).groupBy("rule_id").agg(F.min("document").alias("first"))
    diffs = store.table("rule_revisions").groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("revision_no", "diff"))).alias("diffs"))
    kind = "array<struct<version:int,document:string>>"

    @F.pandas_udf(kind)
    def replayed(first: pd.Series, diffs: pd.Series) -> pd.Series:
        out = []
        for document, edits in zip(first, diffs, strict=True):
            now, versions = _tree(document), [{"version": 1, "document": _flat(_tree(document))}]
            for e in edits if edits is not None else ():
                now = apply(now, json.loads(e["diff"]))
                versions.append({"version": int(e["revision_no"]), "document": _flat(now)})
            out.append(versions)
        return pd.Series(out, dtype=object)

    both = first.join(diffs, "rule_id", "left")
    return both.select("rule_id", F.inline(replayed("first", "diffs")))
