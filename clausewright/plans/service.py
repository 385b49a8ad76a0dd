"""What an application calls: import a rulebook, run it over agreements, read the findings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators.align import align, resolved
from ..sources import office
from ..sources.store import Store


def import_policy(store: Store, path: str, name: str, at: str) -> str:
    """Creates a policy from a .xlsx or .docx file: its draft rules and their soft bindings; its id."""
    policy_id = store.create_policy(name, source_file=path, at=at)
    store.create_rules(office.import_rules(store.spark, path, policy_id))
    rules = store.rules(policy_id)
    store.describe(policy_id, at, f"{rules.count()} rules from {path.rsplit('/', 1)[-1]}")
    labelled = rules.selectExpr("rule_id", "get(tags, 0) as label")
    store.add_bindings(office.bindings(labelled))
    return policy_id


def active_rules(store: Store, policy_id: str) -> list[dict]:
    """The policy's active rules with their bindings, as ``align`` takes them; a rulebook is small."""
    rows = resolved(store.rules(policy_id), store.table("rule_bindings")).collect()
    rules = [r.asDict(recursive=True) for r in rows]
    return [r | {"predicate": json.loads(r["predicate"]) if r["predicate"] else None} for r in rules]


def run(store: Store, policy_id: str, contexts: DataFrame, run_id: str, at: str, **options) -> DataFrame:
    """Aligns the agreements with the policy's active rules and records the findings; they come back as stored."""
    store.record(align(contexts, active_rules(store, policy_id), run_id=run_id, **options), at)
    return store.findings(run_id)


def policy(store: Store, policy_id: str) -> DataFrame:
    """The policy's row; an unknown id is an error."""
    found = store.policy(policy_id)
    if found.isEmpty():
        raise KeyError(policy_id)
    return found
