"""Contexts of agreements whose extractions arrive in any order.

State holds the value that wins so far of each field of an agreement, by ordinal, then by value, so the
order of arrival doesn't matter. A context goes out when all fields that rules ask for have a value, and
again whenever a later value wins: the last one of an agreement is what the batch would have built.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.context import typed_field

OUT = "agreement_id string, revision int, fields map<string,string>"
BUCKETS = 1 << 14


def latest_values(held: dict[str, list], rows: Iterator[tuple]) -> bool:
    """Takes in (name, value, ordinal) rows; whether any of them wins over what is held."""
    won = False
    for name, value, ordinal in rows:
        if value is None or name is None:
            continue
        rank = [float("-inf") if ordinal is None or ordinal != ordinal else ordinal, value]  # a missing number comes as NaN
        if name not in held or rank > held[name]:
            won = won or name not in held or held[name][1] != value
            held[name] = rank
    return won


def take_in(kept: dict[str, list], parts: Iterator[Iterator[tuple]], names: list[str], until: int | None = None) -> list[str]:
    """Takes (agreement_id, name, value, ordinal) rows into a bucket's agreements; those of which a context goes out.

    ``kept`` has of each agreement its revision, what is held, and the millisecond up to which it is kept.
    """
    won = {}
    for part in parts:  # batch by batch: the rows of a bucket needn't fit together
        come = defaultdict(list)
        for agreement, *row in part:
            come[agreement].append(row)
        for agreement, rows in come.items():
            own = kept.setdefault(agreement, [0, {}, until])
            own[2] = until
            if latest_values(own[1], rows):
                won[agreement] = own
    due = [a for a, own in won.items() if all(n in own[1] for n in names)]
    for agreement in due:
        kept[agreement][0] += 1
    return due


def _by_text(kind: str, column: Column) -> tuple[Column, Column]:
    """Ids of this type as texts that tell them apart, and back."""
    text = F.col("agreement_id")
    if kind == "binary":
        return F.hex(column), F.unhex(text)
    if kind == "timestamp":  # an hour of the clock may come twice
        return F.unix_micros(column).cast("string"), F.timestamp_micros(text.cast("long"))
    if kind in ("float", "double"):  # -0.0 is 0.0
        column = F.when(column == 0, F.lit(0).cast(kind)).otherwise(column)
    return column.cast("string"), text.cast(kind)


def context_stream(extractions: DataFrame, needed: list[str], forget: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """agreement_id, revision (from 1), fields: a row when an agreement is complete and at each later change.

    ``extractions`` is a stream of agreement_id, name, value, ordinal; names outside ``needed`` and nulls are
    left out before the shuffle. With ``forget``, a duration such as ``30 days``, the state of an agreement that has
    got nothing for so long is dropped; what comes after begins a new context.

    A Python call takes milliseconds whatever it does, so agreements share their calls: each belongs to one of ``buckets``
    by a hash of its id, and a bucket's state holds its agreements. A batch writes the states of the buckets it meets:
    streams of very many agreements in small batches want more buckets. Their number stays with the checkpoint.
    """
    names = sorted(set(needed))
    kind = extractions.schema["agreement_id"].dataType.simpleString()
    as_text, back = _by_text(kind, F.col("agreement_id"))
    rows = extractions.filter(F.col("name").isin(names) & F.col("value").isNotNull() & F.col("agreement_id").isNotNull()).select(as_text.alias("agreement_id"), "name", F.col("value").cast("string").alias("value"), F.col("ordinal").cast("double").alias("ordinal"))
    wait = extractions.sparkSession.sql(f"SELECT unix_millis(timestamp_micros(0) + INTERVAL '{forget}')").first()[0] if forget else None

    def update(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentProcessingTimeMs()
        due = take_in(kept, (zip(*(part[c].tolist() for c in ("agreement_id", "name", "value", "ordinal")), strict=True) for part in parts), names, now + wait if wait else None)
        if wait:
            for agreement in [a for a, (_, _, until) in kept.items() if until < now]:
                del kept[agreement]
        if kept:
            state.update((json.dumps(kept),))
            if wait:
                state.setTimeoutDuration(max(1, min(until for _, _, until in kept.values()) - now))
        else:
            state.remove()
        if due:
            yield pd.DataFrame({"agreement_id": due, "revision": [kept[a][0] for a in due], "fields": [{n: v for n, (_, v) in sorted(kept[a][1].items())} for a in due]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("agreement_id"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(update, OUT, "held string", "append", timeout)
    return out.withColumn("agreement_id", back)


def contexts(emitted: DataFrame) -> DataFrame:
    """What ``context_stream`` emits, as alignment takes it: agreement_id, revision, fields as typed values, and no clauses."""
    from ..functions.predicates import CLAUSE_TYPE

    fields = F.map_from_entries(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), typed_field(e["value"], "string").alias("value"))))
    none = F.lit(None)
    return emitted.select("agreement_id", "revision", fields.alias("fields"), F.array().cast(f"array<{CLAUSE_TYPE}>").alias("clauses"), F.struct(none.cast("string").alias("id"), none.cast("string").alias("name")).alias("domain"), F.struct(none.cast("double").alias("value"), none.cast("string").alias("party_role")).alias("doc"))


def latest(emitted: DataFrame) -> DataFrame:
    """The last context of each agreement."""
    return emitted.groupBy("agreement_id").agg(F.max_by(F.struct("revision", "fields"), "revision").alias("c")).select("agreement_id", "c.*")
