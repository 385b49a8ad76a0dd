"""Evaluation contexts: one row per agreement, from long tables of extractions and clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import FIELD_TYPE
from ..functions.scalars import safe_double


def typed_field(value: Column, kind: str) -> Column:
    """A field's value with its kind; null values give a null field."""
    text = value.cast("string")
    number = safe_double(text) if kind == "string" else value.cast("double")
    flag = value if kind == "bool" else F.lit(None).cast("boolean")
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("s"), number.alias("d"), flag.alias("b"))).cast(FIELD_TYPE)


def build(extractions: DataFrame, clauses: DataFrame, names: list[str] | None = None, of_clause: tuple[str, ...] = ("id", "label", "text", "embedding")) -> DataFrame:
    """``extractions``: agreement_id, name, value, ordinal; ``clauses``: agreement_id, id, label, text, ordinal, embedding.

    Of a field's several values the last counts. ``names`` limits the fields to those that rules ask
    for, ``of_clause`` the columns of clauses, so the rest is never read or shuffled.
    """
    if names is not None:
        extractions = extractions.filter(F.col("name").isin(sorted(names)))
    last = extractions.filter("value is not null").groupBy("agreement_id", "name").agg(F.max_by("value", "ordinal").alias("value"))
    fields = last.groupBy("agreement_id").agg(F.map_from_entries(F.collect_list(F.struct("name", typed_field(F.col("value"), "string")))).alias("fields"))
    item = F.struct("ordinal", *(F.col(c).alias(c) if c in of_clause else F.lit(None).cast(clauses.schema[c].dataType).alias(c) for c in ("id", "label", "text", "embedding")))
    lists = clauses.groupBy("agreement_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    lists = lists.select("agreement_id", F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["label"].alias("label"), c["text"].alias("text"), c["embedding"].alias("embedding"))).alias("clauses"))
    return lists.join(fields, "agreement_id", "full")
