"""Texts cut into clauses at their numbered headings, with the path of headings above each.

Lines are looked at one by one where the texts are read; what is shuffled of a line is its length and,
if it is a heading, its level and number. Running sums of the lengths give offsets, running maxima of
places the headings that a clause lies under. Texts themselves move only when clauses ask for theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of headings by what a line begins with, and the levels they stand on. Decimal numbers take
# the level of their parts, from that of the first part on; deeper ones share the last of these levels.
ARTICLE = r"^\s*(?:ARTICLE|Article|SECTION|Section|CHAPTER|Chapter)\s+([0-9]+|[IVXLC]+)\b"
DECIMAL = r"^\s*([0-9]{1,4}(?:\.[0-9]{1,4})*)[.)]?\s+[^\s0-9]"
LETTER = r"^\s*\(([a-hj-uw-z])\)\s"
ROMAN = r"^\s*\(([ivx]+)\)\s"
ARTICLE_LEVEL, FIRST_DECIMAL, LAST_DECIMAL, LETTER_LEVEL, ROMAN_LEVEL = 1, 2, 8, 9, 10
LEVELS = ROMAN_LEVEL


def heading(line: Column) -> tuple[Column, Column]:
    """A line's level and number; null and an empty text if it is no heading."""
    numbers = [F.regexp_extract(line, pattern, 1) for pattern in (ARTICLE, DECIMAL, LETTER, ROMAN)]
    deep = F.least(F.lit(FIRST_DECIMAL - 1) + F.size(F.split(numbers[1], r"\.")), F.lit(LAST_DECIMAL))
    level, number = F.lit(None).cast("int"), F.lit("")
    for n, l in reversed(list(zip(numbers, (F.lit(ARTICLE_LEVEL), deep, F.lit(LETTER_LEVEL), F.lit(ROMAN_LEVEL)), strict=True))):
        level, number = F.when(n != "", l).otherwise(level), F.when(n != "", n).otherwise(number)
    return level, number


def segments(texts: DataFrame, row: str, text: str) -> DataFrame:
    """row, ordinal, level, path, start, length: the clauses of each text, in code points.

    ``row`` tells the rows apart. A clause goes from a heading to the next one; what comes before the first
    heading is a clause of level 0 without a path, if there is anything. ``path`` joins the numbers of the
    headings above and the clause's own by `` > ``. A heading closes those of its level and deeper ones.

    The clauses of a text, put together, are the text: no character is left out or twice. Null and empty
    texts have no clause.
    """
    lines = texts.select(F.col(row).alias("row"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    level, number = heading(F.col("line"))
    marked = lines.select("row", "at", (F.length("line") + 1).alias("size"), level.alias("level"), number.alias("number"))
    # What lies between two headings is summed up before it moves.
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    ends = F.max(F.col("start") + F.col("size") - 1).over(Window.partitionBy("row"))  # the last line has no line feed
    heads = placed.withColumn("end", ends).filter("level is not null or (at = 0 and end > 0)").withColumn("level", F.coalesce("level", F.lit(0)))
    up_to = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("level") == k, F.struct("at", "number"))).over(up_to) for k in range(1, LEVELS + 1)]
    heads = heads.select("row", "at", "level", "start", "end", *(c.alias(f"__l{k}") for k, c in enumerate(last, 1)))
    above, closed = [], F.lit(-1)
    for k in range(1, LEVELS + 1):  # a level's last heading counts if none of a higher level came after it
        there = (F.col("level") >= k) & F.coalesce(F.col(f"__l{k}.at") > closed, F.lit(False))
        above.append(F.when(there, F.col(f"__l{k}.number")))
        closed = F.greatest(closed, F.coalesce(F.col(f"__l{k}.at"), F.lit(-1)))
    ordered = Window.partitionBy("row").orderBy("at")
    return heads.select(
        F.col("row").alias(row), (F.row_number().over(ordered) - 1).alias("ordinal"), "level", F.concat_ws(" > ", *above).alias("path"),
        F.col("start").cast("long").alias("start"), (F.coalesce(F.lead("start").over(ordered), F.col("end")) - F.col("start")).cast("long").alias("length"),
    )


def clauses(texts: DataFrame, row: str, text: str) -> DataFrame:
    """``segments`` with each clause's text."""
    found = segments(texts, row, text)
    whole = texts.select(row, F.col(text).alias("__text"))
    return found.join(whole, row).select(*found.columns, F.substring("__text", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("clause"))
