"""Personal data: fixed base patterns, widened by bootstrapped contextual extraction.

One pass over the texts finds the base entities and every other number, of one or several tokens,
each with the words around it. The base entities are seeds. Over the small table of mentions, Spark
then scores the graph between lexical patterns (the words around, whatever stands between them) and
instances (the values): a pattern is as sure as the scores of its distinct instances add up to, out
of their number and a little more, so that few instances don't make one sure; an instance is as sure
as its best pattern. Sure patterns turn their unseen instances into new seeds, and
the next round scores again.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, read, text_or_empty

# The kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that starts inside a run of digits would have begun at the run's start: the look-behind only saves the retries.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A run of tokens with digits is a possible identifier from this many digits on.
LEAST_DIGITS = 5
#: Longer words of a context are told by their digest.
LONGEST_WORD = 64
#: What makes a pattern sure: the share of its distinct instances that are known, with as many unknown
#: ones added as support, and at least so many seeds among them.
SURE = 0.6
SUPPORT = 2
LEAST_SEEDS = 5

#: Tokens with digits that only blanks part; a token that ends a clause ends the run.
_TOKEN = re.compile(r"(?<!\S)\S*[0-9]\S*")
_TOKENS = re.compile(_TOKEN.pattern + r"(?:(?<![.,;:!?])[\x20\t]+\S*[0-9]\S*)*")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: the local part's run before it, not reaching into the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that fail their test are dropped."""
    out = [("email", *span) for span in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


class Words:
    """The runs of letters of a text, for the contexts of its mentions; found when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int]] | None = None
        self.known: dict[tuple[int, int], str] = {}

    def word(self, start: int, end: int) -> str:
        """In lower case; long ones by their digest, so that many mentions beside one cost no more than beside a short one."""
        found = self.known.get((start, end))
        if found is None:
            found = self.text[start:end].lower()
            found = self.known[start, end] = found if len(found) <= LONGEST_WORD else _digest(found)
        return found

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """The two words before and the one after a mention, which may begin or end within a word."""
        if self.spans is None:
            self.spans = [m.span() for m in _LETTERS.finditer(self.text)]
        k = bisect_left(self.spans, (start, 0))
        before = [self.word(s, min(e, start)) for s, e in self.spans[max(0, k - 2) : k]]
        k = max(0, bisect_left(self.spans, (end, 0)) - 1)
        after = [self.word(max(s, end), e) for s, e in self.spans[k : k + 2] if e > end][:1]
        return before, after

    def patterns(self, start: int, end: int) -> list[str]:
        """The two words before; the word before and the word after."""
        before, after = self.around(start, end)
        out = []
        if len(before) == 2:
            out.append(f"{before[0]} {before[1]} _")
        if before and after:
            out.append(f"{before[-1]} _ {after[0]}")
        return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str | None, int, int, str, list[str]]]:
    """(kind, start, end, digest of the value, patterns) of base entities and, without a kind, of other possible identifiers."""
    taken, known = sorted((s, e) for _, s, e in base), Words(text)
    for kind, s, e in base:
        yield kind, s, e, _digest(text[s:e]), known.patterns(s, e)
    free = lambda s, e, k: not any(a < e and s < b for a, b in taken[k : k + 4])
    k = 0
    for m in _TOKENS.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        # Beside a base entity, each token of the run is by itself.
        for part in [m] if free(*m.span(), k) else _TOKEN.finditer(text, *m.span()):
            value = part.group()
            if sum(map(str.isdigit, value)) < LEAST_DIGITS:
                continue
            inner = value.strip("\"'`.,;:!?()[]{}<>*&%$#|=")
            s = part.start() + value.find(inner)
            e = s + len(inner)
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            if inner and free(s, e, k):
                yield None, s, e, _digest(inner), known.patterns(s, e)


def _digest(value: str) -> str:
    """Scratch tables hold no personal data, only digests of it."""
    return hashlib.sha256(value.encode()).hexdigest()[:32]


_SCAN = pa.schema(
    [
        ("row", pa.int64()),
        ("id", pa.string()),
        *((f"n_{k}", pa.int64()) for k in KINDS),
        ("base", pa.string()),
        ("mentions", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))),
    ]
)
_SCAN_DDL = "row long, id string, " + "".join(f"n_{k} long, " for k in KINDS) + "base string, mentions array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 33

    def rows() -> Iterator[tuple]:
        nonlocal n
        for batch in it:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                found = [dict(zip(("kind", "start", "end", "value", "patterns"), m, strict=True)) for m in mentions(text, base)]
                yield n, id_, *counts, ",".join(f"{k}:{s}:{e}" for k, s, e in base), found
                n += 1

    yield from batches(_SCAN, rows())


def bootstrap(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """(value, kind) of unseen identifiers that sure patterns extract; ``seen`` has kind, value, pattern."""
    edges = scratch.table(seen.select("pattern", "value").distinct(), "edges")
    seeds = scratch.table(seen.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0)), "instances-0")
    sizes = scratch.table(edges.groupBy("pattern").agg(F.count("*").alias("size")), "sizes")
    # Scores, to six places, only ever rise, and so does what is sure: rounds end once their sum stays.
    scores, before = seeds, None
    for k in itertools.count(1):
        known = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("seeds"))
        sure = known.join(sizes, "pattern").withColumn("sureness", F.col("sum") / (F.col("size") + SUPPORT)).filter((F.col("sureness") >= SURE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", "kind", "sureness")
        sure = scratch.table(sure, f"patterns-{k}")
        found = edges.join(sure, "pattern").groupBy("value", "kind").agg(F.round(F.max("sureness"), 6).alias("score"))
        found = found.join(seeds.select("value"), "value", "left_anti").select("value", "kind", "score")
        scores = scratch.table(seeds.unionByName(found), f"instances-{k}")
        now = scores.agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("sum")).first()
        if now == before:
            break
        before = now
        scratch.drop(f"patterns-{k}", *([f"instances-{k - 1}"] if k > 1 else []))
    # A value that two kinds claim goes to the one that is surer, then first in the list.
    order = F.expr("array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), kind)")
    best = scores.join(seeds.select("value"), "value", "left_anti")
    return best.groupBy("value").agg(F.max_by("kind", F.struct("score", -order)).alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row, over its whole text.

    The counts and the digest are of base entities; ``spans`` also lists what the method adds.
    Offsets are code points.

    Defined results: a null text counts as empty and has no spans; repeated rows each get their row;
    an empty table gives an empty result; other columns are not read; a value claimed by two kinds
    goes to the surer one.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    rows = scratch.table(source.mapInArrow(_scan, _SCAN_DDL), "rows")
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    found = bootstrap(each.select("kind", "value", F.explode("patterns").alias("pattern")), scratch)
    added = each.filter("kind is null").drop("kind").join(found, "value")
    added = scratch.table(added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")), "added")
    scratch.keep("rows", "added")
    listed = rows.select("row", F.col("id").cast(id_type).alias(id_col), *(f"n_{k}" for k in KINDS), "base").join(added, "row", "left")
    extra = F.coalesce("added", F.expr("array()").cast("array<struct<kind:string,start:int,end:int>>"))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[0].alias("kind"), F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(F.concat(base, extra), lambda x: F.struct(F.array_position(kinds, x["kind"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    spans = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return listed.select(id_col, *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def op7_pii(spark, sf_dir):
    return find_pii(read(spark, sf_dir, "documents"))
