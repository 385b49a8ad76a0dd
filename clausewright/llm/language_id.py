"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled running text gives, at any point of another text,
the longest match with that language. Cutting a text from left to right into such longest matches
counts its phrases; a phrase costs the logarithm of the labelled text's length, and the language
whose phrases cost least wins. Texts are normalised to lower-case runs of letters between single
blanks and parsed as UTF-8 bytes, across words, so that common words and pairs of words count.

Many texts are parsed side by side: a step takes the next byte of each through one table of all
languages' transitions. Once few long texts are left they go on one by one from where they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, read, small, text_or_empty

UNDETERMINED = "und"
#: The labelled sample: so many rows of each language, lowest hash of the id first, of at most so many
#: characters (where a language has none as short, its shortest text).
SAMPLE_ROWS = 16
SAMPLE_LONGEST = 4096
#: Characters of all samples together, shared evenly among the languages, whatever their number: they bound
#: the table in a worker. Where the share is smaller than a text, an excerpt of the text is the sample.
SAMPLE_CHARS = 192 << 10
#: Shorter samples count as this many bytes: else a phrase of a hardly known language would cost too little.
LEAST_BYTES = 4096
#: Bytes of text that are parsed side by side, and the texts times languages below which one by one is faster.
SIDE_BY_SIDE = 2 << 20
FEW = 96

_LETTERS = re.compile(r"[^\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-case runs of letters, each between blanks; nothing without letters. Numerals such as fractions are no letters."""
    runs = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return f" {' '.join(runs)} ".encode() if runs else b""


class SuffixAutomaton:
    """All substrings of a byte string."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def longest(self, text: bytes, start: int) -> int:
        """Length of the longest match of ``text[start:]`` with a substring."""
        state, nxt = 0, self.next
        for at in range(start, len(text)):
            state = nxt[state].get(text[at], -1)
            if state < 0:
                return at - start
        return len(text) - start


class Languages:
    """The automata of all languages as one table: a row a state, a column a byte that occurs, -1 for no match."""

    def __init__(self, samples: tuple[tuple[str, tuple[str, ...]], ...]):
        known = [(name, b"".join(map(normalised, texts))) for name, texts in samples]
        known = [(name, text) for name, text in known if text]  # a language known by name only can't be told
        self.names = [name for name, _ in known]
        self.bits = np.array([math.log2(max(LEAST_BYTES, len(text))) for _, text in known])
        used = np.unique(np.frombuffer(b"".join(text for _, text in known), np.uint8))
        self.width = len(used) + 1  # the last column: bytes of no language
        self.code = np.full(256, len(used), np.uint8)
        self.code[used] = np.arange(len(used))
        code, tables, at = self.code.tolist(), [], 0
        self.roots = np.zeros(len(known), np.int32)
        for k, (_, text) in enumerate(known):  # one after the other: an automaton is many small objects
            nxt = SuffixAutomaton(text).next
            table = np.full((len(nxt), self.width), -1, np.int32)
            table[np.repeat(np.arange(len(nxt)), [len(n) for n in nxt]), [code[c] for n in nxt for c in n]] = np.array([t for n in nxt for t in n.values()], np.int32) + at
            self.roots[k] = at
            at += len(nxt)
            tables.append(table)
        self.table = np.concatenate([t.ravel() for t in tables] or [np.empty(0, np.int32)])
        # Where a text goes on after a match has ended before a byte; at the root itself the next byte begins a phrase, too.
        start = self.table.reshape(-1, self.width)[self.roots]
        self.after = np.where(start < 0, self.roots[:, None], start)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many longest matches (or bytes without a match) each text is cut into, by language."""
        n = len(self.names)
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        lengths = np.array([len(texts[k]) for k in order], np.int64)
        codes = self.code[np.frombuffer(b"".join(texts[k] for k in order), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        counts = np.zeros((n, len(texts)), np.int64)
        state = np.repeat(self.roots[:, None], len(texts), axis=1)
        roots, language = self.roots[:, None], np.arange(n)[:, None] * self.width
        after, live, at = self.after.ravel(), len(texts), 0
        falling = (-lengths).tolist()
        while live and lengths[0] > at:
            while live and -falling[live - 1] <= at:
                live -= 1
            if live * n <= FEW:
                break
            c = codes[starts[:live] + at]
            s = state[:, :live]
            t = self.table[s * self.width + c]
            ended = t < 0
            counts[:, :live] += ended | (s == roots)
            state[:, :live] = np.where(ended, after[language + c], t)
            at += 1
        for k in range(live):
            own = codes[starts[k] + at : starts[k] + lengths[k]].tobytes()
            for j in range(n):
                counts[j, k] += self._count(own, int(state[j, k]), j)
        out = np.empty_like(counts)
        out[:, order] = counts
        return out

    def _count(self, codes: bytes, state: int, language: int) -> int:
        table, width, root, after = memoryview(self.table), self.width, int(self.roots[language]), self.after[language].tolist()
        n = 0
        for c in codes:
            t = table[state * width + c]
            if t < 0:
                n += 1
                state = after[c]
            else:
                n += state == root
                state = t
        return n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and a score from 0 to 1 of each text; ``und`` and 0 for a text without letters."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.names:
            return out
        todo: list[tuple[int, bytes]] = []
        held = 0
        for k, text in enumerate(texts):
            norm = normalised(text) if text else b""
            if norm:
                todo.append((k, norm))
                held += len(norm)
            if held >= SIDE_BY_SIDE:
                self._settle(todo, out)
                todo, held = [], 0
        self._settle(todo, out)
        return out

    def _settle(self, todo: list[tuple[int, bytes]], out: list[tuple[str, float]]) -> None:
        if not todo:
            return
        costs = self.phrases([text for _, text in todo]) * self.bits[:, None]
        by_name = sorted(range(len(self.names)), key=self.names.__getitem__)
        best = np.array(by_name)[costs[by_name].argmin(axis=0)]
        least = costs[best, np.arange(len(todo))]
        # How much dearer the others are, relative to the winner, as a share.
        score = 1 / np.exp(-10 * (costs / least - 1)).sum(axis=0)
        for (k, _), b, x in zip(todo, best.tolist(), score.tolist(), strict=True):
            out[k] = self.names[b], x


@lru_cache(maxsize=1)
def _languages(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> Languages:
    return Languages(samples)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(language, sample texts) pairs: for each language the rows with the lowest hash of the id.

    The sample is bounded by ``SAMPLE_ROWS`` rows of at most ``SAMPLE_LONGEST`` characters a language and
    ``SAMPLE_CHARS`` in all, of which every language gets the same share; about three times that reaches the
    driver at any input size, and a count per language. Rows of one id count once.
    """
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null").withColumn("short", F.length("text") <= SAMPLE_LONGEST)
    counts = rows.groupBy("lang").agg(F.count_if("short").alias("fit")).collect()
    if not counts:
        return ()
    room = max(64, SAMPLE_CHARS // len(counts))
    wanted = min(SAMPLE_ROWS, max(1, room // 64))
    excerpt = F.substring("text", 1, room).alias("text")
    # The hash below which a language has about three times the wanted rows: one scan serves all languages.
    span = 1 << 64
    limits = {r.lang: -(1 << 63) + min(span - 1, span * 3 * wanted // r.fit) for r in counts if r.fit}
    chosen = []
    if limits:
        table = labelled.sparkSession.createDataFrame(sorted(limits.items()), "lang string, most long")  # a row a language
        chosen = rows.filter("short").join(small(table), "lang").filter("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", excerpt).collect()
    told = {c.lang for c in chosen}
    if missing := [r.lang for r in counts if r.lang not in told]:
        # Only long texts, or none with so low a hash: the shortest one, then the lowest hash.
        table = labelled.sparkSession.createDataFrame([(m,) for m in missing], "lang string")
        shortest = rows.join(small(table), "lang").groupBy("lang").agg(F.min(F.struct(F.length("text").alias("size"), "h", excerpt)).alias("best"))
        chosen += shortest.select("lang", "best.h", "best.text").collect()
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for c in chosen:
        by_lang.setdefault(c.lang, []).append((c.h, c.text))
    out = []
    for name in sorted(by_lang):
        texts = [t for _, t in sorted(by_lang[name])[:wanted]]
        ends = np.cumsum([len(t) for t in texts])
        out.append((name, tuple(texts[: max(1, int((ends <= room).sum()))])))
    return tuple(out)


def predict(docs: DataFrame, samples: tuple[tuple[str, tuple[str, ...]], ...], id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of ``extra``, lang_pred and score for every whole text.

    Defined results: ``und`` with score 0 for a null text, a text without a letter, or where no
    language was learned; equal costs go to the language first in the alphabet; repeated rows each
    get their row; an empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.struct(F.col(id_col).alias("id"), *(c.alias(f"c{k}") for k, c in enumerate((extra or {}).values()))).alias("kept"), text_or_empty(text_col).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = _languages(samples)
        for batch in it:
            got = languages.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["kept", "lang_pred", "score"])

    told = source.mapInArrow(run, f"kept {source.schema['kept'].dataType.simpleString()}, lang_pred string, score double")
    return told.select(F.col("kept.id").alias(id_col), *(F.col(f"kept.c{k}").alias(n) for k, n in enumerate(extra or {})), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row."""
    held_out = fold(id_col, 4) == 2
    samples = learn(docs.filter(~held_out), id_col, text_col, lang_col)
    return predict(docs, samples, id_col, text_col, {"held_out": held_out})


def op3_language_id(spark, sf_dir):
    return identify(read(spark, sf_dir, "documents"))
