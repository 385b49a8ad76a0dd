"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic texts and from texts nobody labelled. The risk of
calling unlabelled text toxic is corrected by the class prior, since unlabelled text holds toxic
text too: ``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``. Where the corrected part of a
step turns negative, the step goes back up along it, as the non-negative estimator prescribes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, read, text_or_empty

#: Bounds of the training sample: rows with the lowest hash of the id.
POSITIVE_ROWS = 1500
UNLABELLED_ROWS = 4000
BUCKETS = 1 << 20
CACHE_WORDS = 400_000
#: Added to a text's number of distinct words, so that one word doesn't decide a short text alone.
SMOOTH = 4
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6)
#: Brings the features to the size of the weights.
SCALE = 8.0
#: Features in fewer texts of the sample are left out: they tell texts apart, not kinds of text.
LEAST_TEXTS = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def buckets(token: str) -> tuple[int, ...]:
    """The hashed buckets of a white-space token: its word and the word's beginnings; none without letters."""
    word = "".join(_LETTERS.findall(token)).lower()
    if not word:
        return ()
    parts = [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return tuple(zlib.crc32(part.encode()) % BUCKETS for part in parts)


def features(texts: list[str]) -> tuple[list[list[int]], list[list[float]]]:
    """Buckets of each text: how many of its distinct tokens have one, over the root of their number."""
    known: dict[str, tuple[int, ...]] = {}
    columns, values = [], []
    for text in texts:
        counts: Counter[int] = Counter()
        n = 0
        for token in set(text.split()):
            found = known.get(token)
            if found is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                found = known[token] = buckets(token)
            n += bool(found)
            counts.update(found)
        columns.append(list(counts))
        values.append([SCALE * c / math.sqrt(n + SMOOTH) for c in counts.values()])
    return columns, values


class Rows:
    """Sparse rows as flat arrays."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, columns)])
        self.columns = np.concatenate([*columns, np.empty(0, np.int64)]).astype(np.int64)
        self.values = np.concatenate([*values, np.empty(0)]).astype(np.float64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def take(self, rows: np.ndarray) -> Rows:
        out = Rows([], [])
        sizes = self.ends[rows + 1] - self.ends[rows]
        out.ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ends[rows] - out.ends[:-1], sizes) + np.arange(out.ends[-1])
        out.columns, out.values = self.columns[at], self.values[at]
        return out

    def only(self, used: np.ndarray) -> Rows:
        """The columns in ``used``, renumbered by their place in it."""
        out, kept = Rows([], []), np.isin(self.columns, used)
        out.ends = np.concatenate([[0], np.cumsum(kept)])[self.ends]
        out.columns, out.values = np.searchsorted(used, self.columns[kept]), self.values[kept]
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        parts = np.concatenate([[0.0], np.cumsum(self.values * weights[self.columns])])
        return parts[self.ends[1:]] - parts[self.ends[:-1]]

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """The transposed product: each row's value times its values, summed by column."""
        return np.bincount(self.columns, np.repeat(values, np.diff(self.ends)) * self.values, size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scales(positive: Rows, unlabelled: Rows, prior: float, size: int) -> np.ndarray:
    """How telling a column is: log ratio of its share among toxic texts to that among the others.

    The others' share is the unlabelled one without the toxic part that the prior puts there.
    """
    toxic = np.bincount(positive.columns, minlength=size) / len(positive)
    mixed = np.bincount(unlabelled.columns, minlength=size) / len(unlabelled)
    clean = np.maximum(mixed - prior * toxic, 0) / max(1 - prior, 1e-6)
    least = 3 / len(positive)
    return np.log((toxic + least) / (clean + least))


def risk(positive: Rows, unlabelled: Rows, prior: float, w: np.ndarray) -> tuple[float, float]:
    """``prior * R_p(+1)`` and the corrected ``R_u(-1) - prior * R_p(-1)``, for weights with the bias last.

    The loss is the sigmoid one: ``l(+1) = 1 - g`` and ``l(-1) = g`` for the score ``g``.
    """
    gp, gu = _sigmoid(positive.dot(w) + w[-1]).mean(), _sigmoid(unlabelled.dot(w) + w[-1]).mean()
    return prior * (1 - gp), gu - prior * gp


def step(positive: Rows, unlabelled: Rows, prior: float, w: np.ndarray) -> np.ndarray:
    """The gradient to go down along: of the whole risk or, where its corrected part is negative, of that part's negative."""
    gp, gu = _sigmoid(positive.dot(w) + w[-1]), _sigmoid(unlabelled.dot(w) + w[-1])
    slope_p, slope_u = gp * (1 - gp) / len(gp), gu * (1 - gu) / len(gu)
    if gu.mean() - prior * gp.mean() < 0:  # the corrected risk can't be negative: step back up
        to_p, to_u = prior * slope_p, -slope_u
    else:
        to_p, to_u = -2 * prior * slope_p, slope_u
    size = len(w) - 1
    return np.append(positive.spread(to_p, size) + unlabelled.spread(to_u, size), to_p.sum() + to_u.sum())


def train(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 60, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias: Adam over mini-batches of the non-negative risk; the mean over the later half of the epochs."""
    if not len(positive) or not len(unlabelled):
        return np.zeros(BUCKETS), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    used, seen = np.unique(np.concatenate([positive.columns, unlabelled.columns]), return_counts=True)
    used = used[seen >= LEAST_TEXTS]
    size = len(used)
    positive, unlabelled = positive.only(used), unlabelled.only(used)
    scales = _scales(positive, unlabelled, prior, size)
    for rows in (positive, unlabelled):
        rows.values = rows.values * scales[rows.columns]
    w = np.append(np.full(size, 0.3), -2.0)
    m, v, total = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rng, steps, t = np.random.default_rng(seed), max(4, len(unlabelled) // 500), 0
    for epoch in range(epochs):
        ps, us = (np.array_split(rng.permutation(len(rows)), steps) for rows in (positive, unlabelled))
        for pi, ui in zip(ps, us, strict=True):
            if not len(pi) or not len(ui):
                continue
            grad = step(positive.take(pi), unlabelled.take(ui), prior, w)
            grad[:-1] += decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if epoch >= epochs // 2:
            total += w
    w = total / (epochs - epochs // 2)
    full = np.zeros(BUCKETS)
    full[used] = w[:-1] * scales
    return full, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> tuple[np.ndarray, float]:
    """Trains on a bounded sample of confirmed toxic rows and of rows without a label.

    ``prior`` is the share of toxic texts; if not given, that of the labelled rows. Without toxic
    rows or without unlabelled ones the model is the prior alone. Of rows that repeat an id, or are
    labelled more than once, one counts; toxic if any label says so.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    if prior is None:
        prior = marks.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    positive = marks.filter("y = 1").select("id").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(POSITIVE_ROWS)
    unlabelled = docs.select(F.col(id_col).alias("id")).filter("id is not null").join(marks.select("id"), "id", "left_anti").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(UNLABELLED_ROWS)
    chosen = [(r.id, True) for r in positive.collect()] + [(r.id, False) for r in unlabelled.collect()]
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, f"id {id_type}, positive boolean")
    # At most POSITIVE_ROWS + UNLABELLED_ROWS rows of an id and a flag: safe to broadcast.
    # Of rows that repeat an id the smallest text counts, so that the sample keeps its bound.
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy("id", "positive").agg(F.min("text").alias("text")).select("positive", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns, values = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["positive", "columns", "values"])

    got = texts.mapInArrow(run, "positive boolean, columns array<int>, values array<float>").toArrow()
    flags = np.array(got.column("positive").to_pylist(), bool)
    columns = [np.array(c or [], np.int64) for c in got.column("columns").to_pylist()]
    values = [np.array(s or [], np.float64) for s in got.column("values").to_pylist()]
    order = sorted(range(len(flags)), key=lambda i: (columns[i].tolist(), values[i].tolist()))  # the same model whatever the order of arrival
    pick = lambda want: Rows([columns[i] for i in order if flags[i] == want], [values[i] for i in order if flags[i] == want])
    return train(pick(True), pick(False), prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", modulus: int = 5) -> DataFrame:
    """id, held_out, score and predicted for every whole text.

    Defined results: a null or empty text gets the model's score for no words; repeated rows each
    get their row; an empty table gives an empty result; other columns are not read.
    """
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((np.append(weights, 0.0).astype(np.float32), bias))  # BUCKETS floats: a fixed size
    source = docs.select(F.col(id_col), (fold(id_col, modulus) == 0).alias("held_out"), text_or_empty(text_col).alias("__text"))
    id_type = source.schema.fields[0].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, b = shared.value

        class Weights(dict):
            def __missing__(self, token: str) -> complex:
                # The weights' sum, and 1 for a word: one sum gives both the total and the number of words.
                own = buckets(token)
                found = complex(sum(float(table[at]) for at in own), 1.0) if own else 0j
                if len(self) >= CACHE_WORDS:
                    self.clear()
                if len(token) <= 64:
                    self[token] = found
                return found

        known = Weights()
        for batch in it:
            scores = []
            for text in batch.column(2).to_pylist():
                total = sum(map(known.__getitem__, set(text.split())), 0j)
                scores.append(1 / (1 + math.exp(-max(-40.0, min(40.0, SCALE * total.real / math.sqrt(total.imag + SMOOTH) + b)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=[id_col, "held_out", "score", "predicted"],
            )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def op6_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    train_fold = fold("doc_id", 5) != 0
    return score(docs, learn(docs.filter(train_fold), labels.filter(train_fold)))
