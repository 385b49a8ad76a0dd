"""Macro and micro clusters of clause vectors, and how coherent clusters are.

Vectors are compared by their direction: they are scaled to length one first. Every step is one pass
over the vectors in which a task sums up what it has read and gives a row per cluster; the driver holds
centroids only, whose number is a parameter. Everything that looks random is a digest of the vector's id
and the round, so the same vectors give the same clusters however they are partitioned, but for the
last bits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stored import stored


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _uniform(id_: Column, salt: str) -> Column:
    """A number from 0 to 1 that id and salt decide."""
    return F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(":" + salt))), 1, 13), 16, 10).cast("double") / float(1 << 52)


@dataclass
class Clusters:
    """``centroids`` of the macro clusters; ``split``: by a cluster's path the two centroids of its halves."""

    centroids: np.ndarray
    split: dict[str, np.ndarray] = field(default_factory=dict)

    def paths(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Each row's path, such as 3 or 3.0.1, and its squared distance to the centroid there; ties go to the first."""
        d = _distances(x, self.centroids)
        nearest = d.argmin(axis=1)
        paths, best = np.array([str(k) for k in range(len(self.centroids))], object)[nearest], d[np.arange(len(x)), nearest]
        for path in sorted(self.split, key=len):
            own = np.flatnonzero(paths == path)
            if len(own):
                d = _distances(x[own], self.split[path])
                half = d.argmin(axis=1)
                paths[own] = np.array([f"{path}.0", f"{path}.1"], object)[half]
                best[own] = d[np.arange(len(own)), half]
        return paths.tolist(), best


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as the differences' squares: no digits are lost where they are small."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _vectors(vectors: DataFrame, id_: str, embedding: str) -> DataFrame:
    return vectors.select(F.col(id_).alias("id"), F.col(embedding).cast("array<double>").alias("x")).filter("x is not null and size(x) > 0")


def assign(vectors: DataFrame, clusters: Clusters, id_: str, embedding: str) -> DataFrame:
    """id, path, distance (squared, of the scaled vector to its centroid). Null vectors belong nowhere and get no row."""
    rows = _vectors(vectors, id_, embedding)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                paths, d = clusters.paths(unit(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(d)], names=["id", "path", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, path string, distance double").withColumnRenamed("id", id_)


def _sums(rows: DataFrame, clusters: Clusters) -> dict[str, tuple[int, np.ndarray]]:
    """By path the number of vectors and their sum: a row per task and cluster, then a row per cluster and dimension."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in it:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                paths = np.array(clusters.paths(x)[0], object)
                for path in np.unique(paths.astype(str)):
                    own = x[paths == path]
                    got = held.setdefault(str(path), [0, 0.0])
                    got[0] += len(own)
                    got[1] = got[1] + own.sum(axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=["path", "n", "s"])

    parts = rows.select("id", "x").mapInArrow(run, "path string, n long, s array<double>")
    each = parts.select("path", "n", F.posexplode("s").alias("at", "v")).groupBy("path", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out: dict[str, tuple[int, np.ndarray]] = {}
    for path in {r.path for r in each}:
        own = sorted((r.at, r.v, r.n) for r in each if r.path == path)
        out[path] = own[0][2], np.array([v for _, v, _ in own])
    return out


def seeds(rows: DataFrame, k: int, rounds: int = 5) -> np.ndarray:
    """k-means||: each round takes vectors in proportion to their squared distance from those taken so far, about 2k of them.

    The vectors taken, whose number is about 2k a round at any input size, are weighted by the vectors
    nearest to each; the heaviest one and then whatever adds most weight times distance are the seeds.
    """
    first = rows.withColumn("u", _uniform(F.col("id"), "first")).agg(F.min(F.struct("u", F.col("id").cast("string").alias("name"), "x")).alias("row")).first().row
    if first is None:
        return np.zeros((0, 0))
    taken = unit(np.array([first.x]))
    for r in range(rounds):
        near = assign(rows, Clusters(taken), "id", "x")
        total = near.agg(F.sum("distance").alias("cost")).first().cost
        if not total or total < 1e-12:
            break
        chosen = near.filter(_uniform(F.col("id"), str(r)) < F.lit(2.0 * k) * F.col("distance") / F.lit(total)).select("id")
        got = rows.join(chosen, "id", "left_semi").groupBy("x").agg(F.min("id").alias("id")).collect()
        if got:
            taken = np.concatenate([taken, unit(np.array([g.x for g in sorted(got, key=lambda g: str(g.id))]))])
    weights = np.zeros(len(taken))
    for path, (n, _) in _sums(rows, Clusters(taken)).items():
        weights[int(path)] = n
    picked = [int(weights.argmax())]
    while len(picked) < min(k, len(taken)):
        gain = weights * _distances(taken, taken[picked]).min(axis=1)
        if gain.max() <= 1e-12:
            break
        picked.append(int(gain.argmax()))
    return taken[picked]


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int, least_move: float = 1e-6) -> np.ndarray:
    """Lloyd's rounds from ``centroids``: each moves to the mean of its vectors; one without vectors stays."""
    for _ in range(rounds):
        moved = centroids.copy()
        for path, (n, s) in _sums(rows, Clusters(centroids)).items():
            moved[int(path)] = s / n
        far = float(np.abs(moved - centroids).max()) if len(moved) else 0.0
        centroids = moved
        if far < least_move:
            break
    return centroids


def fit(vectors: DataFrame, id_: str, embedding: str, k: int, rounds: int = 20, levels: int = 0, least: int = 2, cohesive: float = 1.0, half_rounds: int = 10) -> Clusters:
    """Macro clusters by k-means, then micro clusters by bisecting: ``levels`` times each cluster that has at
    least ``least`` vectors and a mean cosine to its centre below ``cohesive`` is split in two.

    All clusters of a level are split together. A half starts at the vector nearest to the cluster's mean
    or the one farthest from it. At most ``k * 2 ** levels`` clusters come out, of fewer different vectors fewer.
    """
    rows = stored(_vectors(vectors, id_, embedding), "vectors")
    clusters = Clusters(lloyd(rows, seeds(rows, k), rounds))
    if not len(clusters.centroids):
        return clusters
    for _ in range(levels):
        sums = _sums(rows, clusters)
        depth = max(p.count(".") for p in sums)
        wide = {p: s / n for p, (n, s) in sums.items() if p.count(".") == depth and n >= least and np.sqrt((s * s).sum()) / n < cohesive - 1e-9}
        halves = _ends(rows, clusters, wide)
        if not halves:
            break
        for _ in range(half_rounds):
            sums = _sums(rows, Clusters(clusters.centroids, clusters.split | halves))
            moved = {p: np.stack([sums[f"{p}.{h}"][1] / sums[f"{p}.{h}"][0] if f"{p}.{h}" in sums else c[h] for h in (0, 1)]) for p, c in halves.items()}
            far = max(float(np.abs(moved[p] - halves[p]).max()) for p in halves)
            halves = moved
            if far < 1e-6:
                break
        clusters.split |= halves
    return clusters


def _ends(rows: DataFrame, clusters: Clusters, means: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each cluster its vectors nearest to and farthest from the mean; none where these are equal."""
    if not means:
        return {}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = unit(matrix(batch.column(1)))
                paths = clusters.paths(x)[0]
                own = [i for i, p in enumerate(paths) if p in means]
                d = [float(((x[i] - means[paths[i]]) ** 2).sum()) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in own], pa.string()), pa.array(d, pa.float64()), batch.column(0).take(pa.array(own, pa.int64())).cast(pa.string()), pa.array([x[i].tolist() for i in own], pa.list_(pa.float64()))], names=["path", "d", "id", "x"])

    far = rows.select("id", "x").mapInArrow(run, "path string, d double, id string, x array<double>")
    got = far.groupBy("path").agg(F.min(F.struct("d", "id", "x")).alias("near"), F.max(F.struct("d", "id", "x")).alias("far")).collect()
    return {r.path: np.array([r.near.x, r.far.x]) for r in got if r.far.d - r.near.d > 1e-12}


def cohesion(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, n, cohesion: the mean cosine of all pairs of different vectors of a cluster, from the sum of their directions.

    The squared length of the sum of n unit vectors is n plus the cosines of all ordered pairs, so no pair
    is formed. Null for a single vector; vectors of zeros and nulls count for nothing.
    """
    x = F.col(embedding).cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select(F.col(key).alias("key"), F.when(size > 0, F.transform(x, lambda v: v / size)).alias("u")).filter("u is not null")
    sums = rows.select("key", F.posexplode("u").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    got = sums.groupBy("key").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("square"))
    return got.select(F.col("key").alias(key), "n", F.when(F.col("n") > 1, (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))
