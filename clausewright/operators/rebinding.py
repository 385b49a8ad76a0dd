"""The nearest cluster of each binding through an index, without comparing all with all.

Hyperplanes through the origin cut the directions into cells; vectors of small angle mostly share a
cell. Several tables of such cells, and for a binding also the cells behind the planes it is nearest to,
bring up candidates whose cosine is then computed. What they find is a lower bound. The exact way beyond
the index goes through pivots: a cluster lies within the largest angle of its pivot's clusters, so only
pivots that could hold something nearer than the bound are looked at, and of most bindings few are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import sent, stored
from . import clustering
from .clustering import Clusters, matrix, unit

TABLES = 8
#: Clusters that a cell should hold on average: decides the number of planes.
CELL = 256
#: Cells looked at in each table: the binding's own and those behind its nearest planes, one or two at a time.
PROBES = 4
PIVOTS = 64
#: Rows of either side that meet as one matrix.
BLOCK = 4096


def _planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((tables, bits, dims))


def cells(x: np.ndarray, planes: np.ndarray, probes: int) -> list[np.ndarray]:
    """For each table the codes (rows by probes) of each vector: its own cell first, then the likeliest others."""
    out = []
    for of_table in planes:
        side = x @ of_table.T
        bits = len(of_table)
        weight = 1 << np.arange(bits, dtype=np.int64)
        own = ((side > 0) * weight).sum(axis=1)
        codes = [own]
        if probes > 1:
            nearest = np.argsort(np.abs(side), axis=1)
            rows = np.arange(len(x))
            flips = [(a,) for a in range(min(bits, probes - 1))] + list(combinations(range(min(bits, 4)), 2))
            cost = np.stack([sum(np.abs(side[rows, nearest[:, a]]) for a in f) for f in flips], axis=1)
            order = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
            flipped = np.stack([sum(weight[nearest[:, a]] for a in f) for f in flips], axis=1)
            codes += [own ^ flipped[rows, order[:, p]] for p in range(order.shape[1])]
        out.append(np.stack(codes, axis=1))
    return out


def _coded(rows: DataFrame, bits: int, tables: int, probes: int) -> DataFrame:
    """group, id, x: each vector in its cells; a group is a cell's code and its table's number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1)))
            ids, codes = [], []
            for t, c in enumerate(cells(x, _planes(x.shape[1], bits, tables), probes)):
                ids.append(np.repeat(np.arange(len(x)), c.shape[1]))
                codes.append(c.ravel() | (t << 48))
            at = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes), pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["group", "id", "x"])

    return rows.select("id", "x").mapInArrow(run, f"group long, id {rows.schema['id'].dataType.simpleString()}, x {rows.schema['x'].dataType.simpleString()}")


def _distinct_directions(df: DataFrame, id_: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(id, x) with one row per direction under its smallest id, and (of, id): which ids stand for which."""
    x = F.col(embedding).cast("array<double>")
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = stored(df.select(F.col(id_).alias("of"), F.col(embedding).alias("x"), F.when(size > 0, F.transform(x, lambda v: v / size)).alias("u")).filter("u is not null and of is not null"), "directions")
    one = stored(rows.groupBy("u").agg(F.min("of").alias("id"), F.min_by("x", "of").alias("x")), "direction")
    return one.select("id", "x"), rows.select("of", "u").join(one.select("u", "id"), "u").select("of", "id")


def _best_in_groups(asked: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, cosine: for each asked id the nearest known one of its groups. Both: group, id, x.

    Groups meet as matrices. One of over ``BLOCK`` rows on either side is dealt into blocks, each block of
    one side meeting each of the other, so no task holds more.
    """
    sizes = asked.groupBy("group").agg(F.count("*").alias("n_a")).join(known.groupBy("group").agg(F.count("*").alias("n_b")), "group")
    large = stored(sizes.filter((F.col("n_a") > BLOCK) | (F.col("n_b") > BLOCK)).select("group", F.ceil(F.col("n_a") / BLOCK).cast("long").alias("as"), F.ceil(F.col("n_b") / BLOCK).cast("long").alias("bs")), "large")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("long")
        rows = rows.join(sent(large), "group", "left").select("group", "id", "x", F.pmod(F.xxhash64("id"), F.coalesce(own, one)).alias(own[0]), F.coalesce(other, one).alias("n"))
        return rows.select("group", "id", "x", own[0], F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(other[0]))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"a": a["id"].slice(0, 0), "b": b["id"].slice(0, 0), "cosine": pa.array([], pa.float64())})
        b = b.sort_by("id")
        cosine = unit(matrix(a["x"].combine_chunks())) @ unit(matrix(b["x"].combine_chunks())).T
        at = cosine.argmax(axis=1)
        return pa.table({"a": a["id"], "b": b["id"].take(pa.array(at)), "cosine": cosine[np.arange(len(at)), at]})

    keys = ("group", "a", "b")
    kinds = [d.schema["id"].dataType.simpleString() for d in (asked, known)]
    met = dealt(asked, "as", "bs").groupBy(*keys).cogroup(dealt(known, "bs", "as").groupBy(*keys)).applyInArrow(nearest, f"a {kinds[0]}, b {kinds[1]}, cosine double")
    return _best(met)


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("a").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "b")).alias("best")).select("a", "best.b", (-F.col("best.far")).alias("cosine"))


def rebind(bindings: DataFrame, clusters: DataFrame, least: float, exact: bool = True, tables: int = TABLES, probes: int = PROBES, cell: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """binding_id, cluster_id, confidence, rebound: the cluster of largest cosine, rebound from ``least`` on.

    ``bindings``: binding_id, label_embedding; ``clusters``: cluster_id, embedding. With ``exact`` the
    result is the same as comparing all with all; without, it is what the index finds, and bindings
    without a candidate have no row.

    Equal directions are compared once, whatever their number; of equal cosines the smallest cluster
    wins. Null vectors, vectors of zeros and null ids take no part. Without clusters there are no rows.
    """
    asked, standing = _distinct_directions(bindings, "binding_id", "label_embedding")
    known, _ = _distinct_directions(clusters, "cluster_id", "embedding")
    n = known.count()
    bits = int(np.clip(np.ceil(np.log2(max(2, n) / cell)), 1, 40))
    found = stored(_best_in_groups(_coded(asked, bits, tables, probes), _coded(known, bits, tables, 1)), "found")
    if exact and n:
        found = _beyond(found, asked, known, pivots)
    out = standing.join(found, F.col("id") == F.col("a"))
    return out.select(F.col("of").alias("binding_id"), F.col("b").alias("cluster_id"), F.col("cosine").alias("confidence"), (F.col("cosine") >= least).alias("rebound"))


def _beyond(found: DataFrame, asked: DataFrame, known: DataFrame, pivots: int) -> DataFrame:
    """The best of what was found and what pivots could still hold; those that can't hold anything nearer are left out."""
    centres = Clusters(unit(clustering.fit(known, "id", "x", pivots, rounds=3).centroids))
    near = stored(clustering.assign(known, centres, "id", "x").select("id", F.col("path").alias("group"), (2 * F.asin(F.least(F.lit(1.0), F.sqrt("distance") / 2))).alias("angle")), "pivots")
    reach = {r.group: r.widest for r in near.groupBy("group").agg(F.max("angle").alias("widest")).collect()}  # one row a pivot
    groups = sorted(reach, key=int)
    middle, widest = centres.centroids[[int(p) for p in groups]], np.array([reach[p] for p in groups])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            bound = np.arccos(np.clip(batch.column(2).to_numpy(zero_copy_only=False), -1, 1))
            angle = np.arccos(np.clip(unit(matrix(batch.column(1))) @ middle.T, -1, 1))
            rows, cols = np.nonzero(angle - widest <= bound[:, None] + 1e-7)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array([groups[c] for c in cols], pa.string()), batch.column(0).take(at), batch.column(1).take(at)], names=["group", "id", "x"])

    bounded = asked.join(found.select("a", "cosine"), F.col("id") == F.col("a"), "left").select("id", "x", F.coalesce("cosine", F.lit(-1.0)).alias("cosine"))
    looked = bounded.mapInArrow(run, f"group string, id {asked.schema['id'].dataType.simpleString()}, x {asked.schema['x'].dataType.simpleString()}")
    return stored(_best(_best_in_groups(looked, known.join(near.select("id", "group"), "id").select("group", "id", "x")).unionByName(found)), "nearest")
