"""Clusters, cohesion and the index for rebinding, against plain numpy."""

import numpy as np
import pytest
from clausewright.operators import clustering as C
from clausewright.operators import mining, rebinding
from pyspark.sql import functions as F


def clouds(n, dims=8, k=5, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((k, dims))
    return centres[rng.integers(0, k, n)] + spread * rng.standard_normal((n, dims))


def frame(spark, x, more=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(3)


def brute_lloyd(x, c, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


def test_lloyd_matches_brute_force_from_the_same_seeds(spark):
    x = clouds(300)
    rows = frame(spark, x).cache()
    seeds = C.seeds(rows, 5)
    assert np.array_equal(seeds, C.seeds(rows.repartition(7), 5)) and len(seeds) == 5  # the partitioning doesn't matter
    got = C.lloyd(rows, seeds, 8, least_move=0)
    assert np.allclose(got, brute_lloyd(C.unit(x), seeds, 8), atol=1e-9)
    cost = lambda c: ((C.unit(x)[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    rng = np.random.default_rng(0)
    assert cost(got) <= 1.1 * min(cost(brute_lloyd(C.unit(x), C.unit(x[rng.choice(300, 5, replace=False)]), 30)) for _ in range(10))


def test_micro_clusters_split_wide_ones(spark):
    x = np.concatenate([clouds(120, k=2, seed=3), clouds(120, k=3, seed=4)])
    rows = frame(spark, x, [(900, None), (901, [])])
    macro = C.fit(rows, "id", "x", 2, levels=0)
    micro = C.fit(rows, "id", "x", 2, levels=2, least=10, half_rounds=60)  # until nothing moves
    assert np.allclose(macro.centroids, micro.centroids) and micro.split
    got = C.assign(rows, micro, "id", "x").collect()
    assert len(got) == 240 and {r.path.split(".")[0] for r in got} == {"0", "1"}
    u = C.unit(x)
    for path, halves in micro.split.items():  # each half is the mean of its vectors, and each vector is in the nearer half
        own = np.array([r.id for r in got if r.path == path or r.path.startswith(path + ".")])
        d = ((u[own][:, None] - halves[None]) ** 2).sum(axis=2)
        side = np.array([int(next(r.path for r in got if r.id == i)[len(path) + 1]) for i in own])
        assert (d.argmin(axis=1) == side).all() and all(np.allclose(u[own[side == h]].mean(axis=0), halves[h], atol=1e-4) for h in (0, 1))
    assert sum(r.distance for r in got) < 0.8 * sum(r.distance for r in C.assign(rows, macro, "id", "x").collect())


def test_few_equal_and_no_vectors(spark):
    same = frame(spark, np.ones((30, 4)))
    fitted = C.fit(same, "id", "x", 3, levels=3)
    assert len(fitted.centroids) == 1 and not fitted.split
    none = same.limit(0)
    assert C.fit(none, "id", "x", 3, levels=1).centroids.size == 0 and C.cohesion(none, "id", "x").collect() == []


def test_cohesion_is_the_mean_of_all_pairs(spark):
    x = clouds(60, k=3, seed=5)
    rows = [(i % 3, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [1.0] * 8), (0, None), (0, [0.0] * 8)]
    got = {r.g: (r.n, r.cohesion) for r in C.cohesion(spark.createDataFrame(rows, "g long, x array<double>"), "g", "x").collect()}
    assert got.pop(7) == (1, None)
    for g, (n, value) in got.items():
        u = C.unit(x[np.arange(60) % 3 == g])
        pairs = u @ u.T
        assert n == 20 and value == pytest.approx((pairs.sum() - np.trace(pairs)) / (n * (n - 1)))


@pytest.fixture(scope="module")
def bound(spark):
    """Bindings near clusters, some far from all, copies, ties between equal clusters, nulls and zeros."""
    known, rng = clouds(1500, dims=16, k=40, seed=6, spread=0.35), np.random.default_rng(8)
    asked = np.concatenate([known[rng.integers(0, 1500, 150)] + 0.05 * rng.standard_normal((150, 16)), rng.standard_normal((20, 16))])
    clusters = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([known, known[:50]]))] + [(None, [1.0] * 16), (9000, None), (9001, [0.0] * 16)]
    bindings = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([asked, asked[:10]]))] + [(800, None), (801, [0.0] * 16)]
    return spark.createDataFrame(bindings, "binding_id long, label_embedding array<double>").cache(), spark.createDataFrame(clusters, "cluster_id long, embedding array<double>").cache()


def test_exact_rebinding_equals_comparing_all(bound):
    bindings, clusters = bound
    told = "size(filter({}, v -> v <> 0)) > 0"
    want = mining.soft_rebind(bindings.filter(told.format("label_embedding")), clusters.filter(told.format("embedding")).filter("cluster_id is not null"), 0.85).collect()
    got = {r.binding_id: r for r in rebinding.rebind(bindings, clusters, 0.85, pivots=20).collect()}
    assert {r.binding_id: (r.cluster_id, r.rebound) for r in want} == {k: (r.cluster_id, r.rebound) for k, r in got.items()}
    assert all(got[r.binding_id].confidence == pytest.approx(r.confidence, abs=1e-6) for r in want) and {r.rebound for r in want} == {True, False}


def test_recall_of_the_index_alone(bound):
    bindings, clusters = bound
    want = {r.binding_id: r.cluster_id for r in rebinding.rebind(bindings, clusters, 0.85).collect() if r.rebound}
    got = {r.binding_id: r.cluster_id for r in rebinding.rebind(bindings, clusters, 0.85, exact=False, cell=64).collect()}
    assert sum(got.get(k) == c for k, c in want.items()) >= 0.9 * len(want) and len(want) > 100


def test_large_cells_meet_in_blocks(bound, monkeypatch):
    bindings, clusters = bound
    want = {tuple(r) for r in rebinding.rebind(bindings, clusters, 0.85).select("binding_id", "cluster_id").collect()}
    monkeypatch.setattr(rebinding, "BLOCK", 40)
    assert {tuple(r) for r in rebinding.rebind(bindings, clusters, 0.85, pivots=3).select("binding_id", "cluster_id").collect()} == want


def test_the_index_compares_few(bound):
    bindings, clusters = bound
    asked, known = (rebinding._distinct_directions(df, *names)[0] for df, names in ((bindings, ("binding_id", "label_embedding")), (clusters, ("cluster_id", "embedding"))))
    met = rebinding._coded(asked, 7, rebinding.TABLES, rebinding.PROBES).select("group", F.col("id").alias("a")).join(rebinding._coded(known, 7, rebinding.TABLES, 1).select("group", "id"), "group").select("a", "id").distinct().count()
    assert met < 0.5 * asked.count() * known.count()


def test_rebinding_with_nothing(bound):
    bindings, clusters = bound
    assert rebinding.rebind(bindings, clusters.limit(0), 0.5).collect() == [] and rebinding.rebind(bindings.limit(0), clusters, 0.5).collect() == []
