from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from clausewright.llm import ngram_join as J


def brute(rows):
    hashes = J._WordHashes()
    sets = [set(J.shingle_set(r.text or "", hashes).tolist()) for r in rows]
    links = [[bool(a) and i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, row in enumerate(links):
            for j, linked in enumerate(row):
                if linked:
                    root[i] = min(root[i], root[j])
    named = {}
    for r, k in zip(rows, root, strict=True):
        named.setdefault(k, []).append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in named.items()}
    return Counter((r.doc_id, least[k], sum(row)) for r, k, row in zip(rows, root, links, strict=True)), len(named)


def test_links_and_classes_match_brute_force(documents):
    got = J.similar_documents(documents).collect()
    want, classes = brute(documents.collect())
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(r.first for r in got) == classes
    assert max(r.n_links for r in got) >= 6


def test_nothing(no_documents):
    assert J.similar_documents(no_documents).collect() == []


@pytest.mark.parametrize(("bounds", "group"), [({"BLOCK_SETS": 10, "BUCKET": 5, "DEPTH": 3, "PIVOTS": 4}, 100_000), ({"BLOCK_SHINGLES": 300, "BUCKET": 5, "DEPTH": 1, "PIVOTS": 4}, 100_000), ({"PIVOTS": 4}, 20)])
def test_blocks_of_a_large_family_match_brute_force(spark, monkeypatch, bounds, group):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for k in range(60):
        w = list(base[: 60 + k // 2])
        for _ in range(k % 3):
            w[rng.integers(60)] = f"x{rng.integers(9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for name, value in {**bounds, "GROUP_SETS": group}.items():
        monkeypatch.setattr(J, name, value)
    got = J.similar_documents(docs).collect()
    want, _ = brute(docs.collect())
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def family(rng, n, places=J.PLACES):
    """Signatures of variants of one text, alike in half to all of their places."""
    core = rng.integers(0, 256, places, dtype=np.uint8)
    keep = rng.choice([0.6, 0.75, 0.85, 0.97], n)
    return np.where(rng.random((n, places)) < keep[:, None], core, rng.integers(0, 256, (n, places), dtype=np.uint8))


def twins(rng, signs, differ=13):
    """Signatures that differ from the given ones in as many places, those that they share with the first one."""
    out = signs.copy()
    for k in range(len(out)):
        shared = np.flatnonzero(out[k] == signs[0])
        at = rng.permutation(shared if len(shared) >= differ else J.PLACES)[:differ]
        out[k, at] = rng.integers(0, 256, differ, dtype=np.uint8)
    return out


def test_no_set_leaves_the_recursion_without_its_partners():
    """Of two sets in a large group that agree enough, one goes on alone only if both are linked to the pivots."""
    rng = np.random.default_rng(7)
    core = rng.integers(0, 256, J.PLACES, dtype=np.uint8)
    signs = []
    for k in range(200):
        x = np.where(rng.random(J.PLACES) < [0.55, 0.75, 0.97][k % 3], core, rng.integers(0, 256, J.PLACES, dtype=np.uint8))
        y = x.copy()  # differs from x in places that x shares with the core
        y[rng.permutation(np.flatnonzero(x == core))[:16]] = rng.integers(0, 256, 16, dtype=np.uint8)
        signs += [x, y]
    pivots = [{"row": k, "sign": signs[k].tobytes()} for k in range(0, 48, 2)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(400, np.int64)), pa.array(np.arange(400)), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array([pivots] * 400, pa.list_(pa.struct([("row", pa.int64()), ("sign", pa.binary())])))],
        names=["node", "row", "sign", "pivots"],
    )
    went = [r for b in J._settle_or_split(iter([batch])) for r in b.to_pylist()]
    on = {r["row"] for r in went if r["link"] is None}
    tied = {r["row"] for r in went if r["link"] is not None} | {r["link"] for r in went}
    agree = np.array([[(x == y).sum() for y in signs] for x in signs])
    pairs = [(a, b) for a, b in zip(*np.nonzero(agree >= J.LEAST_PLACES), strict=True) if a != b]
    assert all(a in on and b in on or a in tied and b in tied for a, b in pairs)
    assert 0 < len(on) < 400


def test_a_group_compared_whole_connects_exactly_what_agrees(monkeypatch):
    rng = np.random.default_rng(3)
    signs = np.concatenate([family(rng, 40), family(rng, 30), rng.integers(0, 256, (30, J.PLACES), dtype=np.uint8)])[rng.permutation(100)]
    label = list(range(100))
    for _ in range(20):
        for a in range(100):
            for b in range(100):
                if (signs[a] == signs[b]).sum() >= J.LEAST_PLACES:
                    label[a] = label[b] = min(label[a], label[b])
    group = J._Group(np.arange(100), signs)
    group.solve(1)
    assert [group.find(k) for k in range(100)] == label
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat([3, 9], [1, 100])), pa.array(np.concatenate([[500], np.arange(100)])), J._fixed(np.concatenate([signs[:1], signs]))], names=["node", "row", "sign"])
    got = [(r["a"], r["b"]) for b in J._recurse(250, 8)(batch.slice(k, 7) for k in range(0, 101, 7)) for r in b.to_pylist()]
    assert sorted(got) == [(k, low) for k, low in enumerate(label) if k != low]


def test_recall_of_the_recursion_at_the_threshold():
    """Pairs that agree in 51 of 64 places, four fifths, each beside families that all runs meet as large groups."""
    rng = np.random.default_rng(11)
    found = total = 0
    for _ in range(4):
        some = family(rng, 800)
        values = np.concatenate([some, twins(rng, some)]).astype(np.uint32)
        signs = values.astype(np.uint8)
        n, rows = len(signs), np.arange(len(signs))
        forest = J._Forest(rows.tolist())
        runs = -(-np.log(1 - J.TARGET_RECALL) // np.log(1 - J.RUN_RECALL))
        alone = np.zeros((int(runs), n), np.int64)
        for r in range(int(runs)):
            tree = J._Forest(rows.tolist())
            for node, row, sign in J._children(J._mix(np.full(n, r + 1, np.uint64)), rows, signs, values):
                for name in np.unique(node):
                    group = J._Group(row[node == name], sign[node == name])
                    group.solve(int(name))
                    for a, b in zip(*(x.tolist() for x in group.links()), strict=True):
                        tree.join(a, b)
                        forest.join(a, b)
            alone[r] = [tree.find(k) for k in range(n)]
        agree = (signs[: n // 2] == signs[n // 2 :]).sum(axis=1)
        pairs = [k for k in range(n // 2) if agree[k] <= 52]
        total += len(pairs)
        found += sum(forest.find(k) == forest.find(k + n // 2) for k in pairs)
        assert (alone[:, : n // 2] == alone[:, n // 2 :]).mean() >= J.RUN_RECALL
    assert total > 2000
    assert found >= 0.999 * total


def test_recall_in_families_above_a_thousand_sets(spark):
    """At the default parameters: every link of every pair, most of them near the threshold."""
    rng = np.random.default_rng(12)
    texts = []
    for f, n in ((0, 1100), (1, 40), (2, 300)):
        base = [f"f{f}w{i}" for i in range(200)]
        for _ in range(n):
            w = list(base)
            for at in rng.permutation(200)[: rng.integers(0, 9)]:
                w[at] = f"x{rng.integers(1 << 40)}"
            texts.append(" ".join(w))
    hashes = J._WordHashes()
    sets = [J.shingle_set(t, hashes) for t in texts]
    shared, sizes = J.shared_counts(sets, sets), np.array([len(x) for x in sets])
    linked = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    got = {r.doc_id: r.n_links for r in J.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = linked.sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() > 50_000
    assert [got[k] for k in range(len(texts))] == want.tolist()


def test_pairs_of_a_loose_cluster_match_brute_force(spark, monkeypatch):
    """Members have similarities of 0.56; a few have a partner at 0.81 that is at 0.41 to the others."""
    core, texts = [f"c{i}" for i in range(60)], []
    for k in range(400):
        own = [f"own{k}x{i}" for i in range(22)]
        texts.append(" ".join(core + own))
        if k % 10 == 0:
            texts.append(" ".join(core[15:] + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(J, "BUCKET", 30)
    hashes = J._WordHashes()
    sets = [J.shingle_set(t, hashes) for t in texts]
    shared, sizes = J.shared_counts(sets, sets), np.array([len(s) for s in sets])
    linked = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    assert (linked.sum(axis=1) - 1).sum() == 80
    got = J.similar_documents(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(k, int(row.argmax()), int(row.sum()) - 1) for k, row in enumerate(linked)]


def test_shared_counts():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 90, 12)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert J.shared_counts(left, right).tolist() == want
    alike = np.array(J.shared_counts(left))
    np.fill_diagonal(alike, 0)
    want = np.array([[len(np.intersect1d(a, b)) for b in left] for a in left])
    np.fill_diagonal(want, 0)
    assert alike.tolist() == want.tolist()


def test_connected():
    rng = np.random.default_rng(2)
    linked = rng.random((300, 300)) < 0.004
    linked |= linked.T
    label = list(range(300))
    for _ in range(300):
        for a, b in zip(*np.nonzero(linked), strict=True):
            label[a] = label[b] = min(label[a], label[b])
    assert J._connected(linked).tolist() == label
