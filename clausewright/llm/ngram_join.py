"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; texts with equal sets are one node of the join. Each
node has a signature of minimum hashes, a sample of shared tokens: two sets agree in a place with
the probability of their Jaccard similarity. A run starts with all nodes in one group and splits
groups by one place of the signature, sometimes by more, chosen by a hash of the path so far, so
that a pair at the threshold stays together once a level on average. The first level is a shuffle;
a group that fits a task is split further there, and small groups are compared by brute force on
signatures. Runs repeat until the target recall.

Dense groups don't go down all levels. Places that differ are a metric: a set within ``h`` places of
a pivot has all its possible partners within ``h`` places more than a pair may differ in. Such a set
leaves the recursion once everything that near is linked to the pivot, so no pair is lost by it.

What the buckets link forms candidate families. Within a family all pairs that sizes allow are
compared exactly on their shingles, in blocks of bounded size, and only counted: no pair leaves the
task that compares it, but a link from every connected row to the smallest does, from which the
classes follow.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, read, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
PLACES = 64
#: Pairs at the threshold found by all runs together; a run alone finds at least this share of them.
TARGET_RECALL = 0.999
RUN_RECALL = 0.4
#: Groups up to this size are compared by brute force; larger ones are split, and compared whole at this depth.
BUCKET = 250
DEPTH = 8
#: Sets of a large group that its other sets are compared with, about.
PIVOTS = 16
#: Signatures that agree in fewer places aren't similar: five standard deviations below the threshold.
LEAST_PLACES = 36
#: A set that agrees with a pivot in as many places leaves the recursion.
SETTLED_PLACES = 48
#: Groups of more sets are split by a shuffle, not within a task.
GROUP_SETS = 100_000
#: Bounds of a block of sets; a family is compared in pairs of blocks.
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1 << 19
#: Similar sets are of the same or of neighbouring size classes: their sizes differ by a factor of 1.25 at most.
SIZE_CLASS = 1.26
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_ODD = np.random.default_rng(1).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_set(text: str, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles; a shorter text is one shingle of all its words."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for j in range(size):
        h = _mix(h + w[j : len(w) - size + 1 + j])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of ``PLACES`` hashes over the set."""
    out = np.empty(PLACES, np.uint32)
    for k in range(0, PLACES, 16):  # a few places at a time: long texts stay within the cache
        out[k : k + 16] = ((shingles[None, :] * _ODD[k : k + 16, None]) >> np.uint64(32)).min(axis=1)
    return out


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in it:
        keys, signs, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, hashes)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            signs.append(signature(s).tobytes() if len(s) else None)
        key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(k), pa.int64()) for k in key.T), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], names=["row", "k1", "k2", "n_shingles", "sign"])


def _matrix(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, PLACES)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column, without a Python object for each."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _children(node: np.ndarray, row: np.ndarray, signs: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The next groups of each path: by one chosen place, and for a quarter of the paths by another."""
    for turn, takes in ((1, np.ones(len(node), bool)), (2, _mix(node ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(4) == 0)):
        place = _mix(node + np.uint64(turn)) % np.uint64(PLACES)
        value = values[np.arange(len(node)), place.astype(np.int64)].astype(np.uint64)
        child = _mix(node ^ _mix((place << np.uint64(32) | value) + np.uint64(turn)))
        yield child[takes], row[takes], signs[takes]


def _first_level(runs: int, with_sets: bool):
    """The paths of all runs after one level. What goes on of a signature is a byte a place."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                row, values = batch.column("row").to_numpy(), _matrix(batch.column("sign"), np.uint32)
                signs = values.astype(np.uint8)
                parts = [p for r in range(runs) for p in _children(_mix(np.full(len(row), r + 1, np.uint64)), row, signs, values)]
                node, of, sign = (np.concatenate(c) for c in zip(*parts, strict=True))
                node = pa.array(node.view(np.int64))
                yield pa.RecordBatch.from_arrays([node, pa.array(of), _fixed(sign)], names=["node", "row", "sign"]) if with_sets else pa.RecordBatch.from_arrays([node], names=["node"])

    return run


def _settle_or_split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a group too large for a task against its pivots: those near one leave the recursion, the rest go on.

    All members of the group are compared with the pivot, so whatever a member that leaves could be
    linked to in this group or below it is linked to the pivot here.

    Rows with a null ``link`` are paths of the next level; the others link a row, or a pivot, to the
    smallest pivot that members of the batch connect it with.
    """
    reach = LEAST_PLACES - (PLACES - SETTLED_PLACES)
    for batch in it:
        if not batch.num_rows:
            continue
        node, row, signs = batch.column("node").to_numpy().view(np.uint64), batch.column("row").to_numpy(), _matrix(batch.column("sign"))
        links: list[tuple[int, int]] = []
        stays = np.ones(len(row), bool)
        for name in np.unique(node):
            members = np.flatnonzero(node == name)
            pivots = batch.column("pivots")[int(members[0])].as_py() or []
            if not pivots:
                continue
            rows = [p["row"] for p in pivots]
            theirs = np.frombuffer(b"".join(p["sign"] for p in pivots), np.uint8).reshape(-1, PLACES)
            forest = _Forest(rows)
            agree = np.stack([(signs[members] == t).sum(axis=1) for t in theirs], axis=1)
            stays[members] = agree.max(axis=1) < SETTLED_PLACES
            for k, of_row in zip(members.tolist(), agree >= reach, strict=True):
                found = np.flatnonzero(of_row).tolist()
                for f in found[1:]:
                    forest.join(found[0], f)
                if found:
                    links.append((int(row[k]), rows[found[0]]))
            links += forest.links()
        child, of, sign = (np.concatenate(c) for c in zip(*_children(node[stays], row[stays], signs[stays], signs[stays]), strict=True))
        a, b = (np.array(c, np.int64) for c in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
        none = np.zeros(len(of), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([child.view(np.int64), np.zeros(len(a), np.int64)])),
                pa.array(np.concatenate([of, a])),
                _fixed(np.concatenate([sign, np.zeros((len(a), PLACES), np.uint8)])),
                pa.array(np.concatenate([none, b]), mask=np.concatenate([np.ones(len(of), bool), np.zeros(len(a), bool)])),
            ],
            names=["node", "row", "sign", "link"],
        )


class _Group:
    """A group of the recursion within a task: a forest over its members, of what it connects."""

    def __init__(self, rows: np.ndarray, signs: np.ndarray, bucket: int = BUCKET, depth: int = DEPTH):
        self.rows, self.signs, self.bucket, self.depth = rows, signs, bucket, depth
        self.parent = list(range(len(rows)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, members: list[int]) -> None:
        """Connects the members; the smallest row of a tree is its root."""
        roots = {self.find(m) for m in members}
        low = min(roots, key=self.rows.__getitem__)
        for r in roots:
            self.parent[r] = low

    def compare(self, members: np.ndarray) -> None:
        """Brute force: each member against all that nothing has reached yet, breadth first."""
        left = members
        while len(left):
            reached, front, left = [left[:1]], left[:1], left[1:]
            while len(front) and len(left):
                step = max(1, (1 << 22) // (len(left) * PLACES))
                own, front = front[:step], front[step:]
                near = ((self.signs[own][:, None, :] == self.signs[left][None, :, :]).sum(axis=2) >= LEAST_PLACES).any(axis=0)
                if near.any():
                    reached.append(left[near])
                    front, left = np.concatenate([front, left[near]]), left[~near]
            if len(reached) > 1:
                self.join(np.concatenate(reached).tolist())

    def solve(self, node: int) -> None:
        """Connects all members that some path of this group leaves together in a bucket."""
        _, first, of = np.unique(np.ascontiguousarray(self.signs).view(f"V{PLACES}").ravel(), return_index=True, return_inverse=True)
        if len(first) < len(of):  # equal signatures are one member
            order = np.argsort(of, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                if len(same) > 1:
                    self.join(same.tolist())
        todo = [(np.uint64(node & (1 << 64) - 1), np.sort(first), 1)]
        while todo:
            key, members, depth = todo.pop()
            if len(members) <= max(self.bucket, PIVOTS) or depth >= self.depth:
                self.compare(members)
                continue
            signs = self.signs[members]
            constant = (signs == signs[0]).all(axis=0)
            c = int(constant.sum())
            if c >= LEAST_PLACES:  # all pairs agree in as many places
                self.join(members.tolist())
                continue
            with np.errstate(over="ignore"):
                drawn = _mix(self.rows[members].view(np.uint64) ^ key)
                pivots = np.argpartition(drawn, PIVOTS)[:PIVOTS]
                agree = np.stack([(signs == signs[p]).sum(axis=1) for p in pivots.tolist()], axis=1)
                best = agree.argmax(axis=1)
                most = agree[np.arange(len(members)), best]
                settled = most >= SETTLED_PLACES
                for k in range(PIVOTS):
                    of_pivot = most[settled & (best == k)]
                    if len(of_pivot):
                        reach = LEAST_PLACES - (PLACES - int(of_pivot.min()))
                        self.join(members[agree[:, k] >= reach].tolist())
                members, signs = members[~settled], signs[~settled]
                # Of the places that still tell members apart, so many that a pair at the threshold stays together once on average.
                wanted = (PLACES - c) / (THRESHOLD * PLACES - c)
                turns = int(wanted) + (int(_mix(np.array([key ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))[0]) / 2**64 < wanted - int(wanted))
                free = np.flatnonzero(~constant)
                order = np.argsort(_mix(key + free.astype(np.uint64)))
                for place in free[order[:turns]].tolist():
                    value = signs[:, place]
                    by_value = np.argsort(value, kind="stable")
                    for part in np.split(by_value, np.flatnonzero(np.diff(value[by_value])) + 1):
                        if len(part) > 1:
                            child = _mix(np.array([key ^ np.uint64(place << 8 | int(value[part[0]]) + 1)], np.uint64))[0]
                            todo.append((child, members[part], depth + 1))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        root = np.array([self.find(k) for k in range(len(self.parent))], np.int64)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return self.rows[moved], self.rows[root[moved]]


def _recurse(bucket: int, depth: int):
    """Links to the smallest row for what each group connects; batches are sorted by group."""

    def solved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, row, signs = batch.column("node").to_numpy(), batch.column("row").to_numpy(), _matrix(batch.column("sign"))
        ends = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        sizes = np.diff(ends)
        two = ends[:-1][sizes == 2]
        two = two[(signs[two] == signs[two + 1]).sum(axis=1) >= LEAST_PLACES]
        a, b = [np.maximum(row[two], row[two + 1])], [np.minimum(row[two], row[two + 1])]
        for k in np.flatnonzero(sizes > 2).tolist():
            group = _Group(row[ends[k] : ends[k + 1]], signs[ends[k] : ends[k + 1]], bucket, depth)
            group.solve(int(node[ends[k]]))
            x, y = group.links()
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group of a batch may go on in the next one: it waits
        for batch in it:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            if held and (cut or held[0].column("node")[0].as_py() != node[0]):
                yield from solved(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = []
            elif cut:
                yield from solved(batch.slice(0, cut))
            held.append(batch.slice(cut))
        if held:
            yield from solved(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _groups(it: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows by their first columns, from batches that are sorted by these."""
    key, held = None, []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


class _Forest:
    """Union-find over rows; its links lead every row straight to the smallest one of its tree."""

    def __init__(self, rows: list[int]):
        self.rows, self.root = rows, list(range(len(rows)))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            if self.rows[y] < self.rows[x]:
                x, y = y, x
            self.root[y] = x

    def links(self) -> list[tuple[int, int]]:
        return [(self.rows[k], self.rows[self.find(k)]) for k in range(len(self.rows)) if self.root[k] != k]


def _edge_batch(names: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, or with every other left one."""
    sets = left if right is None else [*left, *right]
    values = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    common = seen[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    out, order = np.zeros((len(left), len(left if right is None else right)), np.float32), np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # Sets of shingles as columns of zeros and ones, so many at a time; counts below 2**24 are exact.
    width = max(64, (4 << 20) // max(1, len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense @ dense.T if right is None else dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _shingled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes the bytes of its set of shingles."""
    hashes = _WordHashes()
    for whole in it:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            sets = [shingle_set(t, hashes).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])


def _connected(linked: np.ndarray) -> np.ndarray:
    """The least index that each index is connected with, for a symmetric matrix of links."""
    label, n = np.arange(len(linked)), len(linked)
    while True:
        low = label.copy()
        for start in range(0, n, 256):
            part = linked[start : start + 256]
            low[start : start + 256] = np.minimum(label[start : start + 256], np.where(part, label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: links of each set, weighted by copies, and links to the smallest row.

    A row with ``b`` null holds a count, one with ``n`` null a link.
    """
    out: list[tuple] = []
    for (_, first, second), members in _groups(it, 3):
        # (block, row, copies, shingles)
        same = first == second
        members.sort(key=lambda m: (m[0] != first, m[1]))
        n_left = sum(m[0] == first for m in members)
        if not same and (n_left == 0 or n_left == len(members)):
            continue
        sets = [np.frombuffer(m[3], np.uint64) for m in members]
        sizes = np.array([len(x) for x in sets], np.int64)
        copies = np.array([m[2] for m in members], np.int64)
        if same:
            shared, a, b = shared_counts(sets), sizes, sizes
        else:
            shared, a, b = shared_counts(sets[:n_left], sets[n_left:]), sizes[:n_left], sizes[n_left:]
        linked = shared >= THRESHOLD * (a[:, None] + b[None, :] - shared) - 1e-9
        if same:
            np.fill_diagonal(linked, False)
            counts, square = linked @ copies, linked
        else:
            counts = np.concatenate([linked @ copies[n_left:], linked.T @ copies[:n_left]])
            square = np.zeros((len(members), len(members)), bool)
            square[:n_left, n_left:] = linked
            square[n_left:, :n_left] = linked.T
        out += [(members[k][1], None, int(counts[k])) for k in np.flatnonzero(counts).tolist()]
        order = sorted(range(len(members)), key=lambda k: members[k][1])
        label = _connected(square[np.ix_(order, order)] if not same else square)
        rows = [members[k][1] for k in order] if not same else [m[1] for m in members]
        out += [(rows[k], rows[int(low)], None) for k, low in enumerate(label.tolist()) if low != k]
        if len(out) >= 50_000:
            yield _edge_batch(("a", "b", "n"), out)
            out = []
    if out:
        yield _edge_batch(("a", "b", "n"), out)


def candidate_links(signs: DataFrame, scratch: Scratch, target_recall: float) -> DataFrame:
    """Links (a, b) that connect all sets that some run leaves together in a bucket."""
    runs = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - RUN_RECALL)))
    paths, nodes = (signs.mapInArrow(_first_level(runs, whole), ddl) for whole, ddl in ((True, "node long, row long, sign binary"), (False, "node long")))
    links = []
    for depth in range(1, DEPTH + 1):
        counted = nodes.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_SETS)
        large = scratch.table(counted, f"large-{depth}")
        alone = large.isEmpty()
        within = paths if alone else paths.join(large.select("node"), "node", "left_anti")
        near = within.repartition("node").sortWithinPartitions("node").mapInArrow(_recurse(BUCKET, DEPTH), "a long, b long")
        links.append(scratch.table(near, f"near-{depth}"))
        if alone:
            break
        signed = paths.join(large, "node")
        if depth == DEPTH:  # so many agreeing places: the exact comparison will tell
            low = scratch.table(signed.groupBy("node").agg(F.min("row").alias("low")), "low")
            links.append(signed.join(low, "node").select(F.col("row").alias("a"), F.col("low").alias("b")))
            break
        is_pivot = F.pmod(F.xxhash64("node", "row"), F.ceil(F.col("size") / PIVOTS)) == 0
        pivots = signed.filter(is_pivot).groupBy("node").agg(F.collect_list(F.struct("row", "sign")).alias("pivots"))
        pivots = scratch.table(pivots, f"pivots-{depth}")
        compared = signed.join(pivots, "node", "left").select("node", "row", "sign", "pivots")
        went = scratch.table(compared.mapInArrow(_settle_or_split, "node long, row long, sign binary, link long"), f"went-{depth}")
        links.append(went.filter("link is not null").select(F.col("row").alias("a"), F.col("link").alias("b")))
        paths = went.filter("link is null").select("node", "row", "sign")
        nodes = paths.select("node")
    return reduce(DataFrame.unionByName, links)


def _block_pairs(family: DataFrame, scratch: Scratch) -> DataFrame:
    """root, first, second, block and the columns of ``family`` (root, row, n_shingles, ...) for each pair of blocks to compare.

    A family within the bounds of a block is one. A larger one is parted by size class, classes into
    blocks; blocks of classes that aren't neighbours hold no similar sets and don't meet.
    """
    totals = family.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("shingles"))
    large = (F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)
    totals = scratch.table(totals.select("root", large.alias("large")), "totals")
    size_class = F.when(F.col("large"), F.floor(F.log("n_shingles") / math.log(SIZE_CLASS))).otherwise(0).cast("int")
    placed = family.join(totals, "root").withColumn("class", size_class).drop("large")
    count = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = placed.groupBy("root", "class").agg(count.alias("blocks"))
    # A family has as many classes as sizes have orders of magnitude: some dozens at most.
    blocks = scratch.table(blocks.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("blocks")), "blocks")
    placed = placed.join(blocks, "root")
    bucket = F.pmod(F.xxhash64("row"), F.col("blocks")[F.col("class")]).cast("int")
    name = lambda c, k: c.cast("long") * (1 << 32) + k
    placed = placed.withColumn("block", name(F.col("class"), bucket))

    def meets(step: int):
        other = F.col("class") + step
        return F.when(
            F.map_contains_key("blocks", other),
            F.transform(F.sequence(F.lit(0), F.col("blocks")[other] - 1), lambda j: F.struct(F.least("block", name(other, j)).alias("first"), F.greatest("block", name(other, j)).alias("second"))),
        ).otherwise(F.expr("array()").cast("array<struct<first:bigint,second:bigint>>"))

    placed = placed.withColumn("meets", F.concat(meets(0), meets(-1), meets(1)))
    return placed.drop("blocks", "class")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_recall: float = TARGET_RECALL, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, copies, first.

    With ``row_col``, a column of distinct longs, that column comes first in the result, and ``docs``
    is read as it is, several times: it should be a stored table.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity of at least 0.8
    with this row's, rows with the same set included; ``copies`` counts the rows with the same set,
    this one included; ``class_id`` is the smallest id that chains of links reach, and ``first`` tells
    the one row of each class that has it.

    Defined results: words are lower-case runs of letters and digits; a text of one to four words is
    one shingle; texts without words, null texts among them, are not similar to anything, each its
    own class; rows repeated with the same id are rows of their own; a null id is its class's id
    only if no row of the class has another; an empty table gives an empty result; other columns are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "ngram_join")
    base = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base if row_col else scratch.table(base, "base")
    signed = scratch.table(base.select("row", "text").mapInArrow(_sign, "row long, k1 long, k2 long, n_shingles long, sign binary"), "signed")
    worded = signed.filter("sign is not null")
    sets = scratch.table(worded.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles")), "sets")
    signs = scratch.table(worded.join(sets.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "sign"), "signs")

    family = components(candidate_links(signs, scratch, target_recall), scratch, "family")
    scratch.drop("signs")
    roots = family.select("root").distinct().select(F.col("root").alias("row"), "root")
    family = family.unionByName(roots).join(sets.select(F.col("rep").alias("row"), "copies", "n_shingles"), "row")
    placed = scratch.table(_block_pairs(scratch.table(family, "families"), scratch), "placed")
    members = base.select("row", "text").join(placed.hint("merge"), "row")  # the same plan at every size
    members = members.select("root", "block", "meets", "row", "copies", "text").mapInArrow(_shingled, "root long, block long, meets array<struct<first:bigint,second:bigint>>, row long, copies long, shingles binary")
    pairs = members.withColumn("pair", F.explode("meets")).select("root", "pair.first", "pair.second", "block", "row", "copies", "shingles")
    keys = ["root", "first", "second"]
    compared = scratch.table(pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, "a long, b long, n long"), "compared")

    links = compared.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    classes = components(compared.filter("b is not null").select("a", "b"), scratch, "class").withColumnRenamed("row", "rep")
    found = sets.join(links, "rep", "left").join(classes, "rep", "left")
    found = scratch.table(found.select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")), "found")
    ids = base.select("row", "id")
    bare = signed.filter("sign is null").select("row", F.col("row").alias("root"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))  # no set to join by
    rows = worded.select("row", "k1", "k2").join(found, ["k1", "k2"]).select("row", "root", "copies", "links").unionByName(bare).join(ids, "row")
    rows = scratch.table(rows, "rows")
    named = scratch.table(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")), "named")
    scratch.keep("rows", "named")
    return rows.join(named, "root").select(
        *([F.col("row").alias(row_col)] if row_col else []),
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("copies"), (F.col("row") == F.col("best.row")).alias("first")
    )


def op5_ngram_jaccard_join(spark, sf_dir):
    return similar_documents(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE k >= {THRESHOLD} * (na.n + nb.n - k) - 1e-9),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, min(reach) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id) AS n_links FROM r GROUP BY doc_id
"""
