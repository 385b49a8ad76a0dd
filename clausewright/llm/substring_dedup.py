"""Substring dedup by compacting a De Bruijn graph of words.

The graph's edges are the windows of ``LENGTH`` words, its nodes the ``LENGTH - 1`` words that two
consecutive windows share. An edge is repeated if its words start at two places.

1. Edges that follow one another in a text and have the same minimiser (the window's smallest hash
   of ``MINIMIZER`` words) form a chain; equal edges always have equal minimisers at the same offset,
   so equal paths are cut into equal chains wherever they occur. Equal chains merge into one with a
   count. Chains that share only their minimiser with others may share a part: they are taken apart
   into edges, each told by a digest of its words, and equal edges merge.
2. Merged chains and edges that are repeated are the pieces of the graph that is compacted, with the
   digests of the nodes at their ends. A node that one piece enters and one leaves doesn't branch:
   the path goes on through it.
3. Pieces go back to the source coordinates of all their occurrences. There consecutive pieces join
   up wherever the path goes on between them: long spans, each one path without branches. Spans
   between the same pieces are compared by the words at their coordinates; differing ones are an error.

Chains, edges and nodes are told apart by cryptographic digests of the words at their coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, text_or_empty

LENGTH = 35
MINIMIZER = 12
CACHE_WORDS = 400_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def _layout(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins; the last entry is one past the end."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return b" ".join(words), starts


def _digests(data: bytes, starts: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of the words ``first`` to before ``stop``, as rows of two longs."""
    view, blake = memoryview(data), hashlib.blake2b
    spans = zip(starts[first].tolist(), (starts[stop] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([blake(view[a:b], digest_size=16).digest() for a, b in spans]), "<i8").reshape(-1, 2)


def chains(words: list[bytes], hashes: _WordHashes, length: int = LENGTH, m: int = MINIMIZER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each chain of a text."""
    n = len(words)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    h = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        h = h * _MULTIPLIER + w[j : n - m + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    span = length - m + 1
    at = np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(n - length + 1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(at)]]))
    return h[at[first]].view(np.int64), first, count


def _chain_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in it:
        parts: list[tuple] = []
        held = 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.encode().split()
            mini, first, count = chains(words, hashes)
            if len(mini):
                data, starts = _layout(words)
                digest = _digests(data, starts, first, first + count - 1 + LENGTH)
                parts.append((mini, np.full(len(mini), row), first << 8 | count, digest[:, 0], digest[:, 1]))
                held += len(mini)
            if held >= 100_000:
                yield _columns(("mini", "row", "at", "c1", "c2"), parts)
                parts, held = [], 0
        if parts:
            yield _columns(("mini", "row", "at", "c1", "c2"), parts)


def _columns(names: tuple[str, ...], parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(np.concatenate(c)), pa.int64()) for c in zip(*parts, strict=True)], names=list(names))


def _nodes(data: bytes, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit digests of the ``LENGTH - 1`` words from each of the given ones on."""
    view, blake = memoryview(data), hashlib.blake2b
    spans = zip(starts[first].tolist(), (starts[first + LENGTH - 1] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([blake(view[a:b], digest_size=8).digest() for a, b in spans]), "<i8")


def _edge_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed chains of a text, whole or taken apart into edges: digest, nodes at the ends, the chain's count, and the place in it."""
    names = ("w1", "w2", "enters", "leaves", "n", "chain", "offset", "edges")
    for batch in it:
        parts: list[tuple] = []
        held = 0
        for text, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            data, starts = _layout(words)
            first, edges, chain, count, offset = [], [], [], [], []
            for x in listed:
                begin, size = x["at"] >> 8, x["at"] & 255
                pieces = size if x["branches"] else 1
                first += range(begin, begin + pieces)
                edges += [size // pieces] * pieces
                chain += [x["chain"]] * pieces
                count += [x["n"]] * pieces
                offset += range(pieces)
            f, e = np.array(first, np.int64), np.array(edges, np.int64)
            digest = _digests(data, starts, f, f + e - 1 + LENGTH)
            ends = np.unique(np.concatenate([f, f + e]))  # consecutive edges share a node
            node = _nodes(data, starts, ends)
            parts.append((digest[:, 0], digest[:, 1], node[np.searchsorted(ends, f)], node[np.searchsorted(ends, f + e)], np.array(count, np.int64), np.array(chain, np.int64), np.array(offset, np.int64), e))
            held += len(f)
            if held >= 100_000:
                yield _columns(names, parts)
                parts, held = [], 0
        if parts:
            yield _columns(names, parts)


def long_spans(start: np.ndarray, edges: np.ndarray, goes_on: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, windows, first piece and last piece of each run of pieces that one path goes on through.

    The arguments are the runs of pieces in a text's chains: where they start, how many edges they
    have, whether the path goes on behind them, and their outer pieces.
    """
    order = np.argsort(start, kind="stable")
    start, edges, goes_on, first, last = (x[order] for x in (start, edges, goes_on, first, last))
    follows = goes_on[:-1] & (start[1:] == start[:-1] + edges[:-1])
    begin = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    end = np.concatenate([begin[1:], [len(start)]]) - 1
    return start[begin], start[end] + edges[end] - start[begin], first[begin], last[end]


def covered(n_words: int, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which words the spans of windows cover."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + windows - 1 + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


_PROOF = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("windows", pa.int64()), ("words", pa.binary())]))
_SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())])


def _clean_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        runs = batch.column(2)
        sizes = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = runs.flatten()
        columns = [values.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
        out, at = [], 0
        spans: list[np.ndarray] = []
        proof: list[tuple] = []
        words_of: list[bytes] = []
        n_spans, n_proof = np.zeros(batch.num_rows + 1, np.int32), np.zeros(batch.num_rows + 1, np.int32)
        for k, (text, size) in enumerate(zip(batch.column(1).to_pylist(), sizes.tolist(), strict=True)):
            words = text.encode().split()
            if not size:
                out.append((len(words), 0, b" ".join(words)))
                continue
            found = long_spans(*(c[at : at + size] for c in columns))
            at += size
            data, starts = _layout(words)
            words_of += [hashlib.sha256(data[a:b]).digest() for a, b in zip(starts[found[0]].tolist(), (starts[found[0] + found[1] - 1 + LENGTH] - 1).tolist(), strict=True)]
            proof.append((found[2], found[3], found[1]))
            n_proof[k + 1] = len(found[0])
            gone = covered(len(words), found[0], found[1])
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            spans.append(edges)
            n_spans[k + 1] = len(edges)
            out.append((len(words), int(gone.sum()), kept))
        n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        joined = np.concatenate([*spans, np.empty((0, 2))]).astype(np.int32)
        first, last, windows = (np.concatenate([*(p[j] for p in proof), np.empty(0)]).astype(np.int64) for j in range(3))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array([k.decode() for k in kept], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(n_spans), pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(joined[:, j])) for j in range(2)], fields=list(_SPAN))),
                pa.ListArray.from_arrays(pa.array(np.cumsum(n_proof), pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(last), pa.array(windows), pa.array(words_of, pa.binary())], fields=list(_PROOF.value_type))),
            ],
            names=["id", "n_words", "n_removed", "kept_sha256", "kept", "spans", "proof"],
        )


def going_on(pieces: DataFrame) -> DataFrame:
    """The nodes that one piece enters and one leaves: node. ``pieces``: enters and leaves (nodes), a row a piece."""
    ends = pieces.select(F.col("enters").alias("node"), F.lit(0).alias("entering"), F.lit(1).alias("leaving"))
    ends = ends.unionByName(pieces.select(F.col("leaves").alias("node"), F.lit(1).alias("entering"), F.lit(0).alias("leaving")))
    return ends.groupBy("node").agg(F.sum("entering").alias("entering"), F.sum("leaving").alias("leaving")).filter("entering = 1 and leaving = 1").select("node")


def check_spans(cleaned: DataFrame) -> None:
    """Spans between the same pieces have the same words wherever they are."""
    proof = cleaned.select(F.inline("proof")).groupBy("first", "last", "windows").agg(F.min("words").alias("low"), F.max("words").alias("high"))
    if not proof.filter("low <> high").isEmpty():
        raise ValueError("equal digests of different words: spans between the same pieces differ")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept, spans of every row of ``docs``.

    Every word covered by a window of ``LENGTH`` words that also starts anywhere else, in the same
    text or another, is removed; ``spans`` are the maximal removed runs of words, ``kept`` the other
    words joined by one space. Words are runs of anything but ASCII white space.

    Defined results: a null or empty text has no words, and its digest is that of no bytes; a text
    shorter than a window loses nothing; rows repeated with the same id are separate places; null
    ids stay null; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    id_type = docs.schema[id_col].dataType.simpleString()
    base = scratch.table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), "base")
    texts = base.select("row", "text")
    found = scratch.table(texts.mapInArrow(_chain_batches, "mini long, row long, at long, c1 long, c2 long"), "chains")

    # Equal chains merge; any occurrence serves as the source of their words.
    merged = found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.first("mini").alias("mini"), F.first("row").alias("row"), F.first("at").alias("at"))
    merged = scratch.table(merged, "merged")

    # Minimisers with several different chains: there the graph may branch. Other chains matter if they are repeated.
    branching = scratch.table(merged.groupBy("mini").agg(F.count("*").alias("k")).filter("k > 1").select("mini", F.lit(True).alias("branches")), "branching")
    picked = merged.join(branching.hint("merge"), "mini", "left").withColumn("branches", F.coalesce("branches", F.lit(False))).filter("branches or n > 1")
    picked = scratch.table(picked.select(F.monotonically_increasing_id().alias("chain"), "c1", "c2", "n", "row", "at", "branches"), "picked")
    scratch.drop("merged", "branching")
    listed = scratch.table(picked.groupBy("row").agg(F.collect_list(F.struct("at", "n", "chain", "branches")).alias("listed")), "listed")
    edges = texts.join(listed.hint("merge"), "row").select("text", "listed")
    edges = scratch.table(edges.mapInArrow(_edge_batches, "w1 long, w2 long, enters long, leaves long, n long, chain long, offset long, edges long"), "edges")
    scratch.drop("listed")

    # The graph of what is repeated: its pieces, and whether a path goes on behind them.
    pieces = edges.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.first("enters").alias("enters"), F.first("leaves").alias("leaves")).filter("n > 1")
    pieces = scratch.table(pieces.select(F.monotonically_increasing_id().alias("piece"), "w1", "w2", "enters", "leaves"), "pieces")
    through = going_on(pieces).select(F.col("node").alias("leaves"), F.lit(True).alias("through"))
    of_edge = pieces.select("piece", "w1", "w2", "leaves").join(through.hint("merge"), "leaves", "left").select("w1", "w2", "piece", F.coalesce("through", F.lit(False)).alias("goes_on"))
    of_edge = scratch.table(of_edge, "of_edge")
    scratch.drop("pieces")

    # What one path goes on through in a chain becomes one run: a chain has at most as many edges as windows have minimisers.
    placed = edges.select("w1", "w2", "chain", "offset", "edges").join(of_edge.hint("merge"), ["w1", "w2"])
    each = F.array_sort(F.collect_list(F.struct("offset", "edges", "goes_on", F.col("piece").alias("first"), F.col("piece").alias("last"))))

    def joined(acc, e):
        now = F.get(acc, F.size(acc) - 1)
        grown = F.struct(now["offset"].alias("offset"), (now["edges"] + e["edges"]).alias("edges"), e["goes_on"].alias("goes_on"), now["first"].alias("first"), e["last"].alias("last"))
        follows = F.coalesce(now["goes_on"] & (now["offset"] + now["edges"] == e["offset"]), F.lit(False))
        return F.when(follows, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(e)))

    kind = "array<struct<offset:bigint,edges:bigint,goes_on:boolean,first:bigint,last:bigint>>"
    runs = placed.groupBy("chain").agg(each.alias("pieces")).select("chain", F.when(F.size("pieces") == 1, F.col("pieces")).otherwise(F.aggregate("pieces", F.expr("array()").cast(kind), joined)).alias("runs"))
    runs = scratch.table(picked.select("chain", "c1", "c2").join(runs.hint("merge"), "chain").select("c1", "c2", "runs"), "runs")
    scratch.drop("edges", "of_edge", "picked")

    # Back to all source coordinates.
    spans = found.select("row", "at", "c1", "c2").join(runs.hint("merge"), ["c1", "c2"]).select("row", "at", F.inline("runs"))
    spans = spans.select("row", F.struct((F.shiftright("at", 8) + F.col("offset")).alias("start"), "edges", "goes_on", "first", "last").alias("run"))
    spans = scratch.table(spans.groupBy("row").agg(F.collect_list("run").alias("runs")), "spans")
    scratch.drop("chains", "runs")
    cleaned = base.join(spans.hint("merge"), "row", "left").select("id", "text", "runs")
    ddl = f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first_word:int,end_word:int>>, proof array<struct<first:bigint,last:bigint,windows:bigint,words:binary>>"
    cleaned = scratch.table(cleaned.mapInArrow(_clean_batches, ddl), "cleaned")
    scratch.keep("cleaned")
    check_spans(cleaned)
    return cleaned.drop("proof").withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 35)) AS i FROM win JOIN again USING (h)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
kept AS (
  SELECT word.r, string_agg(t, ' ' ORDER BY word.i) AS kept
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.r = lost.r LEFT JOIN kept ON d.r = kept.r
"""
