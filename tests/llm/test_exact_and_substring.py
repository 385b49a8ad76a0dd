import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from clausewright.llm import exact_dedup as exact_dedup_module
from clausewright.llm import substring_dedup as S
from clausewright.llm.exact_dedup import exact_dedup
from clausewright.llm.substring_dedup import LENGTH, remove_repeats


def brute_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    out = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            out[r.doc_id, best.doc_id, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out, len(groups)


def test_exact_dedup_matches_brute_force(documents):
    got = exact_dedup(documents).collect()
    want, groups = brute_exact(documents.collect())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups  # one row of each group, repeated rows or not
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


@pytest.mark.parametrize(("key_bytes", "limit"), [(0, 64 << 20), (1, 64 << 20), (32, 1000), (1, 0)])
def test_content_decides_and_held_texts_are_bounded(documents, monkeypatch, key_bytes, limit):
    """Digests cut so short that different texts share them; tables of held texts that fill up at once."""
    monkeypatch.setattr(exact_dedup_module, "LOCAL_BYTES", limit)
    got = exact_dedup(documents, key_bytes=key_bytes, salts=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(documents.collect())[0]


def test_exact_dedup_of_nothing(no_documents):
    assert exact_dedup(no_documents).collect() == []


def brute_substring(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + LENGTH]) for w in words for i in range(len(w) - LENGTH + 1))
    out = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - LENGTH + 1) if seen[tuple(w[i : i + LENGTH])] > 1 for k in range(LENGTH)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup_matches_brute_force(documents):
    got = remove_repeats(documents).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(documents.collect())
    assert any(0 < r.n_removed < r.n_words for r in got)
    assert all(sum(s.end_word - s.first_word for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_of_nothing(no_documents):
    assert remove_repeats(no_documents).collect() == []


def test_substring_dedup_at_window_borders(spark):
    w = [f"w{i}" for i in range(120)]
    texts = [w[:34], w[:34], w[40:75], ["x", *w[40:75], "y"], w[80:114], ["x", *w[80:114], "y"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {0: 0, 1: 0, 2: 35, 3: 35, 4: 0, 5: 0}


def test_paths_go_on_through_nodes_that_do_not_branch(spark):
    rng = random.Random(3)
    for _ in range(4):
        graph = [(rng.randrange(14), rng.randrange(14)) for _ in range(16)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
        want = {v for v in range(70) if sum(x == v for x, _ in graph) == 1 and sum(y == v for _, y in graph) == 1}
        assert {r.node for r in S.going_on(spark.createDataFrame(graph, "enters long, leaves long")).collect()} == want >= {50, 51, 52, 60}


def test_pieces_of_a_path_join_up_into_long_spans():
    runs = [(20, 5, True, 3, 3), (10, 2, True, 1, 1), (14, 6, True, 2, 2), (25, 9, False, 4, 5), (34, 1, True, 6, 6), (40, 1, False, 7, 7)]
    got = S.long_spans(*(np.array(c) for c in zip(*runs, strict=True)))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(10, 2, 1, 1), (14, 20, 2, 5), (34, 1, 6, 6), (40, 1, 7, 7)]


def test_long_spans_are_held_against_their_words(spark):
    ddl = "proof array<struct<first:bigint,last:bigint,windows:bigint,words:binary>>"
    same, other = (1, 3, 9, b"a"), (1, 3, 8, b"b")
    S.check_spans(spark.createDataFrame([([same, other],), ([same],), ([],), (None,)], ddl))
    with pytest.raises(ValueError):
        S.check_spans(spark.createDataFrame([([same],), ([(1, 3, 9, b"c")],)], ddl))


def test_a_long_repeat_is_one_span_of_one_path(spark):
    """A passage of 300 words in three texts, once with another word in its middle: two paths beside the changed windows."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(300)]
    changed = [*passage[:150], "other", *passage[151:]]
    around = lambda: [f"x{rng.randrange(10**9)}" for _ in range(20)]
    docs = spark.createDataFrame([(k, " ".join([*around(), *p, *around()])) for k, p in enumerate([passage, passage, changed])], "doc_id long, text string")
    got = {r.doc_id: [(s.first_word, s.end_word) for s in r.spans] for r in S.remove_repeats(docs).collect()}
    assert got == {0: [(20, 320)], 1: [(20, 320)], 2: [(20, 170), (171, 320)]}


def test_substring_dedup_of_periodic_and_shifted_texts(spark):
    """Cycles of the graph, alone and entered from outside, beside texts that hold parts of each other."""
    rng = random.Random(6)
    cycle = [f"c{k}" for k in range(7)]
    base = [f"w{k}" for k in range(130)]
    texts = [cycle * 20, ["a", *cycle * 8, "b"], ["z"] * 90, ["z"] * 34, base, base[20:90], ["x", *base[50:], *base[:60]], [*base[:40], *cycle * 6], [rng.choice("uv") for _ in range(400)]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = S.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(docs.collect())
