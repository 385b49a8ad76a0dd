"""Clauses of texts and keywords of clusters, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from clausewright.operators import keywords as K
from clausewright.operators import segments as S

CONTRACT = """Preamble of the parties.

ARTICLE I
1. Definitions
1.1 Terms used here
(a) first
(b) second
(i) nested once
(ii) nested twice
1.2 More terms
2) Payment
(a) anew
  2.1.3 Deep
ARTICLE II
10 Closing words
12 34 is no heading
(j) letter
the end"""


def brute(text):
    if not text:
        return []
    kinds = [(S.ARTICLE, 1), (S.DECIMAL, None), (S.LETTER, 9), (S.ROMAN, 10)]
    heads, at = [], 0
    for n, line in enumerate(text.split("\n")):
        for pattern, level in kinds:
            if m := re.search(pattern, line):
                heads.append((at, level or min(1 + len(m[1].split(".")), 8), m[1]))
                break
        else:
            if n == 0:
                heads.append((0, 0, ""))
        at += len(line) + 1
    out, stack = [], []
    for k, (start, level, number) in enumerate(heads):
        if level:
            stack = [s for s in stack if s[0] < level] + [(level, number)]
        out.append((k, level, " > ".join(n for _, n in stack) if level else "", start, (heads[k + 1][0] if k + 1 < len(heads) else len(text)) - start))
    return out


def test_clauses_carry_their_path_and_rebuild_the_text(spark):
    rng = random.Random(3)
    pieces = ["1. A", "2. B", "1.1 x", "1.1.1.1.1.1.1.1.1.1 deep", "(a) y", "(ii) z", "Section 4 of", "ARTICLE X", "plain words", "", "  (b) indented", "é 1. no", "3.2) w", "(i) x", "99999 too long"]
    texts = [CONTRACT, None, "", "\n", "no heading", "1. only", "\n\n1. after blanks\n", "a" * 100_000 + "\n2. b"]
    texts += ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(120)] + ["\n".join(f"{k}. clause {k}" for k in range(1, 3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "r long, t string").repartition(3)
    got = defaultdict(list)
    for r in S.clauses(df, "r", "t").collect():
        got[r.r].append(r)
    for k, text in enumerate(texts):
        own = sorted(got.get(k, []), key=lambda r: r.ordinal)
        assert [(r.ordinal, r.level, r.path, r.start, r.length) for r in own] == brute(text), text
        assert "".join(r.clause for r in own) == (text or "")
    paths = [r.path for r in sorted(got[0], key=lambda r: r.ordinal)]
    assert paths == ["", "I", "I > 1", "I > 1 > 1.1", "I > 1 > 1.1 > a", "I > 1 > 1.1 > b", "I > 1 > 1.1 > b > i", "I > 1 > 1.1 > b > ii", "I > 1 > 1.2", "I > 2", "I > 2 > a", "I > 2 > 2.1.3", "II", "II > 10", "II > 10 > j"]


def brute_keywords(texts, k, candidates, diversity):
    counts = defaultdict(Counter)
    for c, t in texts:
        if c is not None and t is not None:
            counts[c].update(re.findall(r"[^\W\d_]{3,}", t.lower()))
    counts = {c: n for c, n in counts.items() if n}
    mean = sum(sum(n.values()) for n in counts.values()) / len(counts)
    overall = sum(counts.values(), Counter())
    weight = {c: {w: m / sum(n.values()) * math.log1p(mean / overall[w]) for w, m in n.items()} for c, n in counts.items()}

    def likeness(a, b):
        va, vb = ({c: w[x] for c, w in weight.items() if x in w} for x in (a, b))
        return sum(va[c] * vb.get(c, 0) for c in va) / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))

    out = {}
    for c, w in weight.items():
        left = sorted(w, key=lambda x: (-round(w[x], 12), x))[:candidates]
        top, taken = max(w.values()), []
        while left and len(taken) < k:
            score = lambda x: round((1 - diversity) * w[x] / top - diversity * max((likeness(x, y) for y in taken), default=0), 12)  # noqa: B023, E731
            taken.append(min(left, key=lambda x: (-score(x), x)))
            left.remove(taken[-1])
        out[c] = taken
    return weight, out


@pytest.mark.parametrize("diversity", [0.0, 0.3, 0.8])
def test_keywords_match_brute_force(spark, diversity):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = [(c, " ".join(rng.choice(words[c * 6 : c * 6 + 30]) for _ in range(rng.randint(0, 60)))) for c in [0, 1, 2, 3] * 12] + [(None, "abc"), (1, None), (9, "")]
    df = spark.createDataFrame(texts, "c int, t string").repartition(3)
    weighted = K.weights(K.word_counts(df, "c", "t"), "c")
    weight, chosen = brute_keywords(texts, 5, 12, diversity)
    assert {(r.c, r.word): pytest.approx(r.weight) for r in weighted.collect()} == {(c, w): x for c, ws in weight.items() for w, x in ws.items()}
    got = defaultdict(dict)
    for r in K.keywords(weighted, "c", 5, 12, diversity).collect():
        got[r.c][r.place] = r.word
    assert {c: [w for _, w in sorted(p.items())] for c, p in got.items()} == chosen


def test_keywords_of_nothing(spark):
    none = spark.createDataFrame([], "c int, t string")
    assert K.keywords(K.weights(K.word_counts(none, "c", "t"), "c"), "c").collect() == []
