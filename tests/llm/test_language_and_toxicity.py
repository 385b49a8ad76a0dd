import math
import random
import zlib

import numpy as np
import pytest
from clausewright.llm import language_id as L
from clausewright.llm import toxicity as T
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ber", "sch", "ung", "ein"], "cc": ["é", "que", "eau", "oi"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def speakers(spark, n=240):
    rng = random.Random(1)
    rows = [(k, speak(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for k in range(n)]
    rows += [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "123 !!", "bb"), (n + 3, speak(rng, "aa", 30), None), (None, speak(rng, "bb", 30), None), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string")


def test_longest_matches_of_the_automaton():
    rng, text = random.Random(2), b"banana bandana ananas nab"
    a = L.SuffixAutomaton(text)
    for _ in range(500):
        t = bytes(rng.choice(b"abnds ") for _ in range(10))
        at = rng.randrange(10)
        assert a.longest(t, at) == max((n for n in range(1, 11 - at) if t[at : at + n] in text), default=0)


def brute_phrases(text, known):
    n = at = 0
    while at < len(text):
        at += max([1, *(k for k in range(1, len(text) - at + 1) if text[at : at + k] in known)])
        n += 1
    return n


def test_parses_match_brute_force(monkeypatch):
    """Side by side and one by one, texts of all lengths, with bytes that no language has."""
    rng = random.Random(4)
    samples = tuple((lang, (speak(rng, lang, 40), speak(rng, lang, 25))) for lang in SYLLABLES)
    known = {name: b"".join(map(L.normalised, texts)) for name, texts in samples}
    texts = [speak(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 30)) + rng.choice(["", " ж", " kabereau", " 12 x-ÿ"]) for _ in range(60)] + ["ж", speak(rng, "aa", 150), None, "", "1 2", "é"]
    want = []
    for t in texts:
        norm = L.normalised(t or "")
        costs = {name: brute_phrases(norm, k) * math.log2(max(L.LEAST_BYTES, len(k))) for name, k in known.items()}
        want.append(min(costs, key=lambda n: (costs[n], n)) if norm else "und")
    for few, side_by_side in ((0, 1 << 20), (96, 1 << 20), (10**6, 1 << 20), (12, 300)):
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "SIDE_BY_SIDE", side_by_side)
        languages = L.Languages(samples)
        assert [g[0] for g in languages.predict(texts)] == want
        some = [L.normalised(t) for t in texts if t and L.normalised(t)]
        assert languages.phrases(some).T.tolist() == [[brute_phrases(t, known[n]) for n in languages.names] for t in some]
    assert len(set(want)) == 4


def test_samples_are_whole_texts_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_ROWS", 3)
    monkeypatch.setattr(L, "SAMPLE_LONGEST", 100)
    rng = random.Random(6)
    rows = [(k, "x" * 90 + str(k), "aa") for k in range(50)] + [(100 + k, "y " * (200 + k), "bb") for k in range(9)] + [(200, None, "cc"), (201, "z", None)]
    rng.shuffle(rows)
    got = dict(L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(got) == {"aa", "bb"} and len(got["aa"]) == 3 and got["bb"] == ("y " * 200,)
    assert set(got["aa"]) <= {t for _, t, _ in rows}
    monkeypatch.setattr(L, "SAMPLE_CHARS", 400)  # each has half of it: two texts fit, or an excerpt of one that doesn't
    got = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [(name, len(texts), len(texts[0])) for name, texts in got] == [("aa", 2, len(got[0][1][0])), ("bb", 1, 200)]


def test_numerals_are_no_letters():
    known = L.Languages((("fr", ("une demi et deux",)), ("en", ("one half and two",))))
    told = known.predict(["½ ² ③", "①②", "x²", "two½two", "Ⅷ ٣", None])
    assert [lang for lang, _ in told[:2]] == ["und", "und"] and told[4] == ("und", 0.0) and told[5] == ("und", 0.0)
    assert L.normalised("x²y ½") == b" x y " and L.normalised("two½Two") == b" two two "


def test_any_number_of_languages_can_be_learned(spark):
    rng = random.Random(9)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rng.randint(2, 7))) for _ in range(40)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(words) * 8)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert {r.lang_pred for r in got} == set(words) and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)


def test_languages_are_told_on_the_held_out_fold(spark):
    docs = speakers(spark)
    got = L.identify(docs).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (240, 241, 242)} == {240: "und", 241: "und", 242: "und"}


def test_language_of_nothing(no_documents, documents):
    assert L.identify(no_documents).collect() == []
    nameless = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(nameless).collect()} == {"und"}


def toxic_corpus(spark, n=900):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        words = speak(rng, "aa", rng.randint(20, 80)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "scummy"]))
        docs.append((k, " ".join(words)))
        if k % 2:
            labels.append((k, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "kalo mitu"), (7, docs[7][1])]
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, predicted int"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = toxic_corpus(spark)
    train_fold = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = T.score(docs, T.learn(docs.filter(train_fold), labels.filter(train_fold))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in want]
    toxic, clean = ([r.predicted for r in held if want[r.doc_id] == y] for y in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def some_rows(rng, n, size, toxic):
    columns = [np.array(sorted(rng.choice(size, 6, replace=False)) if not toxic else sorted(rng.choice(size // 2, 6, replace=False))) for _ in range(n)]
    return T.Rows(columns, [rng.random(6) + 0.5 for _ in columns])


@pytest.mark.parametrize("shift", [-2.0, 3.0])
def test_the_step_is_the_gradient_of_the_risk(shift):
    """Numerically, in both cases: the corrected part positive, and negative, where the step goes up along it."""
    rng = np.random.default_rng(1)
    positive, unlabelled = some_rows(rng, 40, 20, True), some_rows(rng, 60, 20, False)
    w, prior = np.append(rng.normal(0, 0.5, 20) + (shift > 0) * np.repeat([1.0, -2.0], 10), shift if shift < 0 else 0.0), 0.2 if shift < 0 else 0.95
    of_risk = lambda v: (lambda r: r[0] + r[1] if r[1] >= 0 else -r[1])(T.risk(positive, unlabelled, prior, v))
    assert (T.risk(positive, unlabelled, prior, w)[1] < 0) == (shift > 0)
    got = T.step(positive, unlabelled, prior, w)
    for k in range(21):
        up, down = w.copy(), w.copy()
        up[k], down[k] = w[k] + 1e-6, w[k] - 1e-6
        assert got[k] == pytest.approx((of_risk(up) - of_risk(down)) / 2e-6, abs=1e-6)


def test_training_lowers_the_risk_below_that_of_its_start():
    rng = np.random.default_rng(2)
    positive = some_rows(rng, 300, 40, True)
    mixed = [some_rows(rng, 1, 40, rng.random() < 0.2) for _ in range(1500)]
    unlabelled = T.Rows([m.columns for m in mixed], [m.values for m in mixed])
    whole = lambda w: sum(max(0.0, x) for x in T.risk(positive, unlabelled, 0.2, w))
    at_start, bias = T.train(positive, unlabelled, 0.2, epochs=2, rate=0.0)
    trained, trained_bias = T.train(positive, unlabelled, 0.2)
    start, end = whole(np.append(at_start, bias)), whole(np.append(trained, trained_bias))
    assert end < 0.8 * start
    none, none_bias = T.train(T.Rows([], []), unlabelled, 0.2)
    assert not none.any() and none_bias < 0


def test_rows_that_repeat_an_id_are_one_of_the_sample(spark, monkeypatch):
    docs, labels = toxic_corpus(spark, 200)
    many = docs.unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(50)).drop("id"))
    seen = []
    monkeypatch.setattr(T, "train", lambda p, u, prior: seen.append((len(p), len(u))))
    T.learn(docs, labels)
    T.learn(many, labels)
    assert seen[0] == seen[1]


def test_toxicity_without_labels(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(no_documents, T.learn(no_documents, none)).collect() == []
    assert all(r.predicted == 0 for r in T.score(documents, T.learn(documents, none)).collect())


def test_training_is_the_same_every_time(spark):
    docs, labels = toxic_corpus(spark, 300)
    one, two = T.learn(docs, labels), T.learn(docs.repartition(7), labels)
    assert (one[0] == two[0]).all() and one[1] == two[1]
