"""Itemsets within groups, containment and the producers of flags, against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from clausewright.functions import stored as stored_module
from clausewright.operators import associations, itemsets, scoring

ITEMS = "abcdefg"


@pytest.fixture(scope="module")
def baskets(spark):
    """Two groups of random baskets, one group of three baskets, one item in nearly all; nulls and repeated rows."""
    rng = random.Random(2)
    rows = []
    for b in range(150):
        g = ("x", "y", "y")[b % 3]
        rows += [(g, b, i) for i in ITEMS if rng.random() < (0.95 if i == "a" else 0.4 if g == "x" or i < "d" else 0.15)]
    rows += [("small", b, "a") for b in range(900, 903)] + rows[:20]
    rows += [(None, 5, "a"), ("x", None, "a"), ("x", 5, None)]
    return spark.createDataFrame(rows, "g string, b int, i string").repartition(3).cache()


def held(baskets):
    out = defaultdict(set)
    for r in baskets.collect():
        if None not in (r.g, r.b, r.i):
            out[r.g, r.b].add(r.i)
    return out


def brute_sets(baskets, support, least_baskets, least_count):
    by_group = defaultdict(list)
    for (g, _), items in held(baskets).items():
        by_group[g].append(items)
    out = {}
    for g, lists in by_group.items():
        n = Counter(s for items in lists for k in range(1, len(items) + 1) for s in itertools.combinations(sorted(items), k))
        if len(lists) >= least_baskets:
            out |= {(g, s): (k, len(lists)) for s, k in n.items() if k >= max(support * len(lists) - 1e-9, least_count)}
    return out


@pytest.mark.parametrize(("support", "least_baskets", "least_count", "sent"), [(0.1, 20, 5, 20_000), (0.3, 1, 1, 20_000), (0.1, 20, 5, 0), (0.05, 20, 12, 20_000)])
def test_itemsets_match_subset_counting(baskets, monkeypatch, support, least_baskets, least_count, sent):
    monkeypatch.setattr(stored_module, "SENT_ROWS", sent)  # 0: every join is by shuffling
    got = itemsets.frequent_itemsets(baskets, "g", "b", "i", support, least_baskets, least_count).collect()
    want = brute_sets(baskets, support, least_baskets, least_count)
    assert {(r.g, tuple(r["items"])): (r.n, r.baskets) for r in got} == want and len(got) == len(want)
    assert max(len(s) for _, s in want) >= 2 and (least_baskets == 1) == any(g == "small" for g, _ in want)


def test_rules_follow_from_itemsets(baskets):
    sets = brute_sets(baskets, 0.1, 20, 5)
    got = itemsets.rules_of(itemsets.frequent_itemsets(baskets, "g", "b", "i", 0.1), "g", 0.5, 1.0).collect()
    want = {}
    for (g, s), (n, total) in sets.items():
        for c in s if len(s) > 1 else ():
            a = tuple(x for x in s if x != c)
            confidence, lift = n / sets[g, a][0], n * total / (sets[g, a][0] * sets[g, (c,)][0])
            if confidence >= 0.5 and lift >= 1:
                want[g, a, c] = round(n / total, 9), round(confidence, 9), round(lift, 9)
    assert {(r.g, tuple(r.antecedent), r.consequent[0]): (round(r.support, 9), round(r.confidence, 9), round(r.lift, 9)) for r in got} == want
    assert len({r.rule_id for r in got}) == len(got)


def test_contained_sets(spark, baskets):
    rng = random.Random(4)
    sets = [(g, f"s{k}", sorted(rng.sample(ITEMS, rng.randint(1, 4)))) for k, g in enumerate(["x", "y"] * 12)] + [("x", "none", ["a", "zzz"]), ("x", "twice", ["b", "b"]), ("other", "o", ["a"])]
    got = itemsets.contained(baskets, spark.createDataFrame(sets, "g string, set_id string, items array<string>"), "g", "b", "i")
    want = Counter((b, g, s) for (g, b), items in held(baskets).items() for h, s, want in sets if g == h and set(want) <= items)
    assert Counter((r.b, r.g, r.set_id) for r in got.collect()) == want and sum(want.values()) > 100


def test_flags_of_missing_consequents_name_the_strongest_rule(spark, baskets):
    rules = [("x", "r1", ["a"], ["b"], 0.5, 2.0), ("x", "r2", ["a", "c"], ["b"], 0.6, 2.0), ("x", "r3", ["c"], ["b", "d"], 0.6, 2.0), ("y", "r4", ["a", "b"], ["c"], 0.9, 1.1)]
    got = scoring.missing_consequents(baskets, spark.createDataFrame(rules, "g string, rule_id string, antecedent array<string>, consequent array<string>, confidence double, lift double"), "b", "g", "i")
    want = {}
    for (g, b), items in held(baskets).items():
        for h, rule, antecedent, consequent, confidence, lift in rules:
            for c in consequent:
                if g == h and set(antecedent) <= items and c not in items:
                    want[b, g, c] = min(want.get((b, g, c), (0, 0, "~")), (-lift, -confidence, rule))
    assert {(r.b, r.g, r.i): (-r.lift, -r.confidence, r.rule_id) for r in got.collect()} == want
    assert {v[2] for v in want.values()} == {"r1", "r2", "r3", "r4"}


def test_unexpected_labels_and_rare_combinations(spark, baskets):
    lists = held(baskets)
    totals = Counter(g for g, _ in lists)
    share = {k: n / totals[k[0]] for k, n in Counter((g, i) for (g, _), items in lists.items() for i in items).items()}
    shares = spark.createDataFrame([(g, i, s) for (g, i), s in share.items()], "g string, i string, share double")
    got = scoring.unexpected(baskets.dropna(), shares, "b", "g", "i", 0.2).collect()
    want = {(b, g, i): round(1 - share[g, i], 9) for (g, b), items in lists.items() for i in items if share[g, i] < 0.2}
    assert {(r.b, r.g, r.i): round(r.prevalence_gap, 9) for r in got} == want and want
    pairs = associations.pair_rules(baskets.dropna(), "b", "i", ("g",)).filter("lift < 0.95")
    odd = {(r.g, r.antecedent, r.consequent): r.lift for r in pairs.collect() if r.antecedent < r.consequent}
    got = scoring.rare_combinations(baskets, pairs, "b", "g", "i").collect()
    want = {(b, g, x, y): lift for (g, b), items in lists.items() for (h, x, y), lift in odd.items() if g == h and {x, y} <= items}
    assert {(r.b, r.g, *r["items"]): r.lift for r in got} == want and want


def test_scores_add_up_all_kinds_of_flags(spark):
    rows = [(1, "missing_arm_consequent", None, 0.5, 2.0), (1, "missing_expected", 0.5, None, None), (2, "unexpected_clause", 0.9, None, None), (2, "rare_combination", None, None, 0.4), (3, "rare_combination", None, None, None)]
    got = scoring.deviation_score(spark.createDataFrame(rows, "d int, kind string, prevalence_gap double, confidence double, lift double"), "d")
    want = {1: (3 * (1 + 0.75 + 1.0) + 2 * 2.0, "high"), 2: (1.5 * 2.8 + 1.2, "high"), 3: (1.0, "low")}
    assert {r.d: (round(r.score, 9), r.tier) for r in got.collect()} == {d: (round(s, 9), t) for d, (s, t) in want.items()}


def test_nothing_gives_nothing(spark, baskets):
    none = baskets.limit(0)
    sets = itemsets.frequent_itemsets(none, "g", "b", "i", 0.1)
    assert sets.collect() == [] and itemsets.rules_of(sets, "g").collect() == []
    assert scoring.top_outliers(spark.createDataFrame([], "d long, score double"), "d").collect() == []


def test_the_highest_scores_and_few_scans(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1, 1, 2, 3, 5, 8]))) for i in range(500)]
    got = scoring.top_outliers(spark.createDataFrame(rows, "d long, score double"), "d")
    assert sorted(r.d for r in got.collect()) == sorted(d for d, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:50])
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 5


def test_stored_tables_are_freed_by_session(spark):
    stored_module.clear(spark)
    other = spark.newSession()
    kept = stored_module.stored(other.range(3))
    for _ in range(2):
        stored_module.stored(spark.range(5).repartition(2))
    assert stored_module.clear(spark) == 2 and stored_module.clear(spark) == 0
    assert kept.count() == 3 and stored_module.clear(other) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_contents_stand_for_their_baskets(baskets):
    lists = itemsets.contents(baskets, "g", "b", "i")
    assert {(r.group, r.basket): set(r.has) for r in lists.collect()} == held(baskets)
    counts = itemsets.counts_of(lists)
    assert counts.count() < lists.count() == sum(r.n for r in counts.collect())
    sets = lambda df, g: {(r[g], tuple(r["items"])): (r.n, r.baskets) for r in df.collect()}
    assert sets(itemsets.itemsets_of(counts, 0.1), "group") == sets(itemsets.frequent_itemsets(baskets, "g", "b", "i", 0.1), "g")
    totals = Counter(g for g, _ in held(baskets))
    want = Counter((g, i) for (g, _), items in held(baskets).items() for i in items)
    assert {(r.group, r.item): (r.n, r.share) for r in itemsets.shares_of(counts).collect()} == {k: (n, n / totals[k[0]]) for k, n in want.items()}
    pairs = {(r.g, r.antecedent, r.consequent): (r.n_both, r.lift) for r in associations.pair_rules(baskets.dropna(), "b", "i", ("g",)).collect() if r.antecedent < r.consequent}
    got = {(r.group, r.antecedent, r.consequent): (r.n_both, r.lift) for r in itemsets.pairs_of(counts).collect()}
    assert got.keys() == pairs.keys() and all(got[k] == pytest.approx(v) for k, v in pairs.items())
