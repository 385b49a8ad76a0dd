import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from clausewright.llm import conversation_repair as C
from clausewright.llm import sharding, tree_join
from pyspark.sql import functions as F


# ---------------------------------------------------------------- sharding


def test_shards_follow_ids_and_slots_have_no_gaps(spark, documents, no_documents):
    got = sharding.assign(documents, [1.0] * 7).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"key"}
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    assert sharding.assign(no_documents, [1.0, 2.0]).collect() == []


def test_draws_follow_weights_and_few_records_move(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    before, after = [1.0, 2.0, 0.0, 3.0], [1.0, 2.0, 2.0, 3.0]
    rows = ids.select("k", sharding.place(F.col("k"), before).alias("a"), sharding.place(F.col("k"), after).alias("b"), sharding.place(F.col("k"), [1.0, 2.0, 0.0, 0.0]).alias("c")).collect()
    n = Counter(r.a for r in rows)
    assert n[2] == 0 and all(abs(n[k] - 20_000 * w / 6) < 400 for k, w in enumerate(before))
    assert all(r.b in (r.a, 2) for r in rows) and abs(sum(r.b == 2 for r in rows) - 5_000) < 400
    assert all(r.c == r.a for r in rows if r.a in (0, 1))  # only the closed shard's records move
    closed = Counter(r.c for r in rows if r.a == 3)
    assert abs(closed[1] / closed[0] - 2) < 0.2
    with pytest.raises(ValueError, match="positive"):
        sharding.place(F.col("k"), [0.0])


def test_equal_rows_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    rows = spark.createDataFrame([(1, "x")] * 95 + [(k, "y") for k in range(50)] + [(None, None)] * 3, "g long, t string")
    got = sharding.numbered(rows, "g", 3).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.g].append(r.slot)
    assert len(got) == 148 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots[1]) == 96


def test_shards_are_written_whole(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text", "lang")
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0, 1.0, 1.0], files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.lang) for r in back.collect()) == Counter(map(tuple, docs.collect()))
    assert all(len(list(p.glob("part-*"))) <= 2 for p in (tmp_path / "out").glob("shard=*"))
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == {(r.doc_id, r.shard) for r in sharding.assign(documents, [1.0] * 3).collect()}


# ---------------------------------------------------------------- conversations


def brute_repair(turns):
    """turns: (initial, fault). The least (cost, audit) of all edits that give a sound conversation, by Dijkstra over strings."""
    grammar = re.compile(r"(s?(ua)+)?")
    heap, seen = [(0, "", 0, "")], set()
    best = None
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if (audit, at, roles) in seen:
            continue
        seen.add((audit, at, roles))
        if at == len(turns) and grammar.fullmatch(roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if len(roles) < len(turns) + 4:
            for r in "ua":
                heapq.heappush(heap, (cost + 3, audit + "I", at, roles + r))
        if at < len(turns):
            initial, fault = turns[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + initial))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + r))
    return best


def test_viterbi_matches_all_edits():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 4] * 30:
        turns = [(rng.choice("suuaax"), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]
        paths = [(0, ""), None, None, None]
        C._close(paths)
        for initial, fault in turns:
            paths = C._step(paths, initial, fault)
        assert min(p for p in (paths[0], paths[3]) if p) == brute_repair(turns), turns


def plain_report(turns):
    """A conversation's report by a DP over (cost, audit, roles) without pruning, windows or streaming. turns: (turn, role, text) in order."""
    seen, faults, made = set(), Counter(), []
    for _, role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        made.append((role, text, fault))
    layer = {"": (0, "", ())}

    def relax(out, state, path):
        if state not in out or path[:2] < out[state][:2]:
            out[state] = path

    def close(layer):
        for _ in range(4):
            for state, (c, a, t) in list(layer.items()):
                to = "a" if state == "u" else "u"
                relax(layer, to, (c + 3, a + "I", (*t, ("user" if to == "u" else "assistant") + ":")))

    close(layer)
    for role, text, fault in made:
        out = {}
        for state, (c, a, t) in layer.items():
            relax(out, state, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more, to = 3 if fault else 0, "a" if state == "u" else "u"
            relax(out, to, (c + 3 + more, a + "R", (*t, ("user" if to == "u" else "assistant") + ":" + text)))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                relax(out, role[:1], (c + more, a + "K", (*t, role + ":" + text)))
        close(out)
        layer = out
    cost, audit, lines = min(layer[s] for s in ("", "a") if s in layer)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))  # noqa: B905
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def brute_damage(rows):
    out = defaultdict(list)
    for r in rows:
        conv, turn, role, text = (" " if x is None else x for x in (r.conv_id, r.turn, r.role, r.text))
        out[r.conv_id]
        what = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            out[r.conv_id] += [(r.turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest())
    return {c: sorted(t, key=key) for c, t in out.items()}


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(11)
    rows = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 4, 8, 8, 30])):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t + rng.choice([0, 0, 0, 0, 3]), role, rng.choice(["Hello.", "Is it?", "no end", "", " \n", None, "A longer text! é", f"own {t}."])))
    rows += [(500, t, "user" if t % 2 else "assistant", f"text {t % 50}.") for t in range(900)]  # one long conversation
    rows += [(501, 1, "user", "the same.")] * 300 + [(502, None, "user", "a."), (502, None, "assistant", "b."), (502, None, "user", "a."), (None, 1, "user", "x."), (None, None, None, None)]
    rows += [(503, 0, "user", "z" * 300_000 + ".")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, conv string, kind string").repartition(5).cache()


def test_reports_match_brute_force(spark, conversations):
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(C.damaged(conversations), conversations.select("conv_id")).collect()}
    want = {c: plain_report(t)[:-1] for c, t in brute_damage(conversations.collect()).items()}
    assert got == want
    assert any(v[6] == "" for v in want.values()) and any("R" in v[6] for v in want.values()) and any("I" in v[6] for v in want.values())


def test_repaired_turns_give_the_digest(spark, conversations):
    turns = defaultdict(list)
    for r in C.repair(C.damaged(conversations)).collect():
        turns[r.conv_id].append(r)
    for conv, rows in brute_damage(conversations.collect()).items():
        lines = plain_report(rows)[-1]
        own = sorted(turns[conv], key=lambda r: r.place)
        assert [f"{r.role}:{r.text}" for r in own] == list(lines) and [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_report(C.damaged(empty), empty.select("conv_id")).collect() == [] and C.repair(empty).collect() == []


def test_decided_turns_leave_the_memory():
    now = C.Conversation()
    for t in range(5000):
        now.add(t, ("user", "assistant", "assistant")[t % 3], f"text {t}.", True)
    assert len(now.waiting) <= 2 * C.WINDOW and max(len(p[1]) for p in now.paths if p) <= 4 * C.WINDOW


# ---------------------------------------------------------------- join

ROWS = "id long, k long, x double, row string, key string, kind string, l string"


def sides(spark, rng, n_left, n_right):
    keys = lambda n: [rng.choice([1, 1, 1, 2, 2, None, *range(10, 40)]) for _ in range(n)]
    left = [(i, k, i / 7) for i, k in enumerate(keys(n_left))] + [(900 + i, 77, None) for i in range(40)]  # 77: hot, on the left alone
    right = [(i, k, None if i % 9 == 0 else i / 3) for i, k in enumerate(keys(n_right))] + [(None, 1, 1.0), (None, None, 1.0)]
    left += left[:25] + left[:25]  # doubled rows
    made = lambda rows: spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], ROWS).repartition(3)
    return made(left), made(right)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize(("list_rows", "fan"), [(3, 2), (7, 3), (10_000, 16)])
def test_tree_join_equals_a_join(spark, monkeypatch, how, list_rows, fan):
    monkeypatch.setattr(tree_join, "FAN", fan)
    left, right = sides(spark, random.Random(5), 160, 90)
    got = tree_join.tree_join(left, right, "k", how, pairs=50, rows=30, list_rows=list_rows)
    a, b = left.select("k", F.struct("*").alias("left")), right.select("k", F.struct("*").alias("right"))
    want = a.join(b, "k", how)
    plain = lambda df: Counter((r.k, r.left, r.right) for r in df.collect())
    assert plain(got) == plain(want) and got.columns == ["k", "left", "right"]


def test_the_tree_splits_until_tasks_are_small(spark, monkeypatch):
    monkeypatch.setattr(tree_join, "FAN", 2)
    left, right = sides(spark, random.Random(6), 400, 400)
    made = tree_join.TreeJoin(left, right, F.col("k"), F.col("k"), [F.col("id")], [F.col("id")], pairs=50, rows=30, list_rows=5)
    lists = made.placed.filter("kind = 'hot'").groupBy("is_left", "key", "sub").count()
    assert lists.agg(F.max("count")).first()[0] <= 25 and lists.filter("key = 1").count() > 10
    n = {(r.is_left, r.key): r.n for r in made.placed.filter("kind = 'hot'").groupBy("is_left", "key").agg(F.count("*").alias("n")).collect()}
    for r in made.leaves.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("d")).collect():
        assert r.n == r.d == -(-n[True, r.key] // 5) * -(-n[False, r.key] // 5)


def test_reports_of_a_join(spark):
    left, right = sides(spark, random.Random(7), 200, 120)
    got = tree_join.join_report(left, right, "id", F.col("k"), "x", "id", F.col("k"), "x", ("click", "sale"), pairs=50, rows=30, list_rows=7)
    rows = {s: [(r.id, r.k, r.x) for r in df.collect()] for s, df in (("click", left), ("sale", right))}
    crc = lambda i, x: zlib.crc32(f"{'' if i is None else i}:{'' if x is None else math.floor(100 * x + 0.5)}".encode())
    want = {}
    for side, other in (("click", "sale"), ("sale", "click")):
        for i, k, _ in rows[side]:
            met = [crc(p, x) for p, q, x in rows[other] if k is not None and q == k]
            key, copies, inner, full, total = want.get((side, i), (None, 0, 0, 0, 0))
            key = k if key is None else key if k is None else max(k, key)
            want[side, i] = key, copies + 1, inner + len(met), full + max(1, len(met)), total + sum(met)
    assert {(r.side, r.id): (r.client_id, r.copies, r.inner_rows, r.full_rows, r.partner_crc) for r in got.collect()} == want
    assert all(r.left_rows == (r.full_rows if r.side == "click" else r.inner_rows) for r in got.collect())


def test_joins_with_nothing(spark):
    left, right = sides(spark, random.Random(8), 20, 20)
    none = left.limit(0)
    assert tree_join.tree_join(none, right, "k").collect() == [] and tree_join.tree_join(none, none, "k", "full").collect() == []
    assert tree_join.tree_join(left, none, "k", "full", pairs=5, rows=5).count() == left.count()
