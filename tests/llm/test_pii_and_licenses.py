import hashlib
import random
import re
import time
import pytest
from clausewright.llm import license_texts, licenses, pii


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(3)
    parts = ["@", ".", "-", "+", "1", "2", "25", "255", "0", "00", "a", "b", " ", "(", ")", "4111", "é", "_", "%"]
    found = 0
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        found += len(brute(t))
        assert pii.base_spans(t) == brute(t)
    assert found > 200
    assert pii.base_spans("1" * 50_000 + "@" * 50) == brute("1" * 50_000)


def test_rows_and_digests(documents, no_documents):
    got = pii.find_pii(documents).collect()
    assert len(got) == documents.count()
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_pii(no_documents).collect() == []


def test_context_finds_unseen_identifiers(spark):
    """Card numbers follow "charged to account"; so does one that fails the checksum."""
    valid = ["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220", "6011000990139424", "3530111333300000", "5555555555554444", "4000056655665556"]
    rows = [(k, f"the sum was charged to account {c} on the day") for k, c in enumerate(valid)]
    rows += [(20, "so it was charged to account 4111111111111112 and then"), (21, "the build number is 4111111111111112345 here"), (22, "call +1 (555) 123-4567 or mail a.b@c.example.org from 10.0.0.1"), (23, None)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_card == 1 for k in range(len(valid)))
    assert got[20].n_card == 0 and got[20].spans == "card:29:45"
    assert got[21].spans == "" and got[23].spans == ""
    text = rows[-2][1]
    assert got[22].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    assert got[22].base_sha256 == hashlib.sha256(got[22].spans.encode()).hexdigest()


def test_context_finds_numbers_of_other_shapes(spark):
    """Phones follow "call me at"; so do one without + and one in blanks. Contexts that hold other numbers, too, add none."""
    rows = [(k, f"please call me at +1 (017) 555-77{k}3 or not") for k in range(10, 30)]
    rows += [(k, f"the number +1 (018) 555-77{k}3 was read out") for k in range(30, 34)] + [(k, f"the number 9{k}123 was read out") for k in range(40, 44)]
    rows += [(50, "so call me at 555-123-4567 on Monday"), (51, "or call me at 030 1234 5678."), (52, "a build 030 1234 5679 here"), (53, "call me at 12 on Monday")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "phone:14:26" and got[51] == "phone:14:27"
    assert all(got[k] == "" for k in (40, 41, 42, 43, 52, 53))
    text = "ab 123456 10.0.0.1 x"
    assert [m[:3] for m in pii.mentions(text, pii.base_spans(text))] == [("ip", 10, 18), (None, 3, 9)]


def test_contexts_of_any_length():
    long = "x" * 5000
    text = f"one {long}y, 1 {'2' * 3000} (tel:+49 170 1234567) {'3' * 900} {long}z end"
    start = text.index("+49")
    assert pii.Words(text).patterns(start, start + 15) == [f"{pii._digest(long + 'y')} tel _", f"tel _ {pii._digest(long + 'z')}"]
    assert pii.Words(text).patterns(start, start + 14) == pii.Words(text).patterns(start, start + 15)
    assert pii.Words("12 +49 170 1234567 34").patterns(3, 18) == []
    assert pii.Words("a b").patterns(0, 3) == []


def brute_bootstrap(rows):
    """Scores by plain loops until nothing changes."""
    seeds = {(v, k) for k, v, _ in rows if k}
    seeded, by_pattern = {v for v, _ in seeds}, {}
    for _, v, p in rows:
        by_pattern.setdefault(p, set()).add(v)
    scores = dict.fromkeys(seeds, 1.0)
    while True:
        sure = {}
        for p, values in by_pattern.items():
            for kind in pii.KINDS:
                known = [scores[v, kind] for v in values if (v, kind) in scores]
                share = sum(known) / (len(values) + pii.SUPPORT)
                if len(known) >= pii.LEAST_SEEDS and share >= pii.SURE:
                    sure[p, kind] = share
        now = dict.fromkeys(seeds, 1.0)
        for (p, kind), x in sure.items():
            for v in by_pattern[p] - seeded:
                now[v, kind] = max(round(x, 6), now.get((v, kind), 0))
        if now == scores:
            break
        scores = now
    best = {}
    for (v, kind), x in scores.items():
        if v not in seeded:
            best[v] = max(best.get(v, (0, 0, "")), (x, -pii.KINDS.index(kind), kind))
    return {v: kind for v, (_, _, kind) in best.items()}


def test_bootstrap_matches_brute_force(spark):
    rng = random.Random(9)
    total = 0
    for _ in range(3):
        kinds = {f"v{i}": rng.choice([None, "ip", "card", "phone", "phone"]) for i in range(60)}
        rows = [(kinds[v], v, p) for p in [f"p{k}" for k in range(40)] for v in rng.sample([v for v in kinds if int(p[1:]) % 3 or kinds[v] in (None, "phone")], rng.randint(5, 12))]
        rows += [("card", f"s{k}", "sure") for k in range(12)] + [(None, "n0", "sure"), (None, "n0", "next"), (None, "n1", "next")] + [("card", f"s{k}", "next") for k in range(6)]
        want = brute_bootstrap(rows)
        got = pii.bootstrap(spark.createDataFrame(rows, "kind string, value string, pattern string"), pii.Scratch(spark, "brute"))
        assert {r.value: r.kind for r in got.collect()} == want
        total += len(want)
    assert total >= 6


def test_texts_of_a_million_characters_in_seconds():
    began = time.monotonic()
    for unit in ("a", "1", " ", "a1", "1 ", "+1", "1.", "a@", "a@b.", "x12345, ", "1(", "\t1"):
        text = unit * (1_000_000 // len(unit))
        for _ in pii.mentions(text, pii.base_spans(text)):
            pass
    assert time.monotonic() - began < 60


def test_recall_of_unseen_identifiers_like_those_of_the_tables(spark):
    """Numbers after telling words amid invented prose, a third of them in shapes that no base pattern has."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice(["th", "er", "an", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows, planted = [], {}
    for k in range(300):
        unseen, lead = k % 3 == 0, rng.choice(["please dial", "her mobile is", "phone number"])
        number = f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}" if unseen else f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        text = f"{prose(20)} {lead} {number} {prose(9)}"
        rows.append((k, text))
        if unseen:
            planted[k] = f"phone:{text.index(number)}:{text.index(number) + len(number)}"
    rows += [(300 + k, f"{prose(12)} the version {rng.randint(10**6, 10**7)} {prose(9)}") for k in range(100)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == s for k, s in planted.items()) >= 0.9 * len(planted)
    assert not any(got[k] for k in range(300, 400))


def test_bootstrap_follows_long_chains(spark):
    """Each pattern is sure only with the instance that the one before it found."""
    rows = [("card", f"seed{k}", f"p{i}") for i in range(1, 8) for k in range(8 if i == 1 else 5)]
    rows += [(None, f"v{i}", f"p{j}") for i in range(1, 8) for j in (i, i + 1) if j < 8]
    got = pii.bootstrap(spark.createDataFrame(rows, "kind string, value string, pattern string"), pii.Scratch(spark, "chain"))
    assert sorted((r.value, r.kind) for r in got.collect()) == [(f"v{i}", "card") for i in range(1, 8)]


def test_licenses(spark, documents, no_documents):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [
        (1, "some prose here\n" + apache), (2, apache.upper().replace(" ", "!! ")), (3, "Some words. " + apache + " Other words follow here."), (4, mit.replace(" software ", " software\n", 3)),
        (5, "Licensed under nothing at all, sorry about that."), (6, None), (7, ""), (8, "x " * 50_000), (None, apache),
    ]
    got = {r.doc_id: (r.license, r.dice) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("Apache-2.0", 1.0), 2: ("Apache-2.0", 1.0), 3: ("Apache-2.0", 1.0), 4: ("MIT", 1.0), 5: (None, 0.0), 6: (None, 0.0), 7: (None, 0.0), 8: (None, 0.0), None: ("Apache-2.0", 1.0)}
    assert licenses.scan_licenses(no_documents).collect() == []
    assert {r.license for r in licenses.scan_licenses(documents).collect()} == {None}


def test_usual_wordings_headers_and_full_texts():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    mit, isc, bsd = licenses._MIT, licenses._ISC, licenses._BSD
    own = "Copyright (c) 2020 Some Holder\n\n"
    texts = [
        ("MIT", "Some prose.\nReleased under the MIT License."),
        ("MIT", "MIT License\n\n" + own + mit[0] + "\n\n" + mit[1] + "\n\n" + mit[2]),
        ("MIT", mit[0]), ("MIT", mit[1]), ("MIT", mit[2]),
        ("ISC", "ISC License\n\n" + own + isc[0] + "\n\n" + isc[1]), ("ISC", isc[1]),
        ("BSD-2-Clause", own + "\n\n".join((*bsd[:3], bsd[4]))),
        ("BSD-2-Clause", "\n".join((*bsd[:3], "", bsd[4]))),
        ("BSD-3-Clause", own + "\n\n".join(bsd)),
        ("BSD-3-Clause", own + "\n".join(bsd)),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
        ("Apache-2.0", own + "\n\n".join(licenses._APACHE)),
        ("Apache-2.0", "# Copyright 2020 A. Holder\n#\n# " + "\n#\n# ".join(licenses._APACHE)),
        ("GPL-3.0", licenses._GNU.format(what="program", stop=":", kind="", comma=",", version="3").replace(" GNU ", "\nGNU ")),
        ("LGPL-2.1", licenses._GNU.format(what="library", stop=";", kind="Lesser ", comma=";", version="2.1")),
        ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ]
    assert [(known.scan(t)[0], t) for _, t in texts] == texts
    assert [known.scan(t)[0] for _, t in licenses.TEMPLATES] == [k for k, _ in licenses.TEMPLATES]


def brute_license(text, templates, threshold):
    """Every run of words against every template."""
    w = licenses.words(text)
    best = (0, 0, "")
    for key, body in templates:
        b = licenses.bigrams(licenses.words(body))
        for i in range(len(w)):
            for n in range(1, len(w) - i):
                run = licenses.bigrams(w[i : i + n + 1])
                x = len(run & b)
                d = 2 * x / (len(run) + len(b))
                if d >= threshold - 1e-9 and (x * d, d) > best[:2]:
                    best = x * d, d, key
    return (best[2], best[1]) if best[2] else (None, 0.0)


def test_runs_match_brute_force():
    rng = random.Random(6)
    templates = (("A", "one two three four five six seven"), ("B", "one two three four five six eight nine ten"), ("C", "two one two one three"), ("D", "five six"))
    found = 0
    for threshold in (0.6, 0.8, 0.9):
        known = licenses.Templates(templates, threshold)
        for _ in range(400):
            w = " ".join([rng.choice(["x y", "one", "five six", rng.choice(templates)[1]]) for _ in range(rng.randint(0, 6))]).split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = rng.choice([["new"], [], ["one", "two"]])
            got, want = known.scan(" ".join(w)), brute_license(" ".join(w), templates, threshold)
            assert got[1] == want[1] and (got[0] is None) == (want[0] is None)
            found += got[0] is not None
    assert found > 300


def test_licences_amid_other_text():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    mit = "\n\n".join(licenses._MIT)
    code = "\nimport os\ndef f(x):\n    return os.path.join(x, 'y')\n" * 5
    assert known.scan(f"{code}/* MIT License\n * Copyright (c) 2020 A\n * " + mit.replace(", ", ",\n * ") + "*/" + code) == ("MIT", 1.0)
    assert known.scan("some words before it is Licensed under the Apache\nLicense, Version 2.0. and some after it") == ("Apache-2.0", 1.0)
    bsd = "\n".join(licenses._BSD)
    assert known.scan(code + bsd + "\nReleased under the MIT License." + code)[0] == "BSD-3-Clause"
    terms, zlib = license_texts.APACHE_TERMS, license_texts.ZLIB
    assert known.scan(code + "TERMS AND CONDITIONS\n" + "\n\n   ".join(terms).replace(" the ", "\n the ") + "\nEND" + code) == ("Apache-2.0", 1.0)
    assert known.scan(" ".join(terms[:8] + terms[9:]))[0] == "Apache-2.0"
    assert known.scan(code + "\n * ".join(zlib).replace("acknowledgment", "acknowledgement"))[0] == "Zlib"
    assert known.scan("\n".join(license_texts.UNLICENSE))[0] == "Unlicense" and known.scan("\n".join(license_texts.BOOST))[0] == "BSL-1.0"
    assert known.scan("Licensed under the Apache License, Version 2.0. " * 60)[0] == "Apache-2.0"
    assert known.scan("the license of the software is provided as it is without any text " * 3000) == (None, 0.0)


@pytest.mark.parametrize("kind", ["whole", "changed", "mixed"])
def test_a_megabyte_of_licence_text_takes_seconds(kind):
    """Runs are bounded by their bigrams, not by their places, and each place is looked at a bounded number of times."""
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    terms = " ".join(license_texts.APACHE_TERMS)
    rng = random.Random(1)
    words = terms.split()
    if kind == "changed":  # never quite the template
        words = [w if rng.random() > 0.01 else f"new{rng.randrange(10**6)}" for _ in range(120) for w in words]
    elif kind == "mixed":
        words = words + (licenses._MIT[0] + " " + "the license of the software ").split() * 1500
    else:
        words = words * 120
    text = " ".join(words)
    began = time.thread_time()
    got = known.scan(text)
    assert got[0] == "Apache-2.0" and got[1] > 0.9 and (kind == "changed" or got[1] == 1.0)
    assert len(text) > 500_000 and time.thread_time() - began < 20 * len(text) / 1e6
