import hashlib
import io
import re
from collections import Counter

import pytest
import zstandard
from clausewright.llm import common, decontaminate, warc
from clausewright.llm.common import Scratch


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_contamination(docs, items):
    """Counts of (doc_id, item_id, n_shared, n_shingles), row by row."""
    out = Counter()
    for item, text in items:
        k = min(5, len(re.findall(r"[^\W_]+", (text or "").lower())))
        s = shingles(text, k) if k else set()
        for doc, whole in docs:
            have = len(s & shingles(whole, k)) if s else 0
            if s and have >= 0.8 * len(s) - 1e-9:
                out[doc, item, have, len(s)] += 1
    return out


def test_contamination_matches_brute_force(spark, documents):
    rows = documents.collect()
    long = next(r.text for r in rows if r.text and len(r.text.split()) > 5000).split()
    items = [(1, " ".join(long[100:140])), (2, " ".join(long[300:330]).upper()), (3, " ".join([*long[500:540], "not", "there"])), (4, " ".join([*long[600:612], *["absent"] * 9])), (5, "too short"), (6, None), (7, ""), (None, rows[0].text), (1, " ".join(long[100:140])), (8, "two three four"), (9, long[0]), (10, " ".join(long[1000:5000])), (None, None)]
    got = decontaminate.find_contamination(documents, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")).collect()
    want = brute_contamination([(r.doc_id, r.text) for r in rows], items)
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got) == want
    assert {i for _, i, _, _ in want} == {1, 2, 3, 8, 9, 10, None}


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "say four short words here and more"), (2, "four short words apart here"), (3, "four short words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Four short words here")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_contamination(docs, items).collect()) == [1, 3]


def test_rows_with_null_or_equal_ids_are_apart(spark):
    """An item whose shingles are spread over rows of one id is in none of them."""
    docs = spark.createDataFrame([(None, "one two three four five"), (None, "two three four five six"), (7, "one two three four five"), (7, "two three four five six"), (7, "zero one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert [(r.doc_id, r.n_shared) for r in decontaminate.find_contamination(docs, items).collect()] == [(7, 2)]


@pytest.mark.parametrize("bound", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_contamination_without_broadcasts(spark, documents, monkeypatch, bound):
    rows = documents.collect()
    items = [(k, r.text) for k, r in enumerate(rows[:30])]
    monkeypatch.setattr(common, bound, -1)
    got = decontaminate.find_contamination(documents, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got) == brute_contamination([(r.doc_id, r.text) for r in rows], items)


def test_documents_keep_only_hashes_that_an_item_of_their_size_can_reach(spark):
    sketches = spark.createDataFrame([(10, 5), (12, 90), (100, 7)], "n_shingles long, h long")
    bounds = decontaminate.signature_bounds(sketches, 0.8)
    assert bounds[:3] == [None] * 3 and bounds[3:6] == [90] * 3 and bounds[6:] == [90] * 26
    assert decontaminate.signature_bounds(sketches.filter("n_shingles = 100"), 0.8)[5:8] == [None, 7, 7]


def test_contamination_of_nothing(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_contamination(documents, none).collect() == []
    assert decontaminate.find_contamination(no_documents, some).collect() == []


def test_no_python_on_the_main_path(documents):
    plan = decontaminate.find_contamination(documents, documents.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.fixture()
def pages(spark):
    body = "<p>équal</p>" * 20
    rows = [(5, "u5", body), (3, "u3", body), (9, None, body), (1, "u1", "<p>short</p>"), (2, "u\r\n2", "<p>short</p>"), (4, "u4", None), (6, "u6", ""), (7, "u7", "x" * 300_000), (None, "n", body), (3, "u3", body), (8, "u8", "WARC/1.1\r\n\r\n" * 30)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_give_back_what_went_in(spark, pages):
    scratch = Scratch(spark, "test_warc")
    manifest = scratch.table(warc.write_archives(pages, scratch.path("archives")), "manifest")
    got = warc.read_archives(manifest).collect()
    assert manifest.agg({"records": "sum"}).first()[0] == pages.count() == len(got)
    stored = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    for r in got:
        page = [p for p in pages.collect() if str(p.page_id) == str(r.record_id)]
        payload = (page[0].html or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        assert (r.refers_to == "3") == (len(payload) >= 100 and "équal" in payload.decode() and r.record_id != "3")
        assert stored[r.payload_digest] == payload
    assert sum(r.record_type == "revisit" for r in got) == 3


def test_archive_format():
    records = [warc.record(str(k), "u", b"<html>" * 50, 300, "d", None, "2024-01-01T00:00:00Z") for k in range(200)]
    data = b"".join(warc.archive(records))
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert list(warc.unarchive(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.unarchive(io.BytesIO(data[:-3])))
    size = int.from_bytes(data[4:8], "little")
    with pytest.raises(zstandard.ZstdError):  # the dictionary is needed
        zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])


def test_damaged_payloads_are_noticed():
    good = warc.record("1", "u", b"<html>", 6, hashlib.sha256(b"<html>").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)[:4] == ("1", "response", 6, hashlib.sha256(b"<html>").hexdigest())
    for bad in (good.replace(b"<html>", b"<htmm>"), good.replace(b"<html>", b"<htm>\r")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_records_without_page_have_an_id():
    data = warc.record(None, None, b"", 0, hashlib.sha256(b"").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert b"WARC-Record-ID: <urn:uuid:" in data and warc.parse(data)[0] is None


def test_folders_are_resolved_as_spark_does(spark, tmp_path):
    assert warc.qualified(spark, f"{tmp_path}/a") == f"file:{tmp_path}/a"
    assert warc._filesystem(f"file:{tmp_path}/a")[1] == warc._filesystem(f"file://{tmp_path}/a")[1] == f"{tmp_path}/a"


def test_archives_of_nothing(spark):
    scratch = Scratch(spark, "test_warc")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = scratch.table(warc.write_archives(none, scratch.path("archives")), "manifest")
    assert warc.read_archives(manifest).collect() == []


def test_revisits_are_borne_out_by_their_responses(spark):
    rows = [("1", "response", 200, "a", None), ("2", "revisit", 200, "a", "1"), ("3", "revisit", 200, "a", "1"), ("4", "revisit", 200, "b", "1"), ("5", "revisit", 100, "a", "1"), ("6", "revisit", 200, "a", "9"), ("7", "revisit", 200, "a", "2"), (None, "response", 5, "c", None)]
    records = spark.createDataFrame(rows, "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string")
    got = {(r.refers_to, r.payload_bytes, r.payload_digest): r.n for r in warc.unfounded(records).collect()}
    assert got == {("1", 200, "b"): 1, ("1", 100, "a"): 1, ("9", 200, "a"): 1, ("2", 200, "a"): 1}
    assert warc.unfounded(records.limit(0)).collect() == []


def test_archives_are_read_by_bytes(spark, monkeypatch):
    scratch = Scratch(spark, "test_warc")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(k, "u", f"<html>{k}" * 60) for k in range(120)], "page_id long, url string, html string").repartition(2)
    manifest = scratch.table(warc.write_archives(pages, scratch.path("archives")), "manifest")
    assert manifest.count() > 20
    assert warc.read_archives(manifest).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism  # few bytes: as many tasks as cores can use
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    assert warc.read_archives(manifest).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert sorted(int(r.record_id) for r in warc.read_archives(manifest).collect()) == list(range(120))
