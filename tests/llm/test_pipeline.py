import base64
import hashlib
import re

import corpus_pipeline
import duckdb
import public_tokenizers
import tiktoken
from clausewright.llm import ngram_join as J
from clausewright.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_force():
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i, t))
    docs = sorted((i, t) for _, i, t in (min(g) for g in groups.values()))
    hashes = J._WordHashes()
    sets = {i: set(J.shingle_set(t, hashes).tolist()) for i, t in docs}
    root = {i: i for i, _ in docs}
    for _ in range(8):
        for a, x in sets.items():
            for b, y in sets.items():
                if x and a < b and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    root[a] = root[b] = min(root[a], root[b])
    docs = [(i, t) for i, t in docs if root[i] == i]
    grams = lambda t, n: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)}
    bad = [(k, grams(t, k)) for _, t in items if t and (k := min(5, len(words(t))))]
    docs = [(i, t) for i, t in docs if not any(len(s & grams(t, n)) >= 0.8 * len(s) for n, s in bad)]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = coder.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_matches_brute_force(spark):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == brute_force()


def test_stages_take_messy_documents(spark, documents, tmp_path):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.mode("overwrite").parquet(f"{tmp_path}/out")
        docs = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/out").collect(), docs.schema)
    texts = [r.text for r in docs.collect()]
    assert all(texts) and len({re.sub(r"\s", "", t) for t in texts}) == len(texts)


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["score", "lang_pred", "__row", "__row_", "row", "kept", "id", "first", "text_sha256", "__kept", "item", "n_shingles", "best"]
    rows = [(k, f"some plain words of document number {'abcdefgh'[k]} that nobody repeats", "en", "s", 9, *[f"{n}{k}" for n in names]) for k in range(6)] + [(9, None, None, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(rows[:6])
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == 6


def test_contaminated_rows_leave_others_of_their_id(spark):
    """Null and repeated ids: a row goes by its own text, and an item spread over rows isn't in any of them."""
    item = next(t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall() if len(t.split()) >= 20)
    w = item.split()
    rows = [(None, "before it " + item), (None, "a clean text without an id"), (7, item), (7, "a clean text under a repeated id"), (8, " ".join(w[: len(w) // 2 + 2])), (8, " ".join(w[len(w) // 2 - 2 :])), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.text is None or item not in r.text)


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(QUERIES)
