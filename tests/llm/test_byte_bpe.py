import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from clausewright.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_matches_the_library(reference):
    rng = random.Random(2)
    alphabet = "abcdeéüñ 漢字😀́\x00\n\t.,'0123456789АБВгде"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, " " * 500, "<|endoftext|>"]
    for text in texts:
        ids = byte_bpe.encode(text, PATH, public_tokenizers.PATTERN)
        assert ids == reference.encode_ordinary(text)
        assert byte_bpe.decode(ids, PATH, public_tokenizers.PATTERN) == text.encode()


def test_appends_and_edits_give_what_encoding_anew_gives(vocabulary):
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice("thealndorin") for _ in range(rng.randint(1, 120))).encode()
        p = byte_bpe.Prefixes(vocabulary, data)
        p.append(b"ing")
        assert p.tokens() == vocabulary.merge(data + b"ing")
        at = rng.randint(0, len(p.data))
        p.edit(at, rng.randint(0, min(4, len(p.data) - at)), b"xthe"[: rng.randint(0, 4)])
        assert p.tokens() == vocabulary.merge(p.data)


def test_an_edit_recomputes_little(vocabulary):
    p = byte_bpe.Prefixes(vocabulary, b"thing" * 400)
    assert p.edit(100, 1, b"x") < 200


def test_round_trip(documents, no_documents, reference):
    got = byte_bpe.round_trip(documents, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for r in documents.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.round_trip(no_documents, PATH, public_tokenizers.PATTERN).collect() == []


def test_encode_column(documents, reference):
    got = byte_bpe.encode_column(documents, PATH, public_tokenizers.PATTERN, keep=("source", "text")).collect()
    assert all(list(r.ids) == reference.encode_ordinary(r.text or "") for r in got)
