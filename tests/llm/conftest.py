import random

import pytest

#: Extra columns with names that the operators use inside.
EXTRA = "row string, id string, n string, class string, digest string, kept string, value string, kind string, h string, root string, item string, salt string, best string, label string, payload string"
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def prose(rng, n, words="the of and to in that is was for on as with by at from her his all one new".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "ing", "ed", "ly", "ness"]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Copies, near copies, shared passages, null and empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(25)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[0], " " + base[0].replace(" ", "\n"), base[0] + "\t", base[1].upper(), base[2] + " extra word"]
    for k in range(6):
        w = base[3].split()
        w[rng.randrange(len(w))] = f"changed{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(3)]
    texts += ["For " * 200, "", "   ", None, None, "one two three four", "one two three four", "é" * 3000, prose(rng, 9000), "日本語 テスト 😀", "12345 %%% !!!"]
    rows = [(k, t, "en", "s", 0 if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text under a known id", None, None, None), (None, base[6], "en", None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, *["x"] * 15) for r in rows], DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DDL)
