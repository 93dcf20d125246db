import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, key string, id long, shard int, batch string, drop int, b int, block int, g int, n int, u int, d int, w string"
EXTRA = (1.5, "fp", "key", 5, 3, "batch", 1, 2, 3, 4, 5, 6, 7, "w")


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts by doc_id: prose of two languages, copies, near copies, repeated lines, and the awkward ones."""
    rng = random.Random(3)
    en = [f"{a}{b}" for a in ("th", "wh", "on", "re", "st") for b in ("e", "at", "ing", "ed", "ion", "er")]
    de = [f"{a}{b}" for a in ("sch", "ü", "ver", "ge", "zu") for b in ("en", "ung", "lich", "keit", "ß", "te")]
    rows = [(i, prose(rng, rng.randint(20, 120), de if i % 3 == 0 else en), "de" if i % 3 == 0 else "en") for i in range(1, 90)]
    base = rows[4][1]
    rows += [(100 + k, base, "en") for k in range(5)]
    rows += [(110, base.replace(base.split()[-1], "zz"), "en"), (111, base.upper(), "en"), (112, base + " extra", "en")]
    line = "This very line stands in many documents."
    rows += [(120 + k, f"own {k}\n  {line.upper() if k % 2 else line}\t\nend {k}", "en") for k in range(4)]
    rows += [(130, None, "en"), (131, "", "en"), (132, " \n\t ", None), (133, "\x1f.", "en"), (134, "no", "en")]
    rows += [(140, prose(rng, 30_000, en), "en"), (141, "x" * 200_000, "en"), (142, f"{line}\n{line}\n" * 3, "en")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, lang, f"s{i % 3}", len(t or ""), *EXTRA) for i, t, lang in corpus]
    rows += [(None, "a text without an id", "en", None, None, *EXTRA), (None, None, None, None, None, *[None] * len(EXTRA))]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="session")
def all_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
