import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sid long, shard int, spans string"


def prose(rng, n, words=None):
    words = words or [a + b for a in "ba ko le mi nu pa ri so tu ve".split() for b in "da fe gi lo mu ne ra st wo xy".split()]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids,
    extra columns whose names the operators use inside."""
    rng = random.Random(5)
    base = prose(rng, 300)
    passage = prose(rng, 90)
    near = base.split()
    near[150] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " \n\t ", "a", "a b", "a b c d", "A b  c d", "a b c d e", "12 34 56", "!!!",
        prose(rng, 60) + " " + passage + " " + prose(rng, 50), prose(rng, 40) + "\n" + passage, "x" * 399, "x" * 400, "ab " * 400, "ab " * 400,
        prose(rng, 30_000), "é" * 500, "日本語の文章です " * 60, base + " " + base, "\x00 odd \x1f bytes ▁ here", "one, two\nthree", passage[: len(passage) // 2],
    ]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, 0.5, i, 3, "x") for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((2, prose(rng, 20), "en", None, None, None, None, None, None))  # an id with another text
    rows.append((None, base, None, None, None, None, None, None, None))
    rows.append((None, "some other text", None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
