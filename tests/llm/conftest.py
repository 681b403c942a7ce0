from __future__ import annotations

import random

import pytest

#: Columns that clash with names used inside the operators.
EXTRA = "one string, two long, row int, runs string, _block int, key int, bits long, node int, label int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 2, "y", 3, 4, 5, 6, 7)


def messy_rows():
    """Nulls everywhere, empty and long texts, repeated rows, ties of ids, other scripts."""
    r = random.Random(7)
    words = "der die das und nicht the and of with straße naïve 日本 x1 it's we'll ,. --- don't so".split(" ")

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage = prose(90)
    long = "\n".join(prose(40) for _ in range(300))
    rows = [
        row(0, prose(30)),
        row(1, None),
        row(2, ""),
        row(3, "   \n\t "),
        row(4, "a"),
        row(5, long, None),
        row(6, prose(20) + passage + prose(10)),
        row(7, passage + "\n" + prose(50), "de", None),
        row(8, "ab" * 700),
        row(9, "123 456 --- !!!", None, None),
        row(10, "é́ Σίσυφος İstanbul ﬁ\x85x　y  z \n\n w\r\n"),
        row(None, prose(25), "fr"),
        row(None, None, None, None),
        row(11, prose(30)),
        row(11, prose(30)),
        row(100, "word " * 500),
    ]
    near = prose(200)
    rows += [row(200 + i, near + " end" + "." * i) for i in range(4)]
    rows += [rows[0], rows[6], rows[1]]
    return rows + [row(300 + i, prose(r.randrange(1, 120)), r.choice(["en", "de", "fr", "es", None])) for i in range(40)]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows):
    return [(r[0], r[1] or "") for r in rows]


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
