"""Tables of these tests; the session comes from the fixture above this folder."""

import pytest

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small documents table, in id order."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like operators' own."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(1, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "a"), (3, None, None, None), (4, "", "fr", "b"),
            (5, " \t\n ", "fr", None), (6, long_text, "en", "a"), (6, long_text, "en", "a"), (None, "a row without id", "en", "a"), (8, "é" * 30 + "\x00 ▁ 😀 x", "zz-long", "b"),
            (9, "two", "en", "a"), (10, "Two", "en", "a")]
    clash = ("n", "key", "count", "host", "node", "component", "bucket", "s1", "f", "kept")
    return spark.createDataFrame([(*r, *("c" for _ in clash)) for r in rows],
                                 "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash))
