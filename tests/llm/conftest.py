import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
#: Nulls in any column, empty and very long texts, repeated rows and ids.
EDGE = [
    (1, "plain words of a short text here", "en", "a"),
    (1, "plain words of a short text here", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t \n", "de", None),
    (5, LONG, "fr", "a"),
    (None, "a text without an id of its own, " * 12, "es", "c"),
    (6, "ünïcödé 日本 🙂 \x00 \x1c tail 'tis it's <|endoftext|>", "xx", "c"),
    (7, "one", "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Odd documents, with extra columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), 9, "x", True, 1.0, "y") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int, id string, kept boolean, score double, component string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}
