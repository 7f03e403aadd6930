import pytest

from copyledger.llm.common import importable


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


SCHEMA = "text string, doc_id long, n long, key string, band int, lang string, source string, n_chars long, _new int"


@pytest.fixture
def docs(spark):
    """Documents whose other columns bear names that operators use themselves."""

    def make(*rows):
        full = [(text, doc_id, 1, "k", 2, "en", "s", len(text or ""), 3) for doc_id, text in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here"), (None, None), (5, long), (6, "x" * 20_000),
        (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (9, "Ünïcode\x1c — 🙂 <|endoftext|> don't\n\n  end"),
    ]
