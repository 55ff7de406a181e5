"""Documents with everything that may go wrong in them."""

import pytest

#: columns whose names the operators use inside
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, key int, t int, h int, copies int, node long, score double"
_REST = ("r", 1, 2, 3, 4, 5, 6, 0.5)


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *_REST)


@pytest.fixture(scope="session")
def edge_docs(spark):
    long_text = " ".join(f"word{i % 97}x{i % 31}" for i in range(60_000))
    rows = [
        document(1, None), document(2, ""), document(None, "some words without an id"), document(None, None, None, None), document(3, "  \n\t "), document(4, long_text), document(4, long_text),
        document(5, "The same row twice."), document(5, "The same row twice."), document(6, "É ü 日本語 \x1c\x00", None, "b"), document(7, "tie tie tie"), document(8, "tie tie tie"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
