import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id long, key string, fp long, size long, score double, start int"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, further columns with names the operators use."""
    texts = [None, "", "   \n\t", "one", "a b c", LONG, "same text " * 30, "same text " * 30, "the end. mail a@b.co or +1 (212) 555-0000\n\nthe end.", "12 34", "\x1c\x85　", "x" * 5000]
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t or ""), k, "k", k, 1, 0.5, 2) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[6], (None, "null id text", None, None, None, None, None, None, None, None, None), (None,) * 11]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
