import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "n_words string, kept string, component string, rep string, key string, n string, id string, row string, template string, host string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a null id, a repeated row, characters beyond ASCII, a long text, and clashing columns."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, " \t\n ", "fr", "a", 4),
        (5, "é", "fr", None, 1),
        (6, long, "en", "b", len(long)),
        (6, long, "en", "b", len(long)),
        (None, "a text without an id but with words", "en", "b", 3),
        (7, "123 456 !!! --- 789", None, "b", 5),
        (8, None, None, None, None),
        (9, "İ ΑΣ 漢字 😀 <|endoftext|> don't", "xx", "b", 9),
    ]
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{DOCS}, {CLASH}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
