import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "a"),
    (3, "The Quick Brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", "b"),
    (4, "", "en", "b"),
    (5, None, None, None),
    (6, "one", "en", "a"),
    (7, "zwei Wörter ÄÖÜ", "de", "c"),
    (8, "  \t\n ", "en", "a"),
    (9, "completely different words stand here\nand a second line\nand a second line", "en", "a"),
    (9, "completely different words stand here\nand a second line\nand a second line", "en", "a"),
    (None, "a row without an id has some words too", "en", "a"),
    (12, "word " * 30000, "en", "a"),
]


@pytest.fixture()
def edge_docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")


@pytest.fixture()
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture()
def tmp_table(tmp_path):
    """Write tables as the queries expect them and give their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
