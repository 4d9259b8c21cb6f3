import pytest

#: Columns with names that operators use inside, or that other tables have.
CLASHES = "fp string, key_a int, rank string, h int, s string, t int, _row int, kept string, size string, node int, cell string, place string, line string, source_size string, _id int, _text int, _none int, _h int, _above string, n_words string, component_id string"
LONG = "long " * 30_000 + "\n" + "x" * 50_000
ROWS = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n ", "en", "a", 4), (None, "words of a null id " * 20, "en", None, 7), (None, "words of a null id " * 20, "en", None, 7),
    (5, "same text here", "en", "a", 14), (5, "same text here", "en", "a", 14), (6, "same text here", "de", "b", 14), (7, LONG, "en", "b", len(LONG)), (8, "é Σ 中文 \U0001F600 ##\nline\nline\n", "fr", "c", 20),
    (9, "a b c d e f g " * 40, None, "a", 9), (10, "Header line\n" + " ".join(f"w{k}" for k in range(80)), "en", "a", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, long and repeated texts, and columns of clashing names."""
    n = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *[None] * n) for r in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture
def as_table(tmp_path):
    """Write a DataFrame as the documents table that SQL reads."""

    def write(df):
        path = str(tmp_path / "documents")
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path)
        return {"documents": f"{path}/*.parquet"}

    return write
