import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, body string, shard int, g string, part int, block long, score double, lang_pred string, `a.b` int"


def rows(pairs):
    """(doc_id, text, lang) with extra columns whose names the operators use inside."""
    return [(i, t, lang, None, None, 1, 1, "x", 1, "y", 1, 1, 0.5, "zz", 1) for i, t, lang in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    long = " ".join(f"word{k % 977}. Zażółć" for k in range(30_000))
    base = [(1, None, None), (2, "", "en"), (3, "  \t\n ", "en"), (4, "Hello,  world. The end of it", "en"), (5, "Hello, world. The end of it", None), (None, "Hello, world. The end of it", "en"), (6, long, "fr"), (7, long, "fr"), (7, long, "fr"), (8, "one", "en"), (9, "12 34 !!", "de"), (10, "é́ <|endoftext|> 'S don't", "fr"), (None, None, None)]
    return spark.createDataFrame(rows(base), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
