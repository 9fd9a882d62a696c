import duckdb
import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with odd names."""
    long_text = "wörd one two. " * 9000
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    rows = [
        (1, base * 3, "en", "src0", 3, "x", 1), (2, base * 3, "en", "src0", 3, "y", 2), (2, base * 3, "en", "src0", 3, "y", 2), (3, None, None, None, None, None, None),
        (4, "", "de", "src1", 0, "", 0), (None, base + "extra words here", "fr", "src2", 5, "z", 5), (5, long_text, "en", "src0", len(long_text), "k", 6),
        (6, "  two  spaces\n\nand lines \t tabs ", "es", "src3", 9, "k", 7), (7, "one", "es", "src13", 1, "k", 8), (8, "one", "es", "src13", 1, "k", 9),
        (9, base * 3 + "tail", "en", "src0", 3, "x", 1), (10, "😀 ▁ <s> \x00 ½", "en", "src0", 3, "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n long")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 9)] + [(None, 1, 0), (50, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small_texts(sf_dir):
    return duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in "documents embeddings pages labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c
