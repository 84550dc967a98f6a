import glob
import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "long words and more of them in a row " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [
        (1, "One short line here.", "en", "a", 20),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, LONG, "en", "a", len(LONG)),
        (1, "One short line here.", "en", "a", 20),
        (None, "no key, mail x@y.example.com\nand a line\nand a line", None, "b", 5),
        (None, None, None, None, None),
        (5, "  \n\t ", "de", "b", 5),
        (6, "One short line here.", "en", "a", 20),
        (7, "Ünïcödé Straße ΣΑΣ 日本 \U0001f600 <|endoftext|> a\x0bb\x0cc\x1cd e", "fr", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for clash in ("kept", "score", "n_tokens", "fp", "component_id", "fact", "bucket", "label", "key", "u", "v", "_row", "piece", "spot"):
        docs = docs.selectExpr("*", f"'clash' as `{clash}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


@pytest.fixture(scope="session")
def sf_dir():
    assert glob.glob(f"{SF_DIR}/documents.parquet")
    return SF_DIR
