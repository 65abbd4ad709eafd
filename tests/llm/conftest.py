import os
import re

import pytest

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def small():
    if not os.path.exists(f"{SMALL}/documents.parquet"):
        pytest.skip("driver test data not present")
    return SMALL


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture
def odd(spark):
    """Null and empty texts, a null id, a repeated row, a long text, and columns with names the operators use."""
    rows = [(1, "Alpha beta gamma delta.", "x", 1), (2, None, None, 2), (3, "", "x", 3), (None, "Alpha beta gamma delta.", "x", 4),
            (4, "Alpha beta gamma delta.", None, 5), (4, "Alpha beta gamma delta.", None, 5), (5, "Äé \U0001f600 ...", "y", 6),
            (6, "word " * 30_000, "y", 7), (7, "!!! 123", "y", 8)]
    return spark.createDataFrame([(i, t, lang, "src", n, "a", "b", 0.5, "c", 9, "d") for i, t, lang, n in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, ids string, fingerprint string, "
                                 "score double, kept string, n int, path string")


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))
