import random

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture
def messy(spark):
    """Nulls, empty and repeated rows, a long text, ties and columns with names that operators use themselves."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(60000))
    rows = [(1, "a b c", "en", "src0", 5), (1, "a b c", "en", "src0", 5), (1, "other text", "en", "src1", 5), (2, "", "fr", None, None), (3, None, None, "src2", 1), (None, "no id", "en", "x", 2), (None, None, None, None, None), (4, long, "en", "src0", 9), (5, "\n\n \t", "de", "src0", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS key", "2 AS at", "'z' AS tie", "3 AS h", "4 AS tokens", "5 AS row", "6 AS runs", "7 AS kept_key")
