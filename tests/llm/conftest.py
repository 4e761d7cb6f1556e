import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """Make a documents table, with further columns whose names clash, from (doc_id, text) pairs."""

    def make(rows, langs=None):
        langs = langs or [None] * len(rows)
        return spark.createDataFrame([(i, t, lang, None, None, 1, 0.5) for (i, t), lang in zip(rows, langs)], SCHEMA)

    return make
