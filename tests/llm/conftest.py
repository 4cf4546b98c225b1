import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for results or on the way.
CLASHES = "score kept node term part extra h word row budget found ids region epoch room end n t g comp a b key block trusted bucket label frame start n_tokens held_out host path rule verdict".split()


def make(spark, texts, ids=None, clash=False):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in CLASHES:
            df = df.selectExpr("*", f"'x' as {c}")
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return lambda texts, ids=None, clash=False: make(spark, texts, ids, clash)
