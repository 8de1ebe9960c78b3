import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table with extra columns whose names clash."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("kept", "_part", "score", "spans", "_print", "fp", "copies", "size", "piece", "id", "sequence_id", "_norm"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


