from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents from (id, text) or (id, text, lang, source); extra columns may follow."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1", len(r[1]) if r[1] is not None else None, *r[4:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return make


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
