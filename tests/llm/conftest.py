from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Names that the operators use for helper columns.
CLASHING = ("_id", "id", "key", "label", "score", "shard", "component", "bucket", "text_a", "_spans", "_key", "_score", "n_tokens", "law", "rank")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) rows, with columns of clashing names."""

    def make(rows):
        columns = ", ".join(f"`{c}` string" for c in CLASHING)
        full = [(d, t, *["x"] * len(CLASHING)) for d, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {columns}")

    return make
