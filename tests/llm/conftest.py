import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
for place in (ROOT, ROOT / "tests"):
    if str(place) not in sys.path:
        sys.path.insert(0, str(place))

LETTERS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [(r + (None,) * 4)[:4] + (len(r[1]) if r[1] is not None else None,) for r in map(tuple, rows)]
        return spark.createDataFrame(full, LETTERS)

    return make
