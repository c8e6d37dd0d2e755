import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of documents from (doc_id, text, lang, source), with an extra column of a clashing name."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "x")[:6] for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, count string")

    return make
