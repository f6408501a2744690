from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table like ``documents`` from (id, text[, lang, source]) tuples."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:4] or (None, None)), None if r[1] is None else len(r[1])) for r in rows]
        full = [r if len(r) == 5 else (r[0], r[1], r[2], None, r[-1]) for r in full]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
