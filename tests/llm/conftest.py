from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, source[, lang]]) as a table in files, with columns that operators might use themselves."""

    def make(rows, *more):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", 0) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        return df.selectExpr("*", "1L AS size", "'x' AS key", "2 AS n", "3 AS digest", "'y' AS node", "4 AS row", "5 AS task", "6 AS seen")

    return make
