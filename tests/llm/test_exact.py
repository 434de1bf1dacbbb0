from __future__ import annotations

import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import exact

ROWS = [
    (1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÉTÉ"), (6, "été"), (7, "same  text"), (7, "same text"),
    (8, "x" * 300_000), (9, "X" * 300_000), (None, "alone"), (None, "same text"), (7, "same text"), (10, "alone"),
]


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[lower(t)], len(groups[lower(t)])) for i, t in rows), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_classes(spark, documents, weak):
    digest = (lambda t: F.unhex(F.hex(F.pmod(F.length(t), F.lit(3))))) if weak else exact.sha256
    got = exact.classes(documents(ROWS), digest).select("doc.doc_id", "keep_id", "group_size", "kept", "doc.text").collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == expected(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[lower(r.text)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_dedup_keeps_columns(documents):
    docs = documents(ROWS)
    out = exact.dedup(docs)
    assert out.schema.names == docs.schema.names and out.count() == len({lower(t) for _, t in ROWS})


def test_empty(documents):
    assert exact.dedup(documents([])).count() == 0


def test_state_goes_on(spark):
    feed, checkpoint = session.scratch(spark, "feed"), session.scratch(spark, "state")
    seen = "struct(id, named_struct('file', 'f', 'row', id) AS at) AS seen"
    for start in (0, 5):
        df = spark.range(start, start + 10).selectExpr("id", "unhex(hex(id % 7)) AS digest").selectExpr("digest", seen)
        df.write.mode("append").parquet(feed)
        exact.remember(spark.readStream.schema(df.schema).parquet(feed), checkpoint)
    got = {bytes(r.digest)[0]: (r.seen.id, r.n) for r in exact.remembered(spark, checkpoint).collect()}
    ids = [*range(10), *range(5, 15)]
    assert got == {d: (max(i for i in ids if i % 7 == d), sum(i % 7 == d for i in ids)) for d in range(7)}
