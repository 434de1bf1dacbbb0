"""Phrase dictionaries of any size: the literal plan and the automaton give the same rows."""

from __future__ import annotations

import random

import pytest

from barflow.operators import news as N


def plain(rows, phrases):
    best = {}
    for url, text in rows:
        for asset, ps in phrases.items():
            for i, p in enumerate(ps):
                if text is not None and p.lower() in text.lower():
                    best[url, asset] = min(best.get((url, asset), (i, p)), (i, p))
                    break
    return sorted(((u, a, p) for (u, a), (_, p) in best.items()), key=str)


def table(seed):
    r = random.Random(seed)
    parts = ["oil", "Boil", "crude oil", "OPEC", "gold", "goldman", "fed", "été", "ÉTÉ", "x", ""]
    rows = [(f"u{r.randrange(60)}" if r.random() < 0.95 else None, " ".join(r.choices(parts, k=r.randrange(0, 8)))) for _ in range(300)]
    phrases = {"OIL": ["crude oil", "oil", "opec"], "GOLD": ["Gold", "été"], "NONE": ["absent"], "ANY": ["opec", "x"], "DUP": ["fed", "fed", "goldman"]}
    return [*rows, ("u1", None), ("u2", "z" * 200_000 + "crude OIL")], phrases


@pytest.mark.parametrize("limits", [(1_000, 200_000), (0, 200_000), (0, 3)])
def test_every_form_against_a_loop(spark, monkeypatch, limits):
    rows, phrases = table(3)
    monkeypatch.setattr(N, "LITERAL_PHRASES", limits[0])
    monkeypatch.setattr(N, "PHRASES_PER_PASS", limits[1])
    got = N.tag_by_phrase(spark.createDataFrame(rows, "url string, title string"), phrases).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, phrases)


def test_a_hundred_thousand_phrases(spark):
    phrases = {"A": [f"name {k} corp" for k in range(60_000)], "B": [f"item{k};" for k in range(40_000)]}
    rows = [(f"u{k}", f"News of Name {k * 7} Corp and item{k}; or item{k + 1};") for k in range(2_000)]
    got = {(r["url"], r["asset"]): r["query"] for r in N.tag_by_phrase(spark.createDataFrame(rows, "url string, title string"), phrases).collect()}
    assert got == {(f"u{k}", "A"): f"name {k * 7} corp" for k in range(2_000)} | {(f"u{k}", "B"): f"item{k};" for k in range(2_000)}


def test_coverage_sketches_merge_within_their_error(spark):
    from pyspark.sql import functions as F

    df = spark.range(60_000).selectExpr(
        "concat('a', id % 2) AS asset", "timestamp_seconds(1704067200 + id * 20) AS timestamp_utc", "CAST(IF(id % 3 = 0, NULL, 1) AS INT) AS sentiment_score",
        "concat('d', id % 40000) AS domain", "concat('c', id % 9) AS sourcecountry",
    )
    days = N.coverage_sketches(df)
    assert days.count() == 2 * df.select(F.to_date("timestamp_utc")).distinct().count()
    exact = {r["asset"]: r for r in N.coverage(df).collect()}
    for r in N.coverage_estimate(days).collect():
        e = exact[r["asset"]]
        assert (r["total"], r["with_sentiment"], r["sourcecountry_estimate"]) == (e["total"], e["with_sentiment"], e["countries"])
        assert abs(r["domain_estimate"] / e["domains"] - 1) < 0.05
    assert N.coverage_estimate(days.limit(0)).count() == 0
