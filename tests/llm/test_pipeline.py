"""The stages on the smallest tables, each against a plain version of its work on its own input."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from barflow import session
from barflow.llm import mixing, packing, queries
from test_decision_list import brute as counts_of
from test_exact import lower
from test_mixing import water
from test_order_minhash import brute as near_classes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(session.settle(stage(spark, out[-1], SF), "stage"))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns_stay(outputs):
    _, columns = outputs
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_rules(outputs):
    before, after = outputs[0][:2]
    kept = {r["doc_id"] for r in after}
    assert kept <= {r["doc_id"] for r in before if not counts_of(r["text"])[5]} and len(kept) > 0.7 * len(before)


def test_exact_dedup(outputs):
    before, after = outputs[0][1:3]
    best = {}
    for r in before:
        best[lower(r["text"])] = max(r["doc_id"], best.get(lower(r["text"]), -1))
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())


def test_near_dedup(outputs):
    before, after = outputs[0][2:4]
    rows = sorted(before, key=lambda r: r["doc_id"])
    classes = near_classes([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in after) == [rows[i]["doc_id"] for i in sorted(set(classes))]


def test_source_mix(outputs):
    before, after = outputs[0][3:5]
    size = {r["doc_id"]: counts_of(r["text"])[0] for r in before}
    totals, longest, taken = Counter(), defaultdict(int), Counter()
    for r in before:
        totals[r["source"]] += size[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    for s, want in water(totals, mixing.WEIGHTS, 1.5, 2).items():
        assert abs(taken[s] - want) <= longest[s] / 2 + 1
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_mixture_packing(outputs):
    before, after = outputs[0][4:]
    encoder = packing.Encoder(queries.tokenizer())
    tokens = sum(len(encoder.encode([r["text"] or ""])[0]) // 4 + 1 for r in before)
    assert sum(r["length"] for r in after) == tokens == sum(len(r["ids"]) // 4 for r in after)
    ends = Counter()
    for r in after:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.WINDOW and len(ends) <= tokens / packing.WINDOW + 2
