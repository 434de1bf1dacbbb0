from __future__ import annotations

import re

import pytest

from barflow.llm import mixing

ROWS = [(i, "w " * (1 + i % 17), f"s{i % 3}") for i in range(300)] + [
    (1000, None, "s0"), (1001, "", "s1"), (1002, "one two", None), (1002, "one two", None), (None, "a b c", "Ä"),
    (1003, "word " * 50_000, "huge"), (1004, " \t\n", "blank"),
]


def water(totals, weights, share, epochs):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    cap = {s: epochs * totals[s] for s in order}
    fixed, budget = set(), share * sum(totals.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (budget - sum(cap[s] for s in fixed)) / max(1e-9, sum(w[s] for s in free))
        above = [s for s in free if level * w[s] >= cap[s]]
        if not above:
            return {s: cap[s] if s in fixed else level * w[s] for s in order}
        fixed.update(above)


@pytest.mark.parametrize("share", [0.3, 1.5, 5.0])
def test_plan(documents, share, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    docs = documents(ROWS)
    got = mixing.plan(docs, share=share).collect()
    assert len(got) == len(ROWS)
    size = {}
    for _, t, s in ROWS:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(size, mixing.WEIGHTS, share, 2)
    by_id = {r[0]: r[2] for r in ROWS}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert taken[s] == int(want[s] + 0.5)
    again = mixing.plan(docs.repartition(5), share=share).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_repeats_whole_rows(documents):
    docs = documents(ROWS)
    out = mixing.mix(docs).collect()
    texts = {(r[0], r[1]) for r in ROWS}
    assert out and all((r.doc_id, r.text) in texts for r in out)
    assert docs.schema == mixing.mix(docs).schema


def test_empty(documents):
    assert mixing.plan(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0
