from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barflow.llm import ordinal as O

rng = random.Random(6)
PLAIN, RUDE = [f"word{i}" for i in range(300)], ["idiot", "scum", "moron"]


def text(grade):
    words = rng.choices(PLAIN, k=rng.randint(15, 60))
    if grade == 0:
        words += rng.choices(RUDE, k=3)
    if grade == 1:
        words = [w + rng.choice(["##", "%%", "$$"]) for w in words]
    rng.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, text(g), g) for i, g in enumerate(rng.choices((0, 1, 2), weights=(1, 1, 4), k=900))]
    labels = [(i, int(g != 1), int(g == 0)) for i, _, g in rows if i < 600] + [(None, 1, 0), (9999, 0, 0), (3, None, None)]
    extra = [(2000, None, 9), (2001, "", 9), (None, "no id", 9), (2002, "word1 " * 100_000, 9), (2003, "same", 9), (2003, "same", 9)]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x", 3) for i, t, _ in rows + extra], "doc_id bigint, text string, words int, score double, features string, grade int")
    return rows, O.select(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()


def test_held_out_grades(rated):
    rows, got = rated
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    right = [(0 if r.p_above_0 < 0.5 else 1 if r.p_above_1 < 0.5 else 2) == g for i, _, g in rows if i >= 600 for r in [by[i]]]
    assert sum(right) >= 0.97 * len(right)
    means = [sum(by[i].expected for i, _, x in rows if x == g) / sum(x == g for _, _, x in rows) for g in range(3)]
    assert means == sorted(means)


def test_cumulative_link(rated):
    _, got = rated
    gap = {round(math.log(r.p_above_0 / (1 - r.p_above_0)) - math.log(r.p_above_1 / (1 - r.p_above_1)), 3) for r in got if 1e-9 < r.p_above_1 < 1 - 1e-9 and 1e-9 < r.p_above_0 < 1 - 1e-9}
    assert max(gap) - min(gap) < 0.01 and min(gap) > 0  # one score, ordered thresholds
    for r in got:
        assert r.p_above_0 >= r.p_above_1 and r.expected == pytest.approx(r.p_above_0 + r.p_above_1) and r.kept == (r.p_above_1 >= 0.5)
    empty = [r for r in got if r.doc_id in (2000, 2001)]
    assert empty[0].score == empty[1].score == 0.0


def test_nothing_to_learn_from(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = O.select(documents([(1, "a"), (2, None)]), none).collect()
    assert len(got) == 2 and all(r.expected == pytest.approx(1.0) for r in got)
    assert O.select(documents([]), none).count() == 0


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, 1, None), (4, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in O.ratings(labels).collect()} == {1: 1, 2: 0, 3: 2}
