from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from barflow.llm import decision_list as D

TEXTS = [
    None, "", " \t\n", "one", "a b c d e", "a b c d e f a b c d e", "x y " * 40, "same line\nsame line\n\n  \nsame line",
    "## a $5 & b|c <d>", "Été à la plage\x0b\x0cnice", "tick tock one", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "long " * 30_000,
    " ".join(f"w{i}" for i in range(20_000)), "This This This and and and " * 3, "a a a a a a a b", "p q r s t z p q r s t p q r s t",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts(spark, documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again")])
    got = D.judge(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(got) == len(TEXTS) + 2
    by = {(r.doc_id, r.n_words): r for r in got}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        r = by[(i, want[0])]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, t and t[:40]
        assert r.kept is (not want[5]) and r.reason is None


@pytest.fixture(scope="module")
def labelled(spark):
    good = [(i, " ".join(f"clean{(i * 7 + k) % 83}x" for k in range(20 + i % 30)), 1) for i in range(400)]
    bad = [(1000 + i, " ".join(f"{'#$%'[k % 3]}{(i + k) % 71}" for k in range(15 + i % 9)), 0) for i in range(90)]
    loud = [(2000 + i, " ".join(f"WORD{(i + k) % 67}!!" for k in range(15 + i % 9)), 0) for i in range(90)]
    rows = good + bad + loud
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _ in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (5000, 0), (7, None)], "doc_id bigint, quality int"), rows


def test_learned_rules(labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in D.judge(docs, labels).collect()}
    assert all(got[i].kept == bool(q) for i, _, q in rows)
    assert any("mark_share" in (r.reason or "") or "upper_share" in (r.reason or "") for r in got.values())
    kept = D.accept(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, q in rows if q}


def test_rules_are_one_ordered_expression(spark):
    rules = [(D.Condition("a", True, 1.0), D.Condition("b", False, 2.0)), (D.Condition("a", True, 0.0),)]
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(D.verdict(rules)).collect()] == ["a > 1 and b <= 2", "a > 0", None]


def test_no_labels_of_one_class_and_no_rows(spark, labelled, documents):
    docs, labels, _ = labelled
    ones = labels.filter("quality = 1")
    assert D.judge(docs, ones).filter(F.col("reason").isNotNull()).count() == 0
    assert D.judge(documents([]), labels).count() == 0 and D.accept(documents([]), labels).count() == 0
