from __future__ import annotations

import string
from collections import Counter

import pytest

from barflow.llm import lines

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(texts, least):
    """Texts left, and how many lines went, by one look at all lines."""
    cut = [(t or "").split("\n") for t in texts]
    key = [[x.strip(" \t\n\x0b\x0c\r").translate(LOW) for x in ls] for ls in cut]
    found = Counter(k for ks in key for k in set(ks))
    gone = {k for k, n in found.items() if k and n >= least}
    return [("\n".join(x for x, k in zip(ls, ks) if k not in gone), len(ls), sum(k in gone for k in ks)) for ls, ks in zip(cut, key)]


ROWS = [
    (1, "Menu\nfirst\n\n menu  "), (2, " menu\t\nMENU\nsecond"), (3, "\x0bmenu\x0c\r\n"), (4, None), (5, ""), (None, "MENU\n\n"),
    (6, "É\né\nÉ"), (7, "é"), (7, "é"), (8, "É"), (9, " menu"), (9, " menu"), (10, "\n" * 5), (11, "menu\n" * 30_000 + "end"),
    (12, "\n".join(f"line {k}" for k in range(50_000))), (13, "line 7\nline 9" + "x" * 1_200_000), (14, "first\x00\nfirst"),
]


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_against_one_look_at_all_lines(spark, documents, least):
    got = lines.cleaned(documents(ROWS), least, batches=6).select("doc.doc_id", "doc.text", "kept", "n_lines", "n_dropped").collect()
    want = plain([t for _, t in ROWS], least)
    assert sorted((str(r[0]), r[1] or "", *r[2:]) for r in got) == sorted((str(i), t or "", *w) for (i, t), w in zip(ROWS, want))


@pytest.mark.parametrize("fan, batches", [(2, 9), (3, 4)])
def test_runs_are_compacted_by_level(spark, fan, batches):
    runs = lines.Runs(spark, least=4, fan=fan)
    held = Counter()
    for k in range(batches):
        keys = [x for x in range(12) if x % (k + 1) == 0 or x == 11]
        held.update(keys)
        runs.add(spark.createDataFrame([(x, -x) for x in keys], "a bigint, b bigint"))
        assert all(len(level) < fan for level in runs.levels)
    assert sum(fan**k * len(level) for k, level in enumerate(runs.levels)) == batches
    assert sorted(r.a for r in runs.frequent().collect()) == sorted(x for x, n in held.items() if n >= 4)


def test_other_columns_and_an_empty_table(spark, documents):
    df = documents([(1, "a\nb"), (2, "a"), (3, "A ")])
    out = lines.dedup(df, least=3)
    assert out.columns == df.columns and sorted((r.doc_id, r.text, r.key) for r in out.collect()) == [(1, "b", "x"), (2, "", "x"), (3, "", "x")]
    assert lines.dedup(df.limit(0)).count() == 0
    assert lines.Runs(spark).frequent().count() == 0
