"""Windows cut in Python against windows built one by one."""

from __future__ import annotations

import numpy as np
import pytest

from barflow.operators import modeling as M

SHAPE = "asset string, at long, other long, x double, y double"


def model(windows):
    """Uses every step and feature, and their order."""
    return (np.nan_to_num(windows) * np.arange(1, windows.shape[1] + 1)[:, None] * [1.0, 10.0]).sum((1, 2))


@pytest.mark.parametrize("block_rows", [3, 10, 1000])
def test_every_window_once(spark, mode, block_rows):
    rng = np.random.default_rng(1)
    rows = []
    for asset, n in (("a", 57), (None, 11), ("short", 4)):
        rows += [(asset, i, None if i % 3 else (1 << 60) + i, None if i == 6 else float(rng.normal()), float(rng.normal())) for i in range(n)]
    rng.shuffle(rows)
    rows = [(r[0], int(r[1]), None if r[2] is None else int(r[2]), r[3], r[4]) for r in rows]
    df = spark.createDataFrame(rows, SHAPE)
    got = {(r.asset, r["at"]): (r.other, r.score) for r in M.score_series(df, ["asset"], ["at"], ["x", "y"], lambda: lambda w: (np.nan_to_num(w) * np.arange(1, w.shape[1] + 1)[:, None] * [1.0, 10.0]).sum((1, 2)), 5, "score", block_rows).collect()}
    want = {}
    for asset in ("a", None, "short"):
        own = sorted((r for r in rows if r[0] == asset), key=lambda r: r[1])
        for k in range(4, len(own)):
            w = np.array([[[np.nan if v is None else v for v in r[3:]] for r in own[k - 4 : k + 1]]])
            want[asset, own[k][1]] = (own[k][2], float(model(w)[0]))
    assert set(got) == set(want) and len(want) == 53 + 7
    assert {k: got[k][0] for k in want} == {k: want[k][0] for k in want}
    assert {k: got[k][1] for k in want} == pytest.approx({k: want[k][1] for k in want})


def test_empty(spark):
    assert M.score_series(spark.createDataFrame([], SHAPE), ["asset"], ["at"], ["x", "y"], lambda: model).count() == 0
