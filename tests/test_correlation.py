"""Correlations by blocks against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barflow.operators import correlation as C

SHAPE = "asset string, ts timestamp, close double"


def frame(spark, wide):
    long = wide.reset_index(names="ts").melt("ts", var_name="asset", value_name="close").dropna()
    return spark.createDataFrame(long[["asset", "ts", "close"]])


def wide_prices(n_times, n_assets, seed=3):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(n_times, 1))
    moves = 0.01 * (common * rng.normal(size=n_assets) + rng.normal(size=(n_times, n_assets)))
    return pd.DataFrame(100 * np.exp(moves.cumsum(0)), columns=[f"a{i:04d}" for i in range(n_assets)], index=pd.date_range("2026-01-01", periods=n_times, freq="h"))


def check(got, want):
    got = got.toPandas()
    assert len(got) == want.size
    wanted = want.stack(future_stack=True)
    mine = got.set_index(["asset_a", "asset_b"])["corr"].reindex(wanted.index)
    # a rounded value may fall on either side
    np.testing.assert_allclose(mine.to_numpy(float), wanted.to_numpy(), atol=0.00051, equal_nan=True)
    assert (np.abs(mine.to_numpy(float) - wanted.round(3).to_numpy()) > 1e-9).sum() <= 2


@pytest.mark.parametrize("fill", [True, False])
def test_gaps_over_several_blocks_and_slices(spark, mode, fill):
    wide = wide_prices(90, 70)
    rng = np.random.default_rng(4)
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide.iloc[:50, 5] = np.nan  # comes late
    wide.iloc[1:, 6] = np.nan  # one price only
    wide.iloc[:, 7] = 100.0  # never moves
    moved = (wide.ffill() if fill else wide).pct_change(fill_method=None)
    check(C.correlations(frame(spark, wide), fill=fill, slice_times=16), moved.corr())


def test_two_thousand_assets_with_the_plan_of_two(spark):
    small, large = wide_prices(40, 2), wide_prices(40, 2000)

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString().count("\n")

    got = C.correlations(frame(spark, large))
    assert plan(got) == plan(C.correlations(frame(spark, small)))
    sample = got.filter("asset_a like 'a1%7' and asset_b like 'a0%3'").toPandas()
    assert got.count() == 4_000_000 and len(sample) == 10_000
    want = large.pct_change(fill_method=None).corr()
    for r in sample.sample(300, random_state=1).itertuples():
        assert r.corr == pytest.approx(want.loc[r.asset_a, r.asset_b], abs=0.00051)


def test_nulls_ties_zeros_and_nothing(spark):
    at = pd.date_range("2026-01-01", periods=4, freq="h")
    rows = [(a, t.to_pydatetime(), p) for a, prices in ((None, [1.0, 2.0, 3.0, 5.0]), ("z", [1.0, 0.0, 4.0, 2.0])) for t, p in zip(at, prices)]
    rows += [("z", at[0].to_pydatetime(), 3.0), ("z", None, 9.0), ("z", at[1].to_pydatetime(), None)]
    got = {(r.asset_a, r.asset_b): r["corr"] for r in C.correlations(spark.createDataFrame(rows, SHAPE)).collect()}
    # z at the first time is 2; its change from 0 is missing, so the two meet twice
    assert got == {(None, None): 1.0, (None, "z"): -1.0, ("z", None): -1.0, ("z", "z"): 1.0}
    assert C.correlations(spark.createDataFrame([], SHAPE)).count() == 0
