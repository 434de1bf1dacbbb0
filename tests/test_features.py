from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import targets as T


def bars(spark, n=90, assets=("BTC", "ETH", "GOLD", "OIL"), seed=42, flat=False):
    rng = np.random.default_rng(seed)
    parts = []
    for a in assets:
        c = np.full(n, 50.0) if flat else 100 * np.cumprod(1 + 0.001 + 0.01 * rng.normal(size=n))
        ts = pd.date_range("2026-01-01", periods=n, freq="h")
        parts.append(pd.DataFrame({"asset": a, "ts": ts, "open": 0.999 * c, "high": 1.005 * c, "low": 0.995 * c, "close": c, "volume": 1.0}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def of(df, asset, *cols):
    return df.filter(F.col("asset") == asset).orderBy("ts").select(*cols).toPandas()


def close_to(a, b):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=1e-9, atol=1e-12)


def test_features_against_pandas(spark, mode):
    df = bars(spark)
    out = X.build(df)
    got = of(out, "ETH", "*")
    c = of(df, "ETH", "close")["close"]
    lr = np.log(c / c.shift(1))
    for n in (1, 4, 8, 16):
        close_to(got[f"ret_{n}"], lr.shift(n - 1).rolling(n).sum())
    for n in (4, 8, 16):
        close_to(got[f"mean_{n}"], c.rolling(n).mean())
        close_to(got[f"std_{n}"], c.rolling(n).std())
    close_to(got["mom_16"], c / c.shift(16) - 1)
    close_to(got["vol_20"], lr.rolling(20).std())
    mid, sd = c.rolling(20).mean(), c.rolling(20).std(ddof=0)
    close_to(got["bb_upper"], mid + 2 * sd)
    close_to(got["bb_pct"], (c - mid + 2 * sd) / (4 * sd))
    d = c.diff()
    up, dn = d.where(d > 0, 0.0).fillna(0), (-d.where(d < 0, 0.0)).fillna(0)
    g, l = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (up, dn))
    close_to(got["rsi_14"], np.where(l == 0, 100.0, 100 - 100 / (1 + g / l)) + 0 * g)
    fast, slow = (c.ewm(span=n, adjust=False, min_periods=n).mean() for n in (12, 26))
    close_to(got["macd"], fast - slow)
    close_to(got["macd_signal"], (fast - slow).ewm(span=9, adjust=False, min_periods=9).mean())
    btc = of(df, "BTC", "close")["close"]
    close_to(got["btc_ret_lag_4"], np.log(btc / btc.shift(1)).shift(4))
    assert got["oil_vol_lag_1"].isna().all()
    assert of(out, "GOLD", "oil_vol_lag_1")["oil_vol_lag_1"].notna().sum() == 90 - 21
    assert out.count() == 4 * 90


def test_no_feature_sees_the_future(spark, mode):
    df = bars(spark, 70)
    cut = "2026-01-03 01:00:00"
    frozen = X.regime_thresholds(I.apply(B.bar_series(df), I.volatility()).frame())
    whole = X.build(df, thresholds=frozen).filter(F.col("ts") <= cut)
    part = X.build(df.filter(F.col("ts") <= cut), thresholds=frozen)
    cols = sorted(whole.columns)
    a, b = (x.select(cols).orderBy("asset", "ts").toPandas() for x in (whole, part))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)


def test_flat_prices(spark, mode):
    got = of(X.build(bars(spark, 60, flat=True)), "BTC", "*")
    assert (got["rsi_14"].dropna() == 100).all()
    assert (got["vol_20"].dropna() == 0).all()
    assert got["bb_pct"].isna().all()
    # p25 = p75 = 0: nothing is below, everything from the 21st bar on is not below p75
    assert got["regime_high_vol"].sum() == 40 and not got["regime_low_vol"].any()


def test_one_bar(spark, mode):
    got = of(X.build(bars(spark, 1)), "BTC", "*")
    assert len(got) == 1 and got["ret_1"].isna().all() and not got["regime_bull"].any()
    assert T.build(bars(spark, 1)).count() == 0


def test_targets(spark, mode):
    df = bars(spark, 60)
    got = T.build(df)
    btc = of(got, "BTC", "*")
    c = of(df, "BTC", "close")["close"]
    close_to(btc["ret_4h"], np.log(c.shift(-4) / c)[:59])
    assert btc["ret_4h"].isna().sum() == 3 and btc["direction_4h"].isna().sum() == 3
    assert btc["norm_ret_1h"].abs().max() <= 5 and btc["vol_target_20"].isna().sum() == 20
    audit = T.audit(df, got).collect()
    assert all(r["passed"] and r["n_compared"] == 59 for r in audit)
    wrong = T.audit(df, got.withColumn("ret_1h", F.col("ret_1h") + 1e-3)).collect()
    assert not any(r["passed"] for r in wrong)


@pytest.mark.parametrize("value,want", [(0.005, 1), (-0.005, -1), (0.001, 0), (0.002 + 1e-6, 1), (-0.002 - 1e-6, -1), (0.002, 0)])
def test_direction_threshold(spark, value, want):
    from barflow.functions.columns import direction

    assert spark.range(1).select(direction(F.lit(value), T.THRESHOLD)).first()[0] == want


def test_reconstruct(spark, mode):
    rows = [("a", "2024-01-01 00:00:00", None, None, None, 10.0), ("a", "2024-01-01 01:00:00", None, 13.0, None, 12.0), ("a", "2024-01-01 02:00:00", 1.0, 2.0, 0.5, 1.5)]
    df = spark.createDataFrame(rows, "asset string, t string, open double, high double, low double, close double").withColumn("ts", F.col("t").cast("timestamp"))
    got = B.reconstruct(B.bar_series(df)).frame().orderBy("ts").select("open", "high", "low", "ohlc_source").collect()
    assert [tuple(r) for r in got] == [(10, 10, 10, "reconstructed"), (10, 13, 10, "reconstructed"), (1, 2, 0.5, "raw")]


def test_quality(spark):
    df = bars(spark, 10, ("BTC",)).withColumns({"open": F.lit(None).cast("double")})
    r = B.quality(df).first()
    assert r["empty_columns"] == "open" and r["warn"] and not r["ok"]
    with pytest.raises(ValueError):
        B.quality(df.drop("volume"))


def test_macro_leak_option(spark, mode):
    df = bars(spark, 30, ("BTC",))
    macro = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2025-12-31", "2026-01-01"]), "dxy": [1.0, 2.0], "vix": [np.nan, 3.0], "spy": [4.0, np.nan]}))
    macro = macro.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("dxy", "vix", "spy")})
    first = of(X.join_macro(df, macro), "BTC", "dxy", "vix", "spy").iloc[0]
    assert (first["dxy"], first["vix"], first["spy"]) == (2.0, 3.0, 4.0)
    late = of(X.join_macro(df, macro, availability_lag="1 day"), "BTC", "dxy")["dxy"]
    assert late[:24].eq(1).all() and late[24:].eq(2).all()


def test_the_matrix_reads_its_input_a_few_times(spark, mode):
    out = X.build(bars(spark, 30))
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() <= 6
