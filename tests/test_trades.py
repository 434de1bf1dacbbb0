from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import reports as R
from barflow.operators import trades as TR


def test_accounting_identities(spark):
    rng = np.random.default_rng(7)
    n = 200
    pdf = pd.DataFrame(
        {
            "trade_id": range(n), "side": rng.choice(["LONG", "SHORT"], n), "entry_price": rng.uniform(50, 150, n),
            "exit_price": rng.uniform(50, 150, n), "position_fraction": rng.choice([0.25, 0.5, 1.0], n),
            "leverage_used": rng.choice([1.0, 1.5, 2.0], n), "portfolio_value_before": rng.uniform(5e3, 2e4, n),
            "transaction_cost_total": rng.uniform(0, 20, n),
        }
    )
    got = TR.account(spark.createDataFrame(pdf)).orderBy("trade_id").toPandas()
    sign = np.where(pdf["side"] == "LONG", 1, -1)
    notional = pdf["portfolio_value_before"] * pdf["position_fraction"] * pdf["leverage_used"]
    gross = sign * (pdf["exit_price"] - pdf["entry_price"]) / pdf["entry_price"] * notional
    np.testing.assert_allclose(got["gross_pnl"], gross)
    np.testing.assert_allclose(got["net_pnl"], gross - pdf["transaction_cost_total"])
    np.testing.assert_allclose(got["portfolio_value_after"], pdf["portfolio_value_before"] + got["net_pnl"])
    np.testing.assert_allclose(got["return_pct"], got["net_pnl"] / notional)
    assert TR.sign_errors(TR.account(spark.createDataFrame(pdf))).count() == 0


def bars(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 * np.cumprod(1 + 0.01 * rng.normal(size=n))
    pdf = pd.DataFrame({"asset": "BTC", "ts": pd.date_range("2026-01-01", periods=n, freq="h"), "high": c * 1.006, "low": c * 0.994, "close": c})
    return pdf, spark.createDataFrame(pdf)


def test_first_touch_against_a_loop(spark, mode):
    pdf, df = bars(spark)
    e = pdf.iloc[::3][["asset", "ts", "close"]].copy()
    e["side"] = np.where(np.arange(len(e)) % 2 == 0, 1, -1)
    e["sl_price"] = e["close"] * (1 - 0.02 * e["side"])
    e["tp_price"] = e["close"] * (1 + 0.03 * e["side"])
    got = TR.first_touch(df, spark.createDataFrame(e.drop(columns="close")), max_hold=12).orderBy("entry_time").collect()
    for row, entry in zip(got, e.itertuples()):
        i = pdf.index[pdf.ts == entry.ts][0]
        want = (None, None)
        for k, b in enumerate(pdf.iloc[i + 1 : i + 13].itertuples(), 1):
            stop = b.low <= entry.sl_price if entry.side > 0 else b.high >= entry.sl_price
            take = b.high >= entry.tp_price if entry.side > 0 else b.low <= entry.tp_price
            want = (k, "SL" if stop else "TP" if take else "MAX_HOLD" if k == 12 else "END")
            if stop or take:
                break
        assert (row["holding_bars"], row["exit_reason"]) == want


def test_stop_wins_a_bar_touching_both(spark):
    _, df = bars(spark, 3)
    e = df.orderBy("ts").limit(1).select("asset", "ts", F.lit(1).alias("side"), F.lit(1e9).alias("sl_price"), F.lit(0.0).alias("tp_price"))
    assert TR.first_touch(df, e).first()["exit_reason"] == "SL"


@pytest.mark.parametrize("longest", [1, 5, 149])
def test_path_stats_against_a_loop(spark, mode, longest):
    pdf, df = bars(spark)
    rng = np.random.default_rng(5)
    start = rng.integers(0, 149, 40)
    stop = np.minimum(start + rng.integers(0, longest, 40), 149)
    t = pd.DataFrame({"asset": "BTC", "trade_id": range(40), "side": rng.choice(["LONG", "SHORT"], 40)})
    t["entry_time"], t["exit_time"] = pdf.ts.to_numpy()[start], pdf.ts.to_numpy()[stop]
    t["entry_price"] = pdf.close.to_numpy()[start]
    got = TR.path_stats(spark.createDataFrame(t), df).orderBy("trade_id").toPandas()
    for r, a, b in zip(got.itertuples(), start, stop):
        w = pdf.iloc[a : b + 1]
        moves = (w.close / r.entry_price - 1) * (1 if r.side == "LONG" else -1)
        assert r.holding_bars == b - a
        assert math.isclose(r.high_during_trade, w.high.max()) and math.isclose(r.low_during_trade, w.low.min())
        assert math.isclose(r.max_favorable_excursion, max(moves.max(), 0), abs_tol=1e-12)
        assert math.isclose(r.max_adverse_excursion, min(moves.min(), 0), abs_tol=1e-12)


def test_profit_factor_variants(spark):
    cols = "asset string, net_pnl double, transaction_cost_total double, risk_reward_ratio double, holding_bars int"
    wins = spark.createDataFrame([("a", 5.0, 1.0, 1.5, 3), ("a", 0.0, 1.0, 1.5, 5)], cols)
    inf, null = (TR.summary(wins, ["asset"], zero_loss=z).first() for z in ("inf", "null"))
    assert inf["profit_factor"] == float("inf") and null["profit_factor"] is None and inf["win_rate"] == 0.5
    mixed = TR.summary(wins.union(spark.createDataFrame([("a", -2.0, 1.0, 1.0, 1)], cols)), ["asset"]).first()
    assert mixed["profit_factor"] == 2.5 and mixed["return_pct"] == pytest.approx(0.03)


def test_risk_caps(spark):
    cases = [("BTC", 2, 0.0, 2), ("ETH", 2, 0.01, 1), ("ETH", 2, 0.001, 1), ("GOLD", 1, 0.01, 0), ("OIL", 2, 0.01, 0), ("xau", 2, 0.0, 2)]
    df = spark.createDataFrame(cases, "asset string, risk int, s double, want int")
    assert df.filter(TR.cap_risk(F.col("asset"), F.col("risk"), F.col("s")) != F.col("want")).count() == 0


def test_entry_rules(spark):
    rows = [
        ("BTC", 0.0001, 0.0001, -1.0, 0.0, True, True),  # no threshold
        ("ETH", 0.001, 0.001, 0.01, 0.0, False, False),  # too weak
        ("ETH", 0.003, 0.003, 0.01, 0.0, True, False),
        ("ETH", 0.003, 0.003, -0.01, 0.0, False, False),  # against the trend
        ("ETH", -0.003, 0.003, 0.0, -0.01, False, True),  # flat ret_4: ret_1 decides
        ("OIL", 0.0, 0.0, 0.5, 0.0, True, True),  # no forecast
    ]
    df = spark.createDataFrame(rows, "asset string, predicted_log_return double, signal_strength double, ret_4 double, ret_1 double, l boolean, s boolean")
    assert TR.eligible(df).filter("may_long != l or may_short != s").count() == 0


@pytest.mark.parametrize("name,want", [("HOLD", "Hold"), ("LONG_SMALL", "L-Small"), ("SHORT_LARGE_BALANCED", "S-Large-Bal"), ("A_B_C_D", "A_B_C_D")])
def test_short_label(spark, name, want):
    assert spark.range(1).select(TR.short_label(F.lit(name))).first()[0] == want


def test_reconcile_compares(spark):
    t = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "asset string, net_pnl double")
    p = spark.createDataFrame([("a", 1, 10_000.0), ("a", 2, 10_100.0), ("b", 1, 10_080.0)], "asset string, ts int, portfolio_value double")
    got = {r["asset"]: (r["ok"], round(r["difference"], 6)) for r in TR.reconcile(t, p, ["asset"]).collect()}
    assert got == {"a": (True, 0.0), "b": (False, 30.0)}


def test_return_correlation_fills_gaps(spark, mode):
    idx = pd.date_range("2026-01-01", periods=40, freq="h")
    rng = np.random.default_rng(2)
    wide = pd.DataFrame({a: 100 + np.cumsum(rng.normal(size=40)) for a in "xyz"}, index=idx)
    wide.loc[idx[5:9], "y"] = np.nan
    long = wide.reset_index(names="ts").melt("ts", var_name="asset", value_name="close").dropna()
    got = R.return_correlation(spark.createDataFrame(long), ["x", "y", "z"]).toPandas()
    want = wide.ffill().pct_change(fill_method=None).corr().round(3)
    for r in got.itertuples():
        assert r.corr == pytest.approx(want.loc[r.asset_a, r.asset_b], abs=1e-9)


def test_buy_and_hold_constant(spark):
    df = spark.createDataFrame(pd.DataFrame({"asset": "a", "ts": pd.date_range("2026-01-01", periods=5), "close": 3.0}))
    r = R.buy_and_hold(df).first()
    assert (r["cumulative_return"], r["sharpe_ratio"], r["max_drawdown"]) == (0, 0, 0)
