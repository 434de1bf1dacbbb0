from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import evaluation as E
from barflow.operators import modeling as M
from barflow.sources import schemas as SC


def forecasts(spark, n=300, seed=0, scale=0.5):
    rng = np.random.default_rng(seed)
    y = 0.01 * rng.normal(size=n)
    p = scale * y + 0.004 * rng.normal(size=n)
    pdf = pd.DataFrame({"asset": "a", "ts": pd.date_range("2026-01-01", periods=n, freq="h"), E.P: p, E.Y: y})
    return pdf, spark.createDataFrame(pdf)


def score(p, y):
    if len(p) < 2 or p.std() < 1e-12 or y.std() < 1e-12:
        return -1.0
    ratio = p.std() / y.std()
    pen = (0.3 - ratio) / 0.3 if ratio < 0.3 else min(ratio - 1, 1) if ratio > 1 else 0
    zero = np.abs(y).mean()
    return (
        np.corrcoef(p, y)[0, 1] + 0.5 * max(0, (np.sign(p) == np.sign(y)).mean() - 0.5) - 0.5 * pen
        - 2 * max(0, (np.abs(p - y).mean() - zero) / (zero + 1e-10)) - 0.3 * abs(p.mean() - y.mean()) / (y.std() + 1e-10)
    )


@pytest.mark.parametrize("scale", [0.1, 0.5, 3.0])
def test_metrics_and_score(spark, scale):
    pdf, df = forecasts(spark, scale=scale)
    p, y = pdf[E.P].to_numpy(), pdf[E.Y].to_numpy()
    m = E.metrics(df, ["asset"]).first()
    assert m["mae"] == pytest.approx(np.abs(p - y).mean())
    assert m["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["corr"] == pytest.approx(np.corrcoef(p, y)[0, 1])
    assert m["std_ratio"] == pytest.approx(p.std() / y.std())
    assert E.signal_score(df, ["asset"]).first()["signal_score"] == pytest.approx(score(p, y))


def test_constant_predictions(spark, mode):
    _, df = forecasts(spark)
    flat = df.withColumn(E.P, F.lit(0.0))
    m = E.metrics(flat, ["asset"]).first()
    assert m["corr"] == 0 and m["mae"] == pytest.approx(m["zero_mae"]) and m["mae_vs_zero_pct"] == pytest.approx(0, abs=1e-6)
    assert E.signal_score(flat, ["asset"]).first()["signal_score"] == -1
    fit = E.shrinkage(flat, ["asset"]).first()
    assert (fit["slope"], fit["intercept"], fit["shrinkage"]) == (1, 0, 0)
    lag = E.lag_diagnostic(flat, ["asset"]).filter("best").collect()
    assert len(lag) == 1 and lag[0]["lag"] == 0 and lag[0]["corr"] == 0


def test_few_rows_are_not_calibrated(spark):
    _, df = forecasts(spark, n=9)
    assert E.recalibration(df, ["asset"]).first()["identity"]


def test_shrinkage_against_a_loop(spark, mode):
    pdf, df = forecasts(spark, seed=4, scale=2.5)
    p, y = pdf[E.P].to_numpy(), pdf[E.Y].to_numpy()
    a, b = np.polyfit(p, y, 1)
    best = max(
        ((score(p * (a * s + 1 - s) + b * s, y), -s) for s in E.SHRINKAGE if abs(a * s + 1 - s) * p.std() / y.std() >= 0.2)
    )
    fit = E.shrinkage(df, ["asset"]).first()
    assert fit["slope"] == pytest.approx(a) and fit["shrinkage"] == -best[1] and fit["score"] == pytest.approx(best[0])


def test_lag_diagnostic_finds_the_shift(spark, mode):
    pdf, _ = forecasts(spark, n=120)
    pdf[E.P] = pdf[E.Y].shift(3).fillna(0.0)  # the prediction repeats what was three bars ago
    got = E.lag_diagnostic(spark.createDataFrame(pdf), ["asset"]).filter("best").first()
    assert got["lag"] == 3 and got["corr"] == pytest.approx(1, abs=0.05)


def test_macro_f1_counts_present_classes_only(spark):
    rows = [("a", 0.01, 0.01), ("a", 0.01, -0.01), ("a", -0.01, -0.01), ("b", 0.0, 0.01)]
    df = spark.createDataFrame(rows, f"asset string, {E.P} double, {E.Y} double")
    got = {r["asset"]: (r["derived_accuracy"], r["derived_f1_macro"]) for r in E.class_metrics(df, ["asset"]).collect()}
    assert got["a"] == pytest.approx((2 / 3, 2 / 3)) and got["b"] == (0, 0)


def test_moves_need_five_rows(spark):
    df = spark.createDataFrame([("a", 0.001, 0.0015)] * 4 + [("a", 0.001, 0.0008)] * 3, f"asset string, {E.P} double, {E.Y} double")
    assert {r["threshold"]: r["n"] for r in E.meaningful_moves(df, ["asset"]).collect()} == {0.0005: 7}


def test_histogram_keeps_every_row(spark):
    pdf, df = forecasts(spark)
    h = E.residual_histogram(df, ["asset"]).toPandas()
    want = np.histogram(pdf[E.Y] - pdf[E.P], bins=50)[0]
    assert h["n"].sum() == 300 and dict(zip(h["bin"], h["n"])) == {i: n for i, n in enumerate(want) if n}


def test_ridge_closed_form(spark, mode):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 13))
    y = x @ rng.normal(size=13) + 5 + rng.normal(size=400)
    cols = [f"f{i}" for i in range(13)]
    pdf = pd.DataFrame(x, columns=cols).assign(asset=np.where(np.arange(400) % 3 == 0, "b", "a"), y=y)
    model = M.fit_ridge(spark.createDataFrame(pdf), ["asset"], cols, "y")
    for r in model.collect():
        m = (pdf.asset == r["asset"]).to_numpy()
        xc, yc = x[m] - x[m].mean(0), y[m] - y[m].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(13), xc.T @ yc)
        np.testing.assert_allclose(r["coefficients"], w, rtol=1e-8)
        assert r["intercept"] == pytest.approx(y[m].mean() - w @ x[m].mean(0))
    got = M.predict_linear(spark.createDataFrame(pdf), model, ["asset"], cols)
    assert got.filter("prediction is null").count() == 0


def test_impute_and_scale(spark, mode):
    pdf = pd.DataFrame({"asset": list("aaabb"), "x": [1.0, np.nan, 4.0, 7.0, 7.0], "z": [np.nan] * 5})
    df = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in "xz"})
    med = M.fit_median(df, ["asset"], ["x", "z"])
    assert {r["asset"]: (r["x"], r["z"]) for r in med.collect()} == {"a": (2.5, None), "b": (7.0, None)}
    filled = M.impute(df, med, ["asset"], ["x", "z"])
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 2.5, 4.0, 7.0, 7.0]
    scaled = M.scale(df, M.fit_scaler(df, ["asset"], ["x", "z"]), ["asset"], ["x", "z"]).collect()
    assert sorted(round(r["x"], 6) for r in scaled) == [-1.0, 0.0, 0.0, 0.0, 1.0] and all(r["z"] == 0 for r in scaled)
    assert {r["asset"]: r["features"] for r in M.present_features(df, ["asset"], ["x", "z"]).collect()} == {"a": ["x"], "b": ["x"]}


def test_feature_lists():
    assert [len(SC.feature_columns("ETH", m)) for m in ("ridge", "transformer", "rl")] == [13, 26, 27]
    assert len(SC.feature_columns("ETH", "rl", sentiment=True)) == 33
    assert all("btc_gdelt" not in c for c in SC.feature_columns("ETH", "rl", sentiment=True))
    assert SC.observation_width("BTC") == 27 + 3 + 7
    assert len(SC.feature_set(SC.feature_columns("BTC", "transformer"), "price_only")) == 15
    assert SC.feature_set(["a_tone", "vix", "ret_1"], "no_gdelt") == SC.feature_set(["a_tone", "vix", "ret_1"], "technical_macro")
    with pytest.raises(ValueError):
        SC.feature_columns("BTC", "other")


def test_validate_columns():
    assert SC.validate_columns(["a", "b"], ["a", "b"]) == ["a", "b"]
    for found in (["a"], ["a", "b", "c"], ["b", "a"]):
        with pytest.raises(ValueError):
            SC.validate_columns(found, ["a", "b"])
    with pytest.warns(UserWarning):
        assert SC.validate_columns(["b", "a"], ["a", "b"], warn=True) == ["a", "b"]


def _gaps(seed=7, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 1e-3] + [0.0, 1e4, 5.0]
    y = x @ [0.3, -0.02, 40.0] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(const=3.0, void=np.nan, y=y, asset=np.where(rng.random(n) < 0.8, "hot", "cold"))
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    pdf.loc[3, "a"] = np.inf
    return pdf


def _plain_ridge(pdf, features, alpha):
    """Impute, scale and solve with numpy: means, deviations, weights in raw units, intercept."""
    x = pdf[features].replace([np.inf, -np.inf], np.nan)
    x = x.fillna(x.median()).fillna(0.0).to_numpy()
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z, y = (x - mean) / sd, pdf["y"].to_numpy()
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(features)), z.T @ (y - y.mean())) / sd
    return mean, sd, w, y.mean() - w @ mean


def test_ridge_from_sums_against_numpy(spark, mode):
    features = ["a", "b", "c", "const", "void"]
    pdf = _gaps()
    df = spark.createDataFrame(pdf).repartition(5)
    df = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in features})
    medians = M.fit_median(df, ["asset"], features)
    # the infinite value stays in what is added up, and counts as missing
    stats = M.moments(spark.createDataFrame(pdf).repartition(3), ["asset"], [*features, "y"], medians)
    got = {r["asset"]: r for r in M.ridge_of_moments(stats, ["asset"], features, "y", medians, alpha=0.5).collect()}
    for asset, part in pdf.groupby("asset"):
        mean, sd, w, b = _plain_ridge(part, features, 0.5)
        r = got[asset]
        assert r["n"] == len(part)
        np.testing.assert_allclose(r["means"], mean, rtol=1e-9)
        np.testing.assert_allclose(r["deviations"], sd, rtol=1e-7)
        np.testing.assert_allclose(r["coefficients"], w, rtol=1e-6, atol=1e-12)
        assert r["intercept"] == pytest.approx(b, rel=1e-6)


def test_sums_of_parts_add_up(spark):
    pdf = _gaps(seed=8)
    df = spark.createDataFrame(pdf).withColumn("day", F.monotonically_increasing_id() % 7)
    cols = ["a", "c", "y"]
    whole = {r["asset"]: r for r in M.moments(df, ["asset"], cols).collect()}
    daily = M.moments(df, ["asset", "day"], cols)
    assert daily.count() == 14
    for r in M.merge_moments(daily, ["asset"]).collect():
        assert r["n"] == whole[r["asset"]]["n"]
        np.testing.assert_allclose(r["sums"], whole[r["asset"]]["sums"])
        np.testing.assert_allclose(r["products"], whole[r["asset"]]["products"])


def test_sums_of_null_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, 4.0), ("a", None, 5.0)], "asset string, x double, y double")
    got = {r["asset"]: (r["n"], r["sums"], r["products"]) for r in M.moments(df, ["asset"], ["x", "y"]).collect()}
    assert got == {None: (2, [4.0, 6.0], [10.0, 14.0, 14.0, 20.0]), "a": (1, [0.0, 5.0], [0.0, 0.0, 0.0, 25.0])}
    assert M.moments(df.limit(0), ["asset"], ["x"]).count() == 0
    assert M.moments(df, [], ["x", "y"]).first()["n"] == 3
