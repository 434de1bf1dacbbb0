"""Forecast evaluation: metrics, baselines, calibration, diagnostics.

Every report is one grouped pass of aggregates that combine before the shuffle.
Grids (thresholds, shrinkage levels, lags) are columns of that pass, so rows are
never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.columns import clip, correlation, direction, rolling, safe_ratio
from barflow.operators.series import arrange, lookup
from barflow.operators.targets import THRESHOLD
from barflow.operators.windows import dedup

# Fixed values.
MOVES = (0.0005, 0.001, 0.002)
SHRINKAGE = (0.0, 0.1, 0.2, 0.5, 0.8, 1.0)
MIN_STD_RATIO = 0.2
TINY = 1e-12
EPS = 1e-10

P, Y = "predicted_log_return", "actual_log_return"


def derived(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Signal strength, directions, residual and absolute error."""
    p, y = F.col(P), F.col(Y)
    return df.withColumns(
        {
            "signal_strength": F.abs(p),
            "predicted_direction": direction(p, threshold),
            "actual_direction": direction(y, threshold),
            "regression_error": p - y,
            "abs_error": F.abs(p - y),
        }
    )


def basis_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_bps": F.col(c) * 10000 for c in cols})


def denormalise(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = ("asset",), scaled: str = "predicted_scaled", vol: str = "vol") -> DataFrame:
    """Scaled prediction -> normalised return (times std plus mean) -> log return (times vol)."""
    out = lookup(df, scaler.select(*keys, F.col("mean").alias("_m"), F.col("std").alias("_s")), list(keys))
    return (
        out.withColumn("predicted_norm_return", F.col(scaled) * F.col("_s") + F.col("_m"))
        .withColumn(P, F.col("predicted_norm_return") * F.col(vol))
        .drop("_m", "_s")
    )


def next_price(close: Column, predicted: Column) -> Column:
    """Price implied by a predicted log return; no prediction keeps the price."""
    return close * F.exp(F.coalesce(predicted, F.lit(0.0)))


def agent_inputs(df: DataFrame) -> DataFrame:
    """Forecast columns clipped to 0.05 and scaled for the agent; NULL becomes 0."""
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "in_return": F.coalesce(clip(F.col(P), -0.05, 0.05) / 0.05, zero),
            "in_strength": F.coalesce(clip(F.col("signal_strength"), 0.0, 0.05) / 0.05, zero),
            "in_direction": F.coalesce(F.col("predicted_direction").cast("double"), zero),
        }
    )


def _corr(p: Column, y: Column) -> Column:
    """Pearson correlation, 0 where either side is constant."""
    c = correlation(p, y)
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def _r2(p: Column, y: Column) -> Column:
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - F.sum((y - p) ** 2) / total).otherwise(F.lit(0.0))


def _hits(p: Column, y: Column) -> Column:
    return F.avg(F.when(F.signum(p) == F.signum(y), 1.0).otherwise(0.0))


def metrics(df: DataFrame, keys: Sequence[str], p: str = P, y: str = Y) -> DataFrame:
    """Regression metrics per key, with the zero-return baseline."""
    df = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(p), F.col(y)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(a - b)).alias("mae"),
        F.sqrt(F.avg((a - b) ** 2)).alias("rmse"),
        _r2(a, b).alias("r2"),
        _corr(a, b).alias("corr"),
        _hits(a, b).alias("dir_acc"),
        F.stddev_pop(a).alias("pred_std"),
        F.stddev_pop(b).alias("actual_std"),
        F.avg(a).alias("pred_mean"),
        F.avg(b).alias("actual_mean"),
        F.min(a).alias("pred_min"),
        F.max(a).alias("pred_max"),
        F.min(b).alias("actual_min"),
        F.max(b).alias("actual_max"),
        F.avg(F.abs(b)).alias("zero_mae"),
        F.sqrt(F.avg(b**2)).alias("zero_rmse"),
    )
    return out.withColumns(
        {
            "std_ratio": safe_ratio(F.col("pred_std"), F.col("actual_std")),
            "mae_vs_zero_pct": (F.col("zero_mae") - F.col("mae")) / (F.col("zero_mae") + EPS) * 100,
            "rmse_vs_zero_pct": (F.col("zero_rmse") - F.col("rmse")) / (F.col("zero_rmse") + EPS) * 100,
        }
    )


def class_metrics(df: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, p: str = P, y: str = Y) -> DataFrame:
    """Accuracy and macro-F1 of the three derived directions.

    A class found on neither side does not enter the mean; one without a true
    positive scores 0.
    """
    df = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    a, b = direction(F.col(p), threshold), direction(F.col(y), threshold)
    cells = []
    for c, n in ((-1, "dn"), (0, "fl"), (1, "up")):
        cells += [
            F.count_if((a == c) & (b == c)).alias(f"_tp_{n}"),
            (F.count_if(a == c) + F.count_if(b == c)).alias(f"_any_{n}"),
        ]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((a == b).cast("double")).alias("derived_accuracy"), *cells)
    total = sum((F.coalesce(F.try_divide(2.0 * F.col(f"_tp_{n}"), F.col(f"_any_{n}")), F.lit(0.0)) for n in ("dn", "fl", "up")), F.lit(0.0))
    present = sum(((F.col(f"_any_{n}") > 0).cast("int") for n in ("dn", "fl", "up")), F.lit(0))
    return out.select(*keys, "n", "derived_accuracy", (total / present).alias("derived_f1_macro"))


def baselines(df: DataFrame, train: DataFrame, keys: Sequence[str], y: str = Y) -> DataFrame:
    """Errors of predicting zero and of predicting the training mean."""
    mean = train.groupBy(*keys).agg(F.avg(y).alias("train_mean"))
    out = lookup(df.filter(F.col(y).isNotNull()), mean, list(keys))
    b, m = F.col(y), F.col("train_mean")
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.first(m).alias("train_mean"),
        F.avg(F.abs(b)).alias("zero_mae"),
        F.sqrt(F.avg(b**2)).alias("zero_rmse"),
        _r2(F.lit(0.0), b).alias("zero_r2"),
        F.avg(F.abs(b - m)).alias("mean_mae"),
        F.sqrt(F.avg((b - m) ** 2)).alias("mean_rmse"),
        _r2(m, b).alias("mean_r2"),
    )


def meaningful_moves(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = MOVES, p: str = P, y: str = Y) -> DataFrame:
    """Metrics over rows whose actual move exceeds each threshold; fewer than 5 rows give none."""
    df = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    aggs, parts = [], []
    for i, t in enumerate(thresholds):
        big = F.abs(F.col(y)) > F.lit(float(t))
        a, b = F.when(big, F.col(p)), F.when(big, F.col(y))
        hit = F.when(big, F.when(F.signum(a) == F.signum(b), 1.0).otherwise(0.0))
        cells = {
            "n": F.count(b),
            "mae": F.avg(F.abs(a - b)),
            "rmse": F.sqrt(F.avg((a - b) ** 2)),
            "corr": _corr(a, b),
            "dir_acc": F.avg(hit),
            "std_ratio": safe_ratio(F.stddev_pop(a), F.stddev_pop(b)),
        }
        aggs += [c.alias(f"_{i}_{n}") for n, c in cells.items()]
        parts.append(F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"_{i}_{n}").alias(n) for n in cells]))
    out = df.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*parts)).alias("m"))
    return out.select(*keys, "m.*").filter(F.col("n") >= 5)


def score_of(corr, dir_acc, pred_std, actual_std, pred_mean, actual_mean, mae, zero_mae, n) -> Column:
    """Composite signal score from aggregates; -1 where a side is (nearly) constant."""
    ratio = pred_std / actual_std
    ratio_pen = (
        F.when(ratio < 0.3, (0.3 - ratio) / 0.3).when(ratio > 1.0, F.least(ratio - 1.0, F.lit(1.0))).otherwise(F.lit(0.0))
    )
    zero_fail = F.greatest(F.lit(0.0), (mae - zero_mae) / (zero_mae + EPS))
    bias = F.abs(pred_mean - actual_mean) / (actual_std + EPS)
    score = (
        F.coalesce(F.when(~F.isnan(corr), corr), F.lit(0.0))
        + 0.5 * F.greatest(F.lit(0.0), dir_acc - 0.5)
        - 0.5 * ratio_pen
        - 2.0 * zero_fail
        - 0.3 * bias
    )
    flat = (n < 2) | (pred_std < TINY) | (actual_std < TINY)
    return F.when(flat, F.lit(-1.0)).otherwise(score)


def signal_score(df: DataFrame, keys: Sequence[str], p: str = P, y: str = Y) -> DataFrame:
    m = metrics(df, keys, p, y)
    cols = [F.col(c) for c in ("corr", "dir_acc", "pred_std", "actual_std", "pred_mean", "actual_mean", "mae", "zero_mae", "n")]
    return m.select(*keys, "n", score_of(*cols).alias("signal_score"))


def norm_metrics(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """Errors, correlation and score in the model's own target space."""
    m = metrics(df, keys, p, y)
    cols = [F.col(c) for c in ("corr", "dir_acc", "pred_std", "actual_std", "pred_mean", "actual_mean", "mae", "zero_mae", "n")]
    return m.select(
        *keys, F.col("mae").alias("norm_mae"), F.col("rmse").alias("norm_rmse"), F.col("corr").alias("norm_corr"),
        score_of(*cols).alias("norm_signal_score"),
    )


def recalibration(df: DataFrame, keys: Sequence[str], p: str = P, y: str = Y) -> DataFrame:
    """Least-squares slope and intercept of actual on predicted, the identity when unusable."""
    df = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(p), F.col(y)
    flat = (F.count(F.lit(1)) < 10) | (F.stddev_pop(a) < TINY)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(flat, 1.0).otherwise(F.regr_slope(b, a)).alias("slope"),
        F.when(flat, 0.0).otherwise(F.regr_intercept(b, a)).alias("intercept"),
        flat.alias("identity"),
    )


def shrinkage(df: DataFrame, keys: Sequence[str], grid: Sequence[float] = SHRINKAGE, p: str = P, y: str = Y, min_ratio: float = MIN_STD_RATIO) -> DataFrame:
    """Calibration with the shrinkage level of the best signal score (the first at a tie).

    Level s means slope a*s + 1-s and intercept b*s. Levels leaving too little spread
    do not count; without any, or without a usable fit, s is 0.
    """
    fit = recalibration(df, keys, p, y).drop("n")
    rows = lookup(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()), fit, list(keys))
    b = F.col(y)
    aggs = [
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.first("identity").alias("_flat"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(p).alias("_sp"),
        F.stddev_pop(b).alias("_sy"),
        F.avg(b).alias("_my"),
        F.avg(F.abs(b)).alias("_zero"),
    ]
    for i, s in enumerate(grid):
        c = F.col(p) * (F.col("slope") * s + (1.0 - s)) + F.col("intercept") * s
        aggs += [
            correlation(c, b).alias(f"_c{i}"),
            _hits(c, b).alias(f"_h{i}"),
            F.stddev_pop(c).alias(f"_s{i}"),
            F.avg(c).alias(f"_m{i}"),
            F.avg(F.abs(c - b)).alias(f"_e{i}"),
        ]
    out = rows.groupBy(*keys).agg(*aggs)
    options = []
    for i, s in enumerate(grid):
        score = score_of(
            F.col(f"_c{i}"), F.col(f"_h{i}"), F.col(f"_s{i}"), F.col("_sy"), F.col(f"_m{i}"), F.col("_my"),
            F.col(f"_e{i}"), F.col("_zero"), F.col("n"),
        )
        ratio = F.abs(F.col("slope") * s + (1.0 - s)) * F.col("_sp") / (F.col("_sy") + EPS)
        ok = (ratio >= min_ratio) & ~F.col("_flat")
        options.append(F.when(ok, F.struct(score.alias("score"), F.lit(-float(s)).alias("neg"))))
    best = F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))
    return out.withColumn("_best", best).select(
        *keys,
        "n",
        "slope",
        "intercept",
        F.coalesce(-F.col("_best.neg"), F.lit(0.0)).alias("shrinkage"),
        F.col("_best.score").alias("score"),
    )


def calibrate(df: DataFrame, fit: DataFrame, keys: Sequence[str], p: str = P) -> DataFrame:
    """Add calibrated_predicted_log_return from a `shrinkage` fit."""
    out = lookup(df, fit.select(*keys, "slope", "intercept", "shrinkage"), list(keys))
    s = F.col("shrinkage")
    return out.withColumn(
        "calibrated_predicted_log_return", F.col(p) * (F.col("slope") * s + (1 - s)) + F.col("intercept") * s
    ).drop("slope", "intercept", "shrinkage")


def calibrated_metrics(test: DataFrame, fit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw against calibrated errors on held-out rows, one pass."""
    cal = F.col("calibrated_predicted_log_return")
    raw, b = F.col(P), F.col(Y)
    rows = calibrate(test.filter(raw.isNotNull() & b.isNotNull()), fit, keys)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs(raw - b)).alias("mae"),
        F.avg(F.abs(cal - b)).alias("cal_mae"),
        _corr(raw, b).alias("corr"),
        _corr(cal, b).alias("cal_corr"),
        _r2(raw, b).alias("r2"),
        _r2(cal, b).alias("cal_r2"),
    )


def lag_diagnostic(df: DataFrame, keys: Sequence[str], ts: str = "ts", reach: int = 12, p: str = P, y: str = Y) -> DataFrame:
    """Correlation of pred[i] with actual[i - lag] per lag in -reach..reach, marking the best.

    Best is the first lag of the largest absolute value; with all 0 it is lag 0. One
    window pass shifts the actuals; each row then stands once for each lag, so one
    small aggregate by lag, summed up before the shuffle, takes every correlation.
    """
    lags = list(range(-reach, reach + 1))
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*keys, ts, p, y)

    def fn(d, w):
        return d.withColumn("_y", F.array(*[F.lag(y, k).over(w) for k in lags]))

    shifted = arrange(rows, keys, [ts]).bounded(fn, back=reach, ahead=reach).frame()
    pairs = shifted.select(*keys, p, F.posexplode("_y").alias("_slot", "_b"))
    a, b = F.when(F.col("_b").isNotNull(), F.col(p)), F.col("_b")
    c = correlation(a, b)
    ok = (F.count(b) >= 5) & (F.stddev_pop(a) >= TINY) & (F.stddev_pop(b) >= TINY) & ~F.isnan(c)
    out = pairs.groupBy(*keys, (F.col("_slot") - reach).alias("lag")).agg(F.when(ok, c).otherwise(0.0).alias("corr"))
    size = F.abs("corr")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(size.desc(), F.when(size > 0, F.col("lag")).otherwise(F.abs("lag")), "lag"))
    return out.select(*keys, "lag", "corr", (first == 1).alias("best"))


def residual_histogram(df: DataFrame, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """Counts of actual minus predicted in equal bins from the smallest to the largest."""
    rows = df.filter(F.col(P).isNotNull() & F.col(Y).isNotNull()).select(*keys, (F.col(Y) - F.col(P)).alias("_e"))
    ends = rows.groupBy(*keys).agg(F.min("_e").alias("lo"), F.max("_e").alias("hi"))
    at = lookup(rows, ends, list(keys))
    width = F.col("hi") - F.col("lo")
    slot = F.when(width > 0, F.least(F.floor((F.col("_e") - F.col("lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    return (
        at.groupBy(*keys, slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .select(*keys, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"), "n")
    )


def rolling_mae(df: DataFrame, keys: Sequence[str], ts: str = "ts", window: int = 24) -> DataFrame:
    rows = df.filter(F.col(P).isNotNull() & F.col(Y).isNotNull()).withColumn("abs_err", F.abs(F.col(Y) - F.col(P)))
    return arrange(rows, keys, [ts]).bounded(
        lambda d, w: d.withColumn("rolling_mae", rolling(F.avg, F.col("abs_err"), w, window)), back=window - 1
    ).frame()


def strength_drift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest gap between stored strength and |prediction|; OK up to 1e-9."""
    gap = F.max(F.abs(F.col("signal_strength") - F.abs(F.col(P))))
    return df.groupBy(*keys).agg(gap.alias("max_drift"), F.coalesce(gap <= 1e-9, F.lit(True)).alias("ok"))


def leaderboard(log: DataFrame, by: str = "latest") -> DataFrame:
    """Latest run, or the one of least test error, per asset and feature set."""
    if by == "latest":
        return dedup(log, ["asset", "feature_set"], ["run_at", "test_mae"], keep="last")
    return dedup(log.filter(F.col("test_mae").isNotNull()), ["asset", "feature_set"], ["test_mae", "run_at"])


def with_targets(predictions: DataFrame, targets: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Predictions left-joined to the targets known for their bars."""
    return predictions.join(targets.select("asset", "ts", *cols), ["asset", "ts"], "left")


def on_prices(predictions: DataFrame, bars: DataFrame, how: str = "inner") -> DataFrame:
    """Predictions with the close and the next price they imply; `left` keeps all predictions."""
    out = predictions.join(bars.select("asset", "ts", "close"), ["asset", "ts"], how)
    return out.withColumn("implied_price", next_price(F.col("close"), F.col(P)))


def markers(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Prediction markers on the price line, named by direction."""
    out = predictions.join(bars.select("asset", "ts", "close"), ["asset", "ts"], "left")
    d = F.col("predicted_direction")
    return out.withColumn("marker", F.when(d > 0, "long").when(d < 0, "short").when(d == 0, "neutral"))


def signals_on_bars(bars: DataFrame, predictions: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Bars left-joined to the last prediction per bar; bars without one get 0."""
    one = dedup(predictions, ["asset", "ts"], order, keep="last").select("asset", "ts", *cols)
    out = bars.join(one, ["asset", "ts"], "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


def overlap(market: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows per asset present in both tables."""
    return market.select("asset", "ts").join(predictions.select("asset", "ts"), ["asset", "ts"]).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_overlap")
    )
