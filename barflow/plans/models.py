"""Forecast evaluation, imputation, scaling, ridge, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow import session
from barflow.functions.output import tidy
from barflow.operators import bars as B
from barflow.operators import evaluation as E
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import modeling as M
from barflow.operators import reports as R
from barflow.operators import targets as T
from barflow.operators import windows as W
from barflow.plans.market import RULES, TARGETS
from barflow.plans.oracle import BARS_D, BARS_H, FORECASTS, LR, VOL, WA, frame, full, rd, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A
from barflow.sources import readers as RD
from barflow.sources import schemas as SC

F_SQL = with_(BARS_H, LR, VOL, FORECASTS)
CORR = "CASE WHEN stddev_pop({p}) > 0 AND stddev_pop({a}) > 0 THEN corr({p}, {a}) ELSE 0 END"
R2 = "CASE WHEN var_pop({a}) * count({a}) > 0 THEN 1 - sum(({a} - {p}) ** 2) / (var_pop({a}) * count({a})) ELSE 0 END"
SCORE = """({corr} + 0.5 * greatest(0, {acc} - 0.5)
  - 0.5 * (CASE WHEN {sp} / {sa} < 0.3 THEN (0.3 - {sp} / {sa}) / 0.3 WHEN {sp} / {sa} > 1 THEN least({sp} / {sa} - 1, 1) ELSE 0 END)
  - 2 * greatest(0, ({mae} - {zero}) / ({zero} + 1e-10)) - 0.3 * abs({mp} - {ma}) / ({sa} + 1e-10))"""


def corr(p="p", a="a"):
    return CORR.format(p=p, a=a)


def r2(p="p", a="a"):
    return R2.format(p=p, a=a)


def metric_cols(p="p", a="a"):
    return f"""count(*) AS n, avg(abs({p} - {a})) AS mae, sqrt(avg(({p} - {a}) ** 2)) AS rmse, {r2(p, a)} AS r2, {corr(p, a)} AS corr,
  avg((sign({p}) = sign({a}))::INT) AS dir_acc, stddev_pop({p}) AS pred_std, stddev_pop({a}) AS actual_std, avg({p}) AS pred_mean,
  avg({a}) AS actual_mean, min({p}) AS pred_min, max({p}) AS pred_max, min({a}) AS actual_min, max({a}) AS actual_max,
  avg(abs({a})) AS zero_mae, sqrt(avg({a} ** 2)) AS zero_rmse"""


def score_sql(corr="corr", acc="dir_acc", sp="pred_std", sa="actual_std", mp="pred_mean", ma="actual_mean", mae="mae", zero="zero_mae"):
    return "CASE WHEN n < 2 OR {sp} < 1e-12 OR {sa} < 1e-12 THEN -1 ELSE ".format(sp=sp, sa=sa) + SCORE.format(
        corr=corr, acc=acc, sp=sp, sa=sa, mp=mp, ma=ma, mae=mae, zero=zero
    ) + " END"


BASE = (
    "mae", "rmse", "r2", "corr", "dir_acc", "pred_std", "actual_std", "pred_mean", "actual_mean", "pred_min", "pred_max",
    "actual_min", "actual_max", "zero_mae", "zero_rmse",
)


@query(
    "a09_regression_metrics",
    F_SQL
    + f", m AS (SELECT asset, {metric_cols()} FROM f GROUP BY 1) SELECT asset, n, {rds(*BASE)}, {rd('pred_std / actual_std', 'std_ratio')}, "
    + f"{rd('(zero_mae - mae) / (zero_mae + 1e-10) * 100', 'mae_vs_zero_pct')}, {rd('(zero_rmse - rmse) / (zero_rmse + 1e-10) * 100', 'rmse_vs_zero_pct')} FROM m",
)
def _(spark, sf):
    return tidy(E.metrics(A.forecasts(spark, sf), ["asset"]))


CLASSES = "d AS (SELECT asset, " + ", ".join(
    f"CASE WHEN {c} > 0.002 THEN 1 WHEN {c} < -0.002 THEN -1 ELSE 0 END AS {n}" for c, n in (("p", "dp"), ("a", "da"))
) + " FROM f)"


@query(
    "a10_class_metrics",
    F_SQL
    + f""", {CLASSES}, c AS (SELECT d.asset, k.c, count(*) FILTER (dp = c AND da = c) AS tp, count(*) FILTER (dp = c) + count(*) FILTER (da = c) AS anyc
      FROM d, (VALUES (-1), (0), (1)) k(c) GROUP BY 1, 2),
    g AS (SELECT asset, avg((dp = da)::INT) AS derived_accuracy, count(*) AS n FROM d GROUP BY 1)
    SELECT g.asset, g.n, {rd('any_value(derived_accuracy)', 'derived_accuracy')}, {rd('avg(2.0::DOUBLE * tp / anyc)', 'derived_f1_macro')}
    FROM g JOIN c ON c.asset = g.asset AND anyc > 0 GROUP BY g.asset, g.n""",
)
def _(spark, sf):
    return tidy(E.class_metrics(A.forecasts(spark, sf), ["asset"]))


SPLIT = """s AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM f))"""


def _split(spark, sf):
    return W.split(A.forecasts(spark, sf), ["asset"], ["ts"])


@query(
    "a11_baselines",
    F_SQL
    + f""", {SPLIT}, m AS (SELECT asset, avg(a) AS tm FROM s WHERE split = 'train' GROUP BY 1)
    SELECT asset, count(*) AS n, {rd('any_value(tm)', 'train_mean')}, {rd('avg(abs(a))', 'zero_mae')}, {rd('sqrt(avg(a ** 2))', 'zero_rmse')}, {rd(r2('0', 'a'), 'zero_r2')},
      {rd('avg(abs(a - tm))', 'mean_mae')}, {rd('sqrt(avg((a - tm) ** 2))', 'mean_rmse')}, {rd(r2('tm', 'a'), 'mean_r2')}
    FROM s JOIN m USING (asset) WHERE split = 'test' GROUP BY 1""",
)
def _(spark, sf):
    s = _split(spark, sf)
    return tidy(E.baselines(s.filter("split = 'test'"), s.filter("split = 'train'"), ["asset"]))


MOVE_SQL = " UNION ALL ".join(
    f"""SELECT asset, {t}::DOUBLE AS threshold, count(*) AS n, {rd('avg(abs(p - a))', 'mae')}, {rd('sqrt(avg((p - a) ** 2))', 'rmse')}, {rd(corr(), 'corr')},
      {rd('avg((sign(p) = sign(a))::INT)', 'dir_acc')}, {rd('stddev_pop(p) / stddev_pop(a)', 'std_ratio')} FROM f WHERE abs(a) > {t}::DOUBLE GROUP BY 1 HAVING count(*) >= 5"""
    for t in E.MOVES
)


@query("a12_meaningful_moves", F_SQL + MOVE_SQL)
def _(spark, sf):
    return tidy(E.meaningful_moves(A.forecasts(spark, sf), ["asset"]))


@query(
    "a13_signal_score",
    F_SQL + f", m AS (SELECT asset, {metric_cols()} FROM f GROUP BY 1) SELECT asset, n, {rd(score_sql(), 'signal_score')} FROM m",
)
def _(spark, sf):
    return tidy(E.signal_score(A.forecasts(spark, sf), ["asset"]))


NORM = "g AS (SELECT asset, p / greatest(vol, 1e-6::DOUBLE) AS p, a / greatest(vol, 1e-6::DOUBLE) AS a FROM f WHERE vol IS NOT NULL)"


@query(
    "a14_norm_metrics",
    F_SQL
    + f", {NORM}, m AS (SELECT asset, {metric_cols()} FROM g GROUP BY 1) SELECT asset, {rd('mae', 'norm_mae')}, {rd('rmse', 'norm_rmse')}, {rd('corr', 'norm_corr')}, {rd(score_sql(), 'norm_signal_score')} FROM m",
)
def _(spark, sf):
    f = A.forecasts(spark, sf)
    vol = F.greatest(F.col("vol"), F.lit(T.VOL_FLOOR))
    f = f.filter("vol is not null").withColumns({"pn": F.col(E.P) / vol, "an": F.col(E.Y) / vol})
    return tidy(E.norm_metrics(f, ["asset"], "pn", "an"))


@query(
    "a15_recalibration",
    F_SQL
    + f""", {SPLIT} SELECT asset, count(*) AS n, {rd('regr_slope(a, p)', 'slope')}, {rd('regr_intercept(a, p)', 'intercept')}, count(*) < 10 OR stddev_pop(p) < 1e-12 AS identity
    FROM s WHERE split = 'val' GROUP BY 1""",
)
def _(spark, sf):
    return tidy(E.recalibration(_split(spark, sf).filter("split = 'val'"), ["asset"]))


GRID = f"""fit AS (SELECT asset, regr_slope(a, p) AS k, regr_intercept(a, p) AS b FROM s WHERE split = 'val' GROUP BY 1),
lv AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in E.SHRINKAGE)}) v(lvl)),
cal AS (SELECT s.asset, lvl, k, b, s.p AS p0, s.p * (k * lvl + (1 - lvl)) + b * lvl AS p, a FROM s JOIN fit USING (asset), lv WHERE split = 'val'),
cm AS (SELECT asset, lvl, k, b, stddev_pop(p0) AS sp0, {metric_cols()} FROM cal GROUP BY ALL),
sc AS (SELECT *, {score_sql()} AS score FROM cm WHERE abs(k * lvl + (1 - lvl)) * sp0 / (actual_std + 1e-10) >= 0.2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, lvl) AS rn FROM sc) WHERE rn = 1)"""


@query(
    "a16_shrinkage",
    F_SQL
    + f", {SPLIT}, {GRID} SELECT asset, n, {rd('k', 'slope')}, {rd('b', 'intercept')}, {rd('lvl', 'shrinkage')}, {rds('score')} FROM best",
)
def _(spark, sf):
    return tidy(E.shrinkage(_split(spark, sf).filter("split = 'val'"), ["asset"]))


@query(
    "a17_calibrated_metrics",
    F_SQL
    + f""", {SPLIT}, {GRID}, c AS (SELECT s.asset, s.p, s.a, s.p * (k * lvl + (1 - lvl)) + b * lvl AS q FROM s JOIN best USING (asset) WHERE split = 'test')
    SELECT asset, {rd('avg(abs(p - a))', 'mae')}, {rd('avg(abs(q - a))', 'cal_mae')}, {rd(corr(), 'corr')}, {rd(corr('q'), 'cal_corr')}, {rd(r2(), 'r2')}, {rd(r2('q'), 'cal_r2')} FROM c GROUP BY 1""",
)
def _(spark, sf):
    s = _split(spark, sf)
    fit = E.shrinkage(s.filter("split = 'val'"), ["asset"])
    return tidy(E.calibrated_metrics(s.filter("split = 'test'"), fit, ["asset"]))


@query(
    "a18_lag_diagnostic",
    F_SQL
    + f""", i AS (SELECT *, row_number() OVER ({WA}) AS i FROM f), lg AS (SELECT unnest(generate_series(-12, 12))::INT AS lag),
    c AS (SELECT x.asset, lag, corr(x.p, y.a) AS corr FROM i x, lg, i y WHERE y.asset = x.asset AND y.i = x.i - lag GROUP BY 1, 2)
    SELECT asset, lag, {rds('corr')}, row_number() OVER (PARTITION BY asset ORDER BY abs(corr) DESC, lag) = 1 AS best FROM c""",
)
def _(spark, sf):
    return tidy(E.lag_diagnostic(A.forecasts(spark, sf), ["asset"]))


@query(
    "a31_residual_histogram",
    F_SQL
    + f""", e AS (SELECT asset, a - p AS e FROM f), m AS (SELECT asset, min(e) AS lo, max(e) AS hi FROM e GROUP BY 1)
    SELECT asset, least(floor((e - lo) / (hi - lo) * 50), 49)::INT AS bin, {rd('any_value(lo) + least(floor((e - lo) / (hi - lo) * 50), 49)::INT * (any_value(hi) - any_value(lo)) / 50', 'left_edge')}, count(*) AS n
    FROM e JOIN m USING (asset) GROUP BY asset, least(floor((e - lo) / (hi - lo) * 50), 49)""",
)
def _(spark, sf):
    return tidy(E.residual_histogram(A.forecasts(spark, sf), ["asset"]))


@query(
    "a33_strength_drift",
    F_SQL
    + "SELECT asset, max(CASE WHEN asset < 'f' AND hour(ts) = 5 THEN 0.25 ELSE 0 END)::DOUBLE AS max_drift, NOT bool_or(asset < 'f' AND hour(ts) = 5) AS ok FROM f GROUP BY 1",
)
def _(spark, sf):
    # some assets' stored strengths have drifted
    stored = E.derived(A.forecasts(spark, sf))
    moved = F.when((F.col("asset") < "f") & (F.hour("ts") == 5), 0.25).otherwise(0.0)
    return tidy(E.strength_drift(stored.withColumn("signal_strength", F.col("signal_strength") + moved), ["asset"]))


@query(
    "w29_rolling_mae",
    F_SQL + f", e AS (SELECT *, abs(a - p) AS e FROM f) SELECT asset, {ts()}, {rd(full('avg', 'e', 24), 'rolling_mae')} FROM e",
)
def _(spark, sf):
    return tidy(E.rolling_mae(A.forecasts(spark, sf), ["asset"]).select("asset", "ts", "rolling_mae"))


@query(
    "p15_forecast_columns",
    F_SQL
    + f"""SELECT asset, {ts()}, {rd('abs(p)', 'signal_strength')}, CASE WHEN p > 0.002 THEN 1 WHEN p < -0.002 THEN -1 ELSE 0 END AS predicted_direction,
    CASE WHEN a > 0.002 THEN 1 WHEN a < -0.002 THEN -1 ELSE 0 END AS actual_direction, {rd('p - a', 'regression_error')}, {rd('abs(p - a)', 'abs_error')} FROM f""",
)
def _(spark, sf):
    d = E.derived(A.forecasts(spark, sf))
    return tidy(d.select("asset", "ts", "signal_strength", "predicted_direction", "actual_direction", "regression_error", "abs_error"))


@query(
    "p13_basis_points",
    F_SQL + f"SELECT asset, {ts()}, {rd('p * 10000', 'predicted_log_return_bps')}, {rd('a * 10000', 'actual_log_return_bps')} FROM f",
)
def _(spark, sf):
    d = E.basis_points(A.forecasts(spark, sf), [E.P, E.Y])
    return tidy(d.select("asset", "ts", f"{E.P}_bps", f"{E.Y}_bps"))


@query(
    "p16_denormalise",
    F_SQL
    + f""", m AS (SELECT asset, avg(a) AS m, greatest(stddev_pop(a), 1e-8::DOUBLE) AS s FROM f GROUP BY 1)
    SELECT asset, {ts()}, {rd('p * s + m', 'predicted_norm_return')}, {rd('(p * s + m) * vol', 'predicted_log_return')} FROM f JOIN m USING (asset)""",
)
def _(spark, sf):
    f = A.forecasts(spark, sf)
    scaler = M.fit_target_scaler(f, ["asset"], E.Y)
    d = E.denormalise(f.withColumnRenamed(E.P, "predicted_scaled"), scaler)
    return tidy(d.select("asset", "ts", "predicted_norm_return", E.P))


@query(
    "p28_agent_inputs",
    F_SQL
    + f"""SELECT asset, {ts()}, {rd('greatest(least(p, 0.05::DOUBLE), -0.05::DOUBLE) / 0.05::DOUBLE', 'in_return')}, {rd('least(abs(p), 0.05::DOUBLE) / 0.05::DOUBLE', 'in_strength')},
    (CASE WHEN p > 0.002 THEN 1 WHEN p < -0.002 THEN -1 ELSE 0 END)::DOUBLE AS in_direction FROM f""",
)
def _(spark, sf):
    d = E.agent_inputs(E.derived(A.forecasts(spark, sf)))
    return tidy(d.select("asset", "ts", "in_return", "in_strength", "in_direction"))


@query(
    "j03_predictions_targets",
    F_SQL
    + f", {TARGETS} SELECT f.asset, {ts('f.ts')}, {rd('p', E.P)}, {rds('ret_1h', 'norm_ret_4h')}, direction_4h FROM f LEFT JOIN t ON t.asset = f.asset AND t.ts = f.ts",
)
def _(spark, sf):
    out = E.with_targets(A.forecasts(spark, sf), T.build(A.bars_hourly(spark, sf)), ["ret_1h", "norm_ret_4h", "direction_4h"])
    return tidy(out.select("asset", "ts", E.P, "ret_1h", "norm_ret_4h", "direction_4h"))


@query(
    "p17_implied_price",
    F_SQL + f"SELECT asset, {ts()}, {rds('close')}, {rd('close * exp(p)', 'implied_price')} FROM f",
)
def _(spark, sf):
    f = A.forecasts(spark, sf)
    return tidy(E.on_prices(f.drop("close"), A.bars_hourly(spark, sf)).select("asset", "ts", "close", "implied_price"))


@query(
    "j09_markers",
    F_SQL
    + f"SELECT asset, {ts()}, {rds('close')}, CASE WHEN p > 1e-5 THEN 'long' WHEN p < -1e-5 THEN 'short' ELSE 'neutral' END AS marker FROM f",
)
def _(spark, sf):
    f = E.derived(A.forecasts(spark, sf), threshold=1e-5).drop("close")
    return tidy(E.markers(f, A.bars_hourly(spark, sf)).select("asset", "ts", "close", "marker"))


@query(
    "j11_signals_on_bars",
    F_SQL + f"SELECT b.asset, {ts('b.ts')}, {rd('coalesce(f.p, 0)', E.P)}, {rd('coalesce(abs(f.p), 0)', 'signal_strength')} FROM b LEFT JOIN f ON f.asset = b.asset AND f.ts = b.ts",
)
def _(spark, sf):
    f = E.derived(A.forecasts(spark, sf))
    old = f.withColumns({E.P: F.lit(9.0), "run": F.lit(1)})
    both = old.unionByName(f.withColumn("run", F.lit(2)))
    out = E.signals_on_bars(A.bars_hourly(spark, sf), both, [E.P, "signal_strength"], ["run"])
    return tidy(out.select("asset", "ts", E.P, "signal_strength"))


@query(
    "j12_overlap",
    F_SQL + "SELECT b.asset, count(*) AS n_overlap FROM b JOIN f ON f.asset = b.asset AND f.ts = b.ts GROUP BY 1",
)
def _(spark, sf):
    return E.overlap(A.bars_hourly(spark, sf), A.forecasts(spark, sf))


@query(
    "j16_metrics_pivot",
    F_SQL
    + f"SELECT asset, {rd('avg(abs(p - a))', 'model_mae')}, {rd('avg(abs(a))', 'zero_mae')}, {rd(corr(), 'model_corr')}, 0.0::DOUBLE AS zero_corr FROM f GROUP BY 1",
)
def _(spark, sf):
    f = A.forecasts(spark, sf)
    zero = E.metrics(f.withColumn(E.P, F.lit(0.0)), ["asset"]).withColumn("model", F.lit("zero"))
    mine = E.metrics(f, ["asset"]).withColumn("model", F.lit("model"))
    return tidy(R.metrics_pivot([mine, zero], ["mae", "corr"], ["model", "zero"]))


LOG = "g AS (SELECT o_orderpriority AS asset, o_orderstatus AS feature_set, o_orderdate AS run_at, o_totalprice AS test_mae, o_orderkey FROM orders)"


def _log(spark, sf):
    return A.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("asset"),
        F.col("o_orderstatus").alias("feature_set"),
        F.col("o_orderdate").alias("run_at"),
        F.col("o_totalprice").alias("test_mae"),
    )


for _by, _order in (("latest", "run_at DESC, test_mae DESC"), ("best", "test_mae, run_at")):

    def _board(spark, sf, by=_by):
        return tidy(E.leaderboard(_log(spark, sf), by))

    query(
        f"a41_leaderboard_{_by}",
        with_(LOG, f"k AS (SELECT *, row_number() OVER (PARTITION BY asset, feature_set ORDER BY {_order}) AS rn FROM g)")
        + f"SELECT asset, feature_set, {ts('run_at')}, {rds('test_mae')} FROM k WHERE rn = 1",
    )(_board)


# Customers with missing values: balance unknown in one segment of signs.
CUST = "c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, c_custkey::DOUBLE AS key FROM customer)"
CF = ["bal", "key"]


def _cust(spark, sf):
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"),
        F.col("c_custkey").cast("double").alias("key"),
    )


@query(
    "a34_median_fit",
    with_(CUST) + f"SELECT c_nationkey, {rd('median(bal)', 'bal')}, {rd('median(key)', 'key')} FROM c GROUP BY 1",
)
def _(spark, sf):
    return tidy(M.fit_median(_cust(spark, sf), ["c_nationkey"], CF))


@query(
    "a34_median_impute",
    with_(CUST, "m AS (SELECT c_nationkey, median(bal) AS mb FROM c GROUP BY 1)")
    + f"SELECT c_custkey, {rd('coalesce(bal, mb)', 'bal')} FROM c JOIN m USING (c_nationkey)",
)
def _(spark, sf):
    c = _cust(spark, sf)
    out = M.impute(c, M.fit_median(c, ["c_nationkey"], CF), ["c_nationkey"], CF)
    return tidy(out.select("c_custkey", "bal"))


@query(
    "a35_scale",
    with_(
        CUST,
        "m AS (SELECT c_nationkey, avg(bal) AS m, stddev_pop(bal) AS s, avg(key) AS mk, stddev_pop(key) AS sk FROM c GROUP BY 1)",
    )
    + f"SELECT c_custkey, {rd('coalesce((bal - m) / (CASE WHEN s = 0 THEN 1 ELSE s END), 0)', 'bal')}, {rd('coalesce((key - mk) / (CASE WHEN sk = 0 THEN 1 ELSE sk END), 0)', 'key')} FROM c JOIN m USING (c_nationkey)",
)
def _(spark, sf):
    c = _cust(spark, sf)
    out = M.scale(c, M.fit_scaler(c, ["c_nationkey"], CF), ["c_nationkey"], CF)
    return tidy(out.select("c_custkey", *CF))


@query(
    "a36_target_scale",
    F_SQL
    + f""", {SPLIT}, m AS (SELECT asset, avg(a) AS m, greatest(stddev_pop(a), 1e-8::DOUBLE) AS sd FROM s WHERE split = 'train' GROUP BY 1)
    SELECT asset, {ts()}, {rd('(a - m) / sd', 'target_scaled')} FROM s JOIN m USING (asset)""",
)
def _(spark, sf):
    s = _split(spark, sf)
    scaler = M.fit_target_scaler(s.filter("split = 'train'"), ["asset"], E.Y)
    return tidy(M.scale_target(s, scaler, ["asset"], E.Y).select("asset", "ts", "target_scaled"))


RIDGE2 = """z AS (SELECT c_mktsegment AS seg, c_acctbal AS y, c_nationkey::DOUBLE AS x1, (c_custkey % 101)::DOUBLE AS x2 FROM customer),
g AS (SELECT seg, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) + 1 AS s11, var_pop(x2) * count(*) + 1 AS s22,
  covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM z GROUP BY 1),
w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM g)"""


@query(
    "a37_ridge_two",
    with_(RIDGE2) + f"SELECT seg, n, {rd('my - w1 * m1 - w2 * m2', 'intercept')}, {rds('w1', 'w2')} FROM w",
)
def _(spark, sf):
    z = A.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("seg"),
        F.col("c_acctbal").alias("y"),
        F.col("c_nationkey").cast("double").alias("x1"),
        (F.col("c_custkey") % 101).cast("double").alias("x2"),
    )
    m = M.fit_ridge(z, ["seg"], ["x1", "x2"], "y")
    return tidy(m.select("seg", "n", "intercept", F.col("coefficients")[0].alias("w1"), F.col("coefficients")[1].alias("w2")))


def _ridge_sql(features, target="ln(lead(close, 4) OVER ({wa}) / close)", alpha=1.0):
    """The whole of a37 in SQL: the normal equations are eliminated column by column, one CTE each."""
    p = len(features)
    x, rhs = [f"x{i}" for i in range(p)], p
    each = lambda form, sep=", ": sep.join(form.format(i=i) for i in range(p))
    up = [(i, j) for i in range(p) for j in range(i, p + 1)]
    second = lambda j: f"(y - ay)" if j == rhs else f"(z{j} - a{j})"
    parts = [
        "fx AS (SELECT asset, ts, " + ", ".join(f"{f} AS {n}" for f, n in zip(features, x)) + f", {target.format(wa=WA)} AS y FROM v)",
        "dt AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM fx WHERE y IS NOT NULL)",
        """sp AS (SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM dt)""",
        "md AS (SELECT asset, " + each("median(x{i}) AS m{i}") + " FROM sp WHERE split = 'train' GROUP BY 1)",
        "im AS (SELECT sp.asset, split, y, " + each("coalesce(x{i}, m{i}) AS x{i}") + " FROM sp JOIN md ON md.asset = sp.asset)",
        "sc AS (SELECT asset, " + each("avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1 ELSE stddev_pop(x{i}) END AS s{i}") + " FROM im WHERE split = 'train' GROUP BY 1)",
        "z AS (SELECT im.asset, split, y, " + each("coalesce((x{i} - m{i}) / s{i}, 0) AS z{i}") + " FROM im JOIN sc ON sc.asset = im.asset)",
        "c AS (SELECT asset, avg(y) AS ay, " + each("avg(z{i}) AS a{i}") + " FROM z WHERE split = 'train' GROUP BY 1)",
        "e0 AS (SELECT z.asset, " + ", ".join(f"sum((z{i} - a{i}) * {second(j)}) + {alpha if i == j else 0}::DOUBLE AS g{i}_{j}" for i, j in up) + " FROM z JOIN c ON c.asset = z.asset WHERE split = 'train' GROUP BY 1)",
    ]
    for k in range(p):
        cells = [f"g{i}_{j} - g{k}_{i} * g{k}_{j} / g{k}_{k} AS g{i}_{j}" if i > k else f"g{i}_{j}" for i, j in up]
        parts.append(f"e{k + 1} AS (SELECT asset, {', '.join(cells)} FROM e{k})")
    solved = [f"(g{i}_{rhs}" + "".join(f" - g{i}_{j} * w{j}" for j in range(i + 1, p)) + f") / g{i}_{i} AS w{i}" for i in reversed(range(p))]
    parts += [
        f"w AS (SELECT asset, {', '.join(solved)} FROM e{p})",
        "f AS (SELECT z.asset, split, y AS a, ay + " + each("w{i} * (z{i} - a{i})", " + ") + " AS p FROM z JOIN c ON c.asset = z.asset JOIN w ON w.asset = z.asset)",
        f"m AS (SELECT asset, split, {metric_cols()} FROM f GROUP BY 1, 2)",
    ]
    more = f"{rd('pred_std / actual_std', 'std_ratio')}, {rd('(zero_mae - mae) / (zero_mae + 1e-10) * 100', 'mae_vs_zero_pct', 5)}, {rd('(zero_rmse - rmse) / (zero_rmse + 1e-10) * 100', 'rmse_vs_zero_pct', 5)}"
    return with_(BARS_D, LR, VOL, *parts) + f"SELECT asset, split, n, {rds(*BASE)}, {more} FROM m"


# in the order of SC.RIDGE
RIDGE_FEATURES = (
    *(f"CASE WHEN count(lr) {frame(2 * n - 2, 1 - n)} = {n} THEN sum(lr) {frame(2 * n - 2, 1 - n)} END" for n in (1, 4, 8, 16)),
    *(full("avg", "close", n) for n in (4, 8, 16)),
    *(full("stddev_samp", "close", n) for n in (4, 8, 16)),
    *(f"close / lag(close, {n}) OVER ({WA}) - 1" for n in (4, 16)),
    "vol_20",
)


@query("a37_ridge_all_assets", _ridge_sql(RIDGE_FEATURES))
def ridge_all_assets(spark, sf):
    """Dataset -> split -> impute -> scale -> ridge -> metrics of every split, all assets at once."""
    bars = A.bars_daily(spark, sf)
    s = I.apply(B.bar_series(bars), I.lagged_returns(), I.rolling_close(), I.momentum(), I.volatility())
    data = T.dataset(s.frame(), T.build(bars), SC.RIDGE, "ret_4h")
    # Read by the medians, the sums and the metrics: computed once.
    data = session.settle(W.split(data, ["asset"], ["ts"], bound=[bars, bars]), "dataset")
    train = data.filter("split = 'train'")
    medians = M.fit_median(train, ["asset"], SC.RIDGE)
    stats = M.moments(train, ["asset"], [*SC.RIDGE, "ret_4h"], centre=medians)
    model = M.ridge_of_moments(stats, ["asset"], SC.RIDGE, "ret_4h", centre=medians)
    filled = M.impute(data, medians, ["asset"], SC.RIDGE)
    out = M.predict_linear(filled, model, ["asset"], SC.RIDGE, E.P).withColumnRenamed("ret_4h", E.Y)
    return tidy(E.metrics(out, ["asset", "split"]), mae_vs_zero_pct=5, rmse_vs_zero_pct=5)


SEQ = """q AS (SELECT asset, ts, split, close, list(printf('%.2f', close)) OVER w AS l, count(*) OVER w AS c FROM s
  WINDOW w AS (PARTITION BY asset, split ORDER BY ts ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))"""


def _sequences(spark, sf):
    return W.sequences(_split(spark, sf), ["asset", "split"], ["ts"], ["close", E.P])


@query(
    "w21_sequences",
    F_SQL + f", {SPLIT}, {SEQ} SELECT asset, split, {ts()}, array_to_string(l, '|') AS closes FROM q WHERE c = 64",
)
def _(spark, sf):
    text = F.transform("sequence", lambda v: F.format_string("%.2f", v[0]))
    return tidy(_sequences(spark, sf).select("asset", "split", "ts", F.array_join(text, "|").alias("closes")))


@query(
    "f02_sequence_scoring",
    F_SQL + f", {SPLIT}, {SEQ.replace('close, list', 'close, p, list')} SELECT asset, split, {ts()}, {rd('0.5 * close - 2 * p + 1', 'prediction')} FROM q WHERE c = 64",
)
def _(spark, sf):
    out = M.score_series(_split(spark, sf), ["asset", "split"], ["ts"], ["close", E.P], M.linear_model([0.5, -2.0], 1.0))
    return tidy(out.select("asset", "split", "ts", "prediction"))


@query(
    "p08_feature_projection",
    with_(BARS_D, LR, VOL)
    + f"SELECT asset, {ts()}, {rd('lr', 'ret_1')}, {rd(full('avg', 'close', 4), 'mean_4')}, {rd(full('stddev_samp', 'close', 16), 'std_16')}, {rd(f'close / lag(close, 16) OVER ({WA}) - 1', 'mom_16')}, {rds('vol_20')} FROM v",
)
def _(spark, sf):
    s = I.apply(
        B.bar_series(A.bars_daily(spark, sf)), I.lagged_returns(), I.rolling_close(), I.momentum(), I.volatility()
    )
    cols = SC.feature_columns("any", "ridge")
    out = s.frame().select("asset", "ts", *cols)
    SC.validate_columns(out.columns[2:], cols, "ridge")
    return tidy(out.select("asset", "ts", "ret_1", "mean_4", "std_16", "mom_16", "vol_20"))


MODES = {
    "full": ("ret_1", "vol_20", "close", "dxy", "x_gdelt_tone"),
    "no_gdelt": ("ret_1", "vol_20", "close", "dxy"),
    "technical_macro": ("ret_1", "vol_20", "close", "dxy"),
    "technical_only": ("ret_1", "vol_20", "close"),
    "price_only": ("ret_1", "vol_20", "close"),
}
_EVERY = ("ret_1", "vol_20", "close", "dxy", "x_gdelt_tone", "hour_sin")


def _mode_sql(mode, names):
    kept = names + (("hour_sin",) if mode != "price_only" else ())
    cells = ", ".join(f"{rd({'ret_1': 'lr'}.get(c, c), c)}" if c in kept else f"NULL::DOUBLE AS {c}" for c in _EVERY)
    return f"SELECT '{mode}' AS mode, asset, {ts()}, {cells} FROM x"


@query(
    "p09_feature_set",
    with_(BARS_D, LR, VOL, "x AS (SELECT *, 1 + k % 7 AS dxy, k % 5 / 5::DOUBLE AS x_gdelt_tone, k % 24 AS hour_sin FROM v)")
    + " UNION ALL ".join(_mode_sql(m, c) for m, c in MODES.items()),
)
def _(spark, sf):
    s = I.apply(B.bar_series(A.bars_daily(spark, sf)), I.lagged_returns((1,)), I.volatility()).position("_k")
    k = F.col("_k")
    df = s.frame().withColumns({"dxy": 1 + k % 7, "x_gdelt_tone": k % 5 / 5, "hour_sin": k % 24})
    df = df.select("asset", "ts", *[F.col(c).cast("double").alias(c) for c in _EVERY])

    def mode(name):
        kept = SC.feature_set(_EVERY, name)
        cells = [F.col(c) if c in kept else F.lit(None).cast("double").alias(c) for c in _EVERY]
        return df.select(F.lit(name).alias("mode"), "asset", "ts", *cells)

    return tidy(RD.union_all(*map(mode, MODES)))


@query(
    "p11_defaults",
    with_(CUST) + f"SELECT c_custkey, {rd('coalesce(bal, 0)', 'bal')}, 1.0::DOUBLE AS extra FROM c",
)
def _(spark, sf):
    return tidy(SC.with_defaults(_cust(spark, sf).select("c_custkey", "bal"), {"bal": 0.0, "extra": 1.0}))


@query(
    "p12_canonical_names",
    f"SELECT event_id, {rd('CASE WHEN event_type <> $$error$$ THEN value END', 'predicted_log_return')} FROM events",
)
def _(spark, sf):
    raw = A.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("pred_ret")
    )
    return tidy(SC.canonical(raw, {"pred_ret": E.P, "absent": "other"}, numeric=[E.P]))


@query("p10_validated_columns", f"SELECT event_type, event_id, {rds('value')} FROM events")
def _(spark, sf):
    e = A.table(spark, sf, "events")
    wanted = ["event_type", "event_id", "value"]
    found = [c for c in e.columns if c in wanted]
    return tidy(e.select(*SC.validate_columns(found, wanted, "events", warn=found != wanted)))


_HELD = ("close", "ret_1", "vol_20", "dxy", "volume", "note", "sentiment_mean")
_EXPECTED = ("ret_1", "vol_20", "dxy", "vix")


def _status_sql():
    def named(cols, test):
        return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {test(c)} THEN {chr(39)}{c}{chr(39)} END' for c in cols)}], lambda x: x IS NOT NULL), ',')"

    gone = {c: f"count({c}) = 0" if c in _HELD else "true" for c in _EXPECTED}
    absent = " + ".join(f"({g})::INT" for g in gone.values())
    extra = [c for c in _HELD if c not in _EXPECTED and c != "sentiment_mean"]
    return with_(
        BARS_D, LR, VOL,
        "x AS (SELECT asset, ts, close, lr AS ret_1, vol_20, CASE WHEN asset < '3' THEN close END AS dxy, volume, CASE WHEN volume > 40 THEN 1 END AS note,"
        " CASE WHEN asset LIKE '%LOW' THEN 0.5 END AS sentiment_mean FROM v)",
    ) + (
        f"SELECT asset, count(*) AS n_rows, 4::BIGINT AS n_expected, (4 - ({absent}))::BIGINT AS n_present, {named(_EXPECTED, gone.get)} AS missing, "
        f"{named(extra, lambda c: f'count({c}) > 0')} AS extra, ({absent}) = 0 AS valid, count(sentiment_mean) > 0 AS has_sentiment FROM x GROUP BY 1"
    )


@query("p10_feature_status", _status_sql())
def _(spark, sf):
    s = I.apply(B.bar_series(A.bars_daily(spark, sf)), I.lagged_returns((1,)), I.volatility())
    df = s.frame().withColumns(
        {
            "dxy": F.when(F.col("asset") < "3", F.col("close")), "note": F.when(F.col("volume") > 40, 1),
            "sentiment_mean": F.when(F.col("asset").endswith("LOW"), 0.5),
        }
    )
    return R.feature_status(df.select("asset", "ts", *_HELD), _EXPECTED, ["sentiment_mean"])
