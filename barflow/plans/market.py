"""Bars, indicators, features, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.output import tidy
from barflow.operators import bars as B
from barflow.operators import features as X
from barflow.operators import indicators as I
from barflow.operators import targets as T
from barflow.operators import windows as W
from barflow.operators.quantiles import quantiles
from barflow.plans.oracle import BARS_D, BARS_H, LR, MACRO, VOL, WA, frame, full, rd, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A

RULES = (
    X.CrossRule("view", "click", "log_ret", 1, "lead_ret_lag_1"),
    X.CrossRule("view", "click", "log_ret", 4, "lead_ret_lag_4"),
    X.CrossRule("purchase", "signup", "vol_20", 1, "lead_vol_lag_1"),
)


def steps(spark, sf_dir, *parts, bars=A.bars_hourly):
    return I.apply(B.bar_series(bars(spark, sf_dir)), *parts).frame()


@query("a02_ohlcv_resample", with_(BARS_H) + f"SELECT asset, {ts()}, {rds('open', 'high', 'low', 'close', 'volume')} FROM b")
def _(spark, sf):
    return tidy(A.bars_hourly(spark, sf))


@query(
    "a02_ohlcv_from_bars",
    with_(
        BARS_H,
        """d AS (SELECT asset, time_bucket(INTERVAL 4 HOUR, ts) AS s, arg_min(open, ts) AS open, max(high) AS high,
           min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2)""",
    )
    + f"SELECT asset, {ts('s', 'ts')}, {rds('open', 'high', 'low', 'close', 'volume')} FROM d",
)
def _(spark, sf):
    return tidy(B.resample(A.bars_hourly(spark, sf), "4 hours"))


@query("w01_returns", with_(BARS_D, LR) + f"SELECT asset, {ts()}, {rd('lr', 'log_ret')}, {rds('pct')} FROM r")
def _(spark, sf):
    return tidy(B.simple_returns(A.bars_daily(spark, sf)).select("asset", "ts", "log_ret", "pct"))


def _lagged(n):
    f = f"OVER ({WA} ROWS BETWEEN {2 * n - 2} PRECEDING AND {n - 1} PRECEDING)" if n > 1 else frame(0)
    return rd(f"CASE WHEN count(lr) {f} = {n} THEN sum(lr) {f} END", f"ret_{n}")


@query(
    "w02_lagged_returns",
    with_(BARS_D, LR) + f"SELECT asset, {ts()}, {', '.join(_lagged(n) for n in (1, 4, 8, 16))} FROM r",
)
def _(spark, sf):
    df = steps(spark, sf, I.lagged_returns(), bars=A.bars_daily)
    return tidy(df.select("asset", "ts", "ret_1", "ret_4", "ret_8", "ret_16"))


@query(
    "w02_trailing_returns",
    with_(BARS_H, LR) + f"SELECT asset, {ts()}, {', '.join(rd(full('sum', 'lr', n), f'ret_{n}') for n in (4, 16))} FROM r",
)
def _(spark, sf):
    df = steps(spark, sf, I.lagged_returns((4, 16), lagged=False))
    return tidy(df.select("asset", "ts", "ret_4", "ret_16"))


@query(
    "w03_rolling_close",
    with_(BARS_D)
    + f"SELECT asset, {ts()}, "
    + ", ".join(rd(full("avg", "close", n), f"mean_{n}") for n in (4, 8, 16))
    + ", "
    + ", ".join(rd(full("stddev_samp", "close", n), f"std_{n}") for n in (4, 8, 16))
    + " FROM b",
)
def _(spark, sf):
    df = steps(spark, sf, I.rolling_close(), bars=A.bars_daily)
    return tidy(df.select("asset", "ts", *[f"{p}_{n}" for p in ("mean", "std") for n in (4, 8, 16)]))


@query(
    "w04_momentum",
    with_(BARS_H)
    + f"SELECT asset, {ts()}, {rd(f'close / lag(close, 4) OVER ({WA}) - 1', 'mom_4')}, {rd(f'close / lag(close, 16) OVER ({WA}) - 1', 'mom_16')} FROM b",
)
def _(spark, sf):
    return tidy(steps(spark, sf, I.momentum()).select("asset", "ts", "mom_4", "mom_16"))


@query("w05_vol_20", with_(BARS_H, LR, VOL) + f"SELECT asset, {ts()}, {rds('vol_20')} FROM v")
def _(spark, sf):
    return tidy(steps(spark, sf, I.volatility()).select("asset", "ts", "vol_20"))


RSI_SQL = """u AS (SELECT asset, ts, k, coalesce(greatest(close - lag(close) OVER (PARTITION BY asset ORDER BY ts), 0), 0) AS up,
        coalesce(greatest(lag(close) OVER (PARTITION BY asset ORDER BY ts) - close, 0), 0) AS dn FROM r),
e(asset, ts, k, g, l) AS (SELECT asset, ts, k, up, dn FROM u WHERE k = 0
  UNION ALL SELECT u.asset, u.ts, u.k, u.up / 14::DOUBLE + e.g * (13::DOUBLE / 14), u.dn / 14::DOUBLE + e.l * (13::DOUBLE / 14)
  FROM e JOIN u ON u.asset = e.asset AND u.k = e.k + 1),
rsi AS (SELECT asset, ts, CASE WHEN k < 13 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi_14 FROM e)"""


@query("w06_rsi", with_(BARS_H, LR, RSI_SQL, recursive=True) + f"SELECT asset, {ts()}, {rds('rsi_14')} FROM rsi")
def _(spark, sf):
    return tidy(I.rsi(B.bar_series(A.bars_hourly(spark, sf))).frame().select("asset", "ts", "rsi_14"))


MACD_SQL = """e(asset, ts, k, f, s) AS (SELECT asset, ts, k, close, close FROM r WHERE k = 0
  UNION ALL SELECT r.asset, r.ts, r.k, r.close * (2::DOUBLE / 13) + e.f * (11::DOUBLE / 13), r.close * (2::DOUBLE / 27) + e.s * (25::DOUBLE / 27)
  FROM e JOIN r ON r.asset = e.asset AND r.k = e.k + 1),
g(asset, ts, k, m, s) AS (SELECT asset, ts, k, f - s, f - s FROM e WHERE k = 25
  UNION ALL SELECT e.asset, e.ts, e.k, e.f - e.s, (e.f - e.s) * 0.2::DOUBLE + g.s * 0.8::DOUBLE
  FROM g JOIN e ON e.asset = g.asset AND e.k = g.k + 1),
macd AS (SELECT e.asset, e.ts, g.m AS macd, CASE WHEN e.k >= 33 THEN g.s END AS macd_signal,
         CASE WHEN e.k >= 33 THEN g.m - g.s END AS macd_hist
  FROM e LEFT JOIN g ON g.asset = e.asset AND g.k = e.k)"""


@query(
    "w07_macd",
    with_(BARS_H, LR, MACD_SQL, recursive=True)
    + f"SELECT asset, {ts()}, {rds('macd', 'macd_signal', 'macd_hist')} FROM macd",
)
def _(spark, sf):
    s = I.macd(B.bar_series(A.bars_hourly(spark, sf)))
    return tidy(s.frame().select("asset", "ts", "macd", "macd_signal", "macd_hist"))


BOLL_SQL = f"""bb0 AS (SELECT asset, ts, close, {full('avg', 'close', 20)} AS mid, {full('stddev_pop', 'close', 20)} AS sd FROM b),
bb AS (SELECT asset, ts, mid + 2 * sd AS bb_upper, mid AS bb_middle, mid - 2 * sd AS bb_lower,
  4 * sd / nullif(mid, 0) * 100 AS bb_width, (close - (mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pct FROM bb0)"""
BB = ("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct")


@query("w08_bollinger", with_(BARS_D, BOLL_SQL) + f"SELECT asset, {ts()}, {rds(*BB)} FROM bb")
def _(spark, sf):
    return tidy(steps(spark, sf, I.bollinger(), bars=A.bars_daily).select("asset", "ts", *BB))


ATR_SQL = """tr AS (SELECT asset, ts, k, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY asset ORDER BY ts)),
        abs(low - lag(close) OVER (PARTITION BY asset ORDER BY ts))) AS tr FROM r),
e(asset, ts, k, y) AS (SELECT asset, max(ts), 13, avg(tr) FROM tr WHERE k <= 13 GROUP BY asset HAVING count(*) = 14
  UNION ALL SELECT tr.asset, tr.ts, tr.k, tr.tr / 14::DOUBLE + e.y * (13::DOUBLE / 14)
  FROM e JOIN tr ON tr.asset = e.asset AND tr.k = e.k + 1),
atr AS (SELECT tr.asset, tr.ts, e.y AS atr_14 FROM tr LEFT JOIN e ON e.asset = tr.asset AND e.k = tr.k)"""


@query("w09_atr", with_(BARS_H, LR, ATR_SQL, recursive=True) + f"SELECT asset, {ts()}, {rds('atr_14')} FROM atr")
def _(spark, sf):
    return tidy(I.atr(B.bar_series(A.bars_hourly(spark, sf))).frame().select("asset", "ts", "atr_14"))


REGIME_SQL = """q AS (SELECT asset, quantile_cont(vol_20, 0.25) AS p25, quantile_cont(vol_20, 0.75) AS p75 FROM v GROUP BY 1),
g AS (SELECT v.asset, v.ts, coalesce(vol_20 < p25, false) AS regime_low_vol,
  coalesce(vol_20 >= p25 AND vol_20 < p75 AND mean_lr_20 > 0, false) AS regime_bull,
  coalesce(vol_20 >= p25 AND vol_20 < p75 AND mean_lr_20 <= 0, false) AS regime_bear,
  coalesce(vol_20 >= p75, false) AS regime_high_vol FROM v JOIN q USING (asset))"""


@query(
    "w10_regimes",
    with_(BARS_D, LR, VOL, REGIME_SQL) + f"SELECT asset, {ts()}, {', '.join(X.REGIMES)} FROM g",
)
def _(spark, sf):
    df = steps(spark, sf, I.volatility(), I.mean_return(), bars=A.bars_daily)
    return tidy(X.regimes(df).select("asset", "ts", *X.REGIMES))


@query(
    "a08_vol_quantiles",
    with_(BARS_D, LR, VOL)
    + f"SELECT asset, {rd('quantile_cont(vol_20, 0.25)', 'p25')}, {rd('quantile_cont(vol_20, 0.75)', 'p75')} FROM v GROUP BY 1",
)
def _(spark, sf):
    return tidy(X.regime_thresholds(steps(spark, sf, I.volatility(), bars=A.bars_daily)))


CROSS_SQL = """c0 AS (SELECT asset, ts, lag(lr, 1) OVER w AS l1, lag(lr, 4) OVER w AS l4, lag(vol_20, 1) OVER w AS v1
  FROM v WINDOW w AS (PARTITION BY asset ORDER BY ts)),
c AS (SELECT b.asset, b.ts, x.l1 AS lead_ret_lag_1, x.l4 AS lead_ret_lag_4, y.v1 AS lead_vol_lag_1 FROM b
  LEFT JOIN c0 x ON b.asset = 'click' AND x.asset = 'view' AND x.ts = b.ts
  LEFT JOIN c0 y ON b.asset = 'signup' AND y.asset = 'purchase' AND y.ts = b.ts)"""


@query(
    "j05_cross_asset",
    with_(BARS_H, LR, VOL, CROSS_SQL) + f"SELECT asset, {ts()}, {rds(*[r.name for r in RULES])} FROM c",
)
def _(spark, sf):
    lagged = steps(spark, sf, I.volatility(), X.leader_lags(RULES))
    names = [r.name for r in RULES]
    return tidy(X.cross_asset(A.bars_hourly(spark, sf).select("asset", "ts"), lagged.select("asset", "ts", *names), RULES))


@query(
    "w11_leader_lags",
    with_(BARS_D, LR, VOL)
    + f"SELECT asset, {ts()}, {rd(f'lag(lr, 1) OVER ({WA})', 'lr_lag_1')}, {rd(f'lag(lr, 4) OVER ({WA})', 'lr_lag_4')}, {rd(f'lag(vol_20, 1) OVER ({WA})', 'vol_lag_1')} FROM v",
)
def _(spark, sf):
    rules = tuple(
        X.CrossRule("*", "*", s, k, n)
        for s, k, n in (("log_ret", 1, "lr_lag_1"), ("log_ret", 4, "lr_lag_4"), ("vol_20", 1, "vol_lag_1"))
    )
    df = steps(spark, sf, I.volatility(), X.leader_lags(rules), bars=A.bars_daily)
    return tidy(df.select("asset", "ts", "lr_lag_1", "lr_lag_4", "vol_lag_1"))


def macro_sql(lag: str) -> str:
    return f"""mf AS (SELECT ts + INTERVAL {lag} AS ts, last_value(dxy IGNORE NULLS) OVER w AS dxy, last_value(vix IGNORE NULLS) OVER w AS vix,
  last_value(spy IGNORE NULLS) OVER w AS spy FROM m WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "j06_asof_macro",
    with_(BARS_H, MACRO, macro_sql("0 DAY"))
    + f"SELECT b.asset, {ts('b.ts')}, {rds('dxy', 'vix', 'spy')} FROM b ASOF LEFT JOIN mf ON b.ts >= mf.ts",
)
def _(spark, sf):
    return tidy(X.join_macro(A.bars_hourly(spark, sf).select("asset", "ts"), A.macro_daily(spark, sf)))


@query(
    "j06_asof_macro_lagged",
    with_(BARS_H, MACRO, macro_sql("1 DAY"))
    + f"SELECT b.asset, {ts('b.ts')}, {rds('dxy', 'vix', 'spy')} FROM b ASOF LEFT JOIN mf ON b.ts >= mf.ts",
)
def _(spark, sf):
    bars = A.bars_hourly(spark, sf).select("asset", "ts")
    return tidy(X.join_macro(bars, A.macro_daily(spark, sf), availability_lag="1 day"))


@query(
    "w12_forward_fill",
    with_(
        BARS_H,
        "g AS (SELECT asset, ts, CASE WHEN volume >= 3 THEN close END AS c, CASE WHEN volume >= 5 THEN high END AS h FROM b)",
    )
    + f"""SELECT asset, {ts()}, {rd(f'last_value(c IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'c')},
    {rd(f'last_value(h IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'h')} FROM g""",
)
def _(spark, sf):
    b = A.bars_hourly(spark, sf).select(
        "asset",
        "ts",
        F.when(F.col("volume") >= 3, F.col("close")).alias("c"),
        F.when(F.col("volume") >= 5, F.col("high")).alias("h"),
    )
    return tidy(W.forward_fill(b, ["asset"], ["ts"], ["c", "h"]))


@query(
    "w29_rolling_overlays",
    with_(BARS_D, LR)
    + f"SELECT asset, {ts()}, {rd(full('avg', 'close', 20), 'ma_20')}, {rd(full('stddev_samp', 'pct', 20) + ' * sqrt(24::DOUBLE) * 100', 'vol_scaled')} FROM r",
)
def _(spark, sf):
    df = steps(spark, sf, I.moving_average(), I.scaled_volatility(), bars=A.bars_daily)
    return tidy(df.select("asset", "ts", "ma_20", "vol_scaled"))


GAPS = (
    "g AS (SELECT asset, ts, close, CASE WHEN volume >= 2 THEN open END AS open, "
    "CASE WHEN volume >= 3 THEN high END AS high, CASE WHEN volume >= 2 THEN low END AS low FROM b)"
)
RECON = f"""o AS (SELECT asset, ts, close, high, low, open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AS raw,
   coalesce(open, lag(close) OVER ({WA}), close) AS open FROM g),
rc AS (SELECT asset, ts, open, coalesce(high, greatest(open, close)) AS high, coalesce(low, least(open, close)) AS low, close,
   CASE WHEN raw THEN 'raw' ELSE 'reconstructed' END AS ohlc_source FROM o)"""


def _gappy(spark, sf):
    return A.bars_hourly(spark, sf).select(
        "asset",
        "ts",
        "close",
        F.when(F.col("volume") >= 2, F.col("open")).alias("open"),
        F.when(F.col("volume") >= 3, F.col("high")).alias("high"),
        F.when(F.col("volume") >= 2, F.col("low")).alias("low"),
    )


@query(
    "w30_ohlc_reconstruct",
    with_(BARS_H, GAPS, RECON) + f"SELECT asset, {ts()}, {rds('open', 'high', 'low', 'close')}, ohlc_source FROM rc",
)
def _(spark, sf):
    return tidy(B.reconstruct(B.bar_series(_gappy(spark, sf))).frame())


@query(
    "w30_reconstructed_share",
    with_(BARS_H, GAPS, RECON)
    + f"SELECT asset, count(*) AS n, {rd('avg((ohlc_source = $$reconstructed$$)::INT)', 'reconstructed_share')} FROM rc GROUP BY 1",
)
def _(spark, sf):
    return tidy(B.reconstructed_share(B.reconstruct(B.bar_series(_gappy(spark, sf))).frame()))


@query(
    "w31_atr_fallback",
    with_(
        BARS_H,
        f"""s AS (SELECT *, CASE WHEN lag(close) OVER ({WA}) > 0 THEN ln(greatest(close, 1e-10::DOUBLE) / greatest(lag(close) OVER ({WA}), 1e-10::DOUBLE)) ELSE 0 END AS st FROM b)""",
    )
    + f"SELECT asset, {ts()}, {rd(f'close * coalesce(stddev_samp(st) {frame(13)}, 0.001::DOUBLE)', 'atr_used')} FROM s",
)
def _(spark, sf):
    s = I.atr_or_fallback(B.bar_series(A.bars_hourly(spark, sf)))
    return tidy(s.frame().select("asset", "ts", "atr_used"))


@query(
    "w31_atr_filled",
    with_(BARS_H, "g AS (SELECT asset, ts, CASE WHEN volume >= 3 THEN high - low ELSE 0 END AS atr_14 FROM b)")
    + f"""SELECT asset, {ts()}, {rd(f'coalesce(last_value(CASE WHEN atr_14 > 0 THEN atr_14 END IGNORE NULLS) OVER ({WA} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)', 'atr_used')} FROM g""",
)
def _(spark, sf):
    b = A.bars_hourly(spark, sf).select(
        "asset", "ts", F.when(F.col("volume") >= 3, F.col("high") - F.col("low")).otherwise(0.0).alias("atr_14")
    )
    return tidy(I.atr_or_fallback(B.bar_series(b)).frame().select("asset", "ts", "atr_used"))


@query(
    "w32_population_vol",
    with_(BARS_H, LR)
    + f"SELECT asset, {ts()}, {rd(f'CASE WHEN count(lr) {frame(19)} >= 2 THEN stddev_pop(lr) {frame(19)} END', 'rolling_vol_20')} FROM r",
)
def _(spark, sf):
    return tidy(steps(spark, sf, I.population_volatility()).select("asset", "ts", "rolling_vol_20"))


TARGETS = f"""t0 AS (SELECT asset, ts, vol_20 AS vol_target_20, ln(lead(close, 1) OVER ({WA}) / close) AS ret_1h,
   ln(lead(close, 4) OVER ({WA}) / close) AS ret_4h FROM v),
t AS (SELECT asset, ts, ret_1h, ret_4h,
  CASE WHEN ret_1h > 0.002 THEN 1 WHEN ret_1h < -0.002 THEN -1 WHEN ret_1h IS NOT NULL THEN 0 END AS direction_1h,
  CASE WHEN ret_4h > 0.002 THEN 1 WHEN ret_4h < -0.002 THEN -1 WHEN ret_4h IS NOT NULL THEN 0 END AS direction_4h,
  CASE WHEN ret_1h IS NOT NULL AND vol_target_20 IS NOT NULL THEN greatest(least(ret_1h / greatest(vol_target_20, 1e-6::DOUBLE), 5), -5) END AS norm_ret_1h,
  CASE WHEN ret_4h IS NOT NULL AND vol_target_20 IS NOT NULL THEN greatest(least(ret_4h / greatest(vol_target_20, 1e-6::DOUBLE), 5), -5) END AS norm_ret_4h,
  vol_target_20 FROM t0 WHERE ret_1h IS NOT NULL OR ret_4h IS NOT NULL)"""


@query("w16_forward_returns", with_(BARS_D, LR, VOL, TARGETS) + f"SELECT asset, {ts()}, {rds('ret_1h', 'ret_4h')} FROM t")
def _(spark, sf):
    return tidy(T.build(A.bars_daily(spark, sf)).select("asset", "ts", "ret_1h", "ret_4h"))


@query(
    "w17_normalised_targets",
    with_(BARS_H, LR, VOL, TARGETS)
    + f"SELECT asset, {ts()}, {rds('norm_ret_1h', 'norm_ret_4h', 'vol_target_20')} FROM t",
)
def _(spark, sf):
    return tidy(T.build(A.bars_hourly(spark, sf)).select("asset", "ts", "norm_ret_1h", "norm_ret_4h", "vol_target_20"))


@query(
    "p14_direction_labels",
    with_(BARS_H, LR, VOL, TARGETS) + f"SELECT asset, {ts()}, direction_1h, direction_4h FROM t",
)
def _(spark, sf):
    return tidy(T.build(A.bars_hourly(spark, sf)).select("asset", "ts", "direction_1h", "direction_4h"))


@query(
    "w18_drop_empty_targets",
    with_(BARS_D, LR, VOL, TARGETS) + "SELECT asset, count(*) AS n, count(ret_4h) AS n_4h FROM t GROUP BY 1",
)
def _(spark, sf):
    t = T.build(A.bars_daily(spark, sf))
    return t.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count("ret_4h").alias("n_4h"))


FEATURE_COLS = ("ret_1", "mean_4", "vol_20")


@query(
    "j01_dataset",
    with_(BARS_D, LR, VOL, TARGETS)
    + f"SELECT v.asset, {ts('v.ts')}, {rd('v.lr', 'ret_1')}, {rds('vol_20')}, {rd('t.ret_4h', 'ret_4h')} FROM v JOIN t ON v.asset = t.asset AND v.ts = t.ts WHERE t.ret_4h IS NOT NULL",
)
def _(spark, sf):
    bars = A.bars_daily(spark, sf)
    f = I.apply(B.bar_series(bars), I.lagged_returns((1,)), I.volatility()).frame()
    return tidy(T.dataset(f, T.build(bars), ["ret_1", "vol_20"], "ret_4h"))


@query(
    "j02_attach_bars",
    with_(BARS_H, LR, VOL) + f"SELECT asset, {ts()}, {rds('vol_20', 'open', 'high', 'low')} FROM v",
)
def _(spark, sf):
    f = steps(spark, sf, I.volatility()).select("asset", "ts", "vol_20")
    return tidy(X.attach_bars(f, A.bars_hourly(spark, sf)))


@query(
    "j13_target_audit",
    with_(BARS_D, LR, VOL, TARGETS)
    + """SELECT asset, count(ret_1h) AS n_compared, coalesce(max(0.125) FILTER (ret_1h IS NOT NULL AND asset < '3' AND day(ts) = 5), 0)::DOUBLE AS max_abs_diff,
    count(*) FILTER (ret_1h IS NOT NULL AND asset < '3' AND day(ts) = 5) = 0 AS passed FROM t GROUP BY 1""",
)
def _(spark, sf):
    # some assets' stored targets are off
    bars = A.bars_daily(spark, sf)
    off = F.when((F.col("asset") < "3") & (F.dayofmonth("ts") == 5), 0.125).otherwise(0.0)
    return tidy(T.audit(bars, T.build(bars).withColumn("ret_1h", F.col("ret_1h") + off)))


@query(
    "l03_audit_sample",
    with_(
        BARS_D,
        f"""k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY md5('42:' || asset || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S')) DESC, ts DESC) AS rn FROM b)""",
    )
    + f"SELECT asset, {ts()}, {rds('close')} FROM k WHERE rn <= 10",
)
def _(spark, sf):
    return tidy(T.audit_sample(A.bars_daily(spark, sf).select("asset", "ts", "close"), 10, "42"))


@query(
    "p19_bar_quality",
    with_(BARS_H, GAPS)
    + f"""SELECT asset, count(*) AS n_rows, CASE WHEN asset = 'error' THEN 'low,volume' ELSE '' END AS empty_columns,
    {rd('(4 - count(open)::DOUBLE / count(*) - count(high)::DOUBLE / count(*) - count(low)::DOUBLE / count(*) - count(close)::DOUBLE / count(*)) / 4', 'null_share')},
    (4 - count(open)::DOUBLE / count(*) - count(high)::DOUBLE / count(*) - count(low)::DOUBLE / count(*) - count(close)::DOUBLE / count(*)) / 4 > 0.1 AS warn,
    asset <> 'error' AS ok FROM (SELECT * REPLACE (CASE WHEN asset <> 'error' THEN low END AS low) FROM g) GROUP BY 1""",
)
def _(spark, sf):
    # one asset lacks two columns
    there = F.col("asset") != "error"
    return tidy(B.quality(_gappy(spark, sf).withColumns({"low": F.when(there, F.col("low")), "volume": F.when(there, 1.0)})))


@query(
    "u02_time_spine",
    with_(BARS_H) + f"SELECT DISTINCT {ts()} FROM (SELECT ts FROM b UNION ALL SELECT o_orderdate FROM orders)",
)
def _(spark, sf):
    return tidy(W.distinct_times(A.bars_hourly(spark, sf), A.bars_daily(spark, sf)))


@query(
    "w24_latest_n",
    with_(BARS_D, f"k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS rn FROM b)")
    + f"SELECT asset, {ts()}, {rds('close')} FROM k WHERE rn <= 1440",
)
def _(spark, sf):
    return tidy(W.latest_n(A.bars_daily(spark, sf).select("asset", "ts", "close"), ["asset"], "ts", 1440))


@query(
    "w20_chronological_split",
    with_(
        BARS_D,
        f"n AS (SELECT asset, ts, row_number() OVER ({WA}) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM b)",
    )
    + f"""SELECT asset, {ts()}, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM n""",
)
def _(spark, sf):
    return tidy(W.split(A.bars_daily(spark, sf).select("asset", "ts"), ["asset"], ["ts"]))


@query(
    "w28_dedup_first",
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) "
    f"SELECT user_id, event_id, {rds('value')} FROM k WHERE rn = 1",
)
def _(spark, sf):
    e = A.table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return tidy(W.dedup(e, ["user_id", "hour"], ["ts", "event_id"]).select("user_id", "event_id", "value"))


@query(
    "w28_dedup_last",
    "WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) "
    f"SELECT o_custkey, o_orderpriority, o_orderkey, {rds('o_totalprice')} FROM k WHERE rn = 1",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    out = W.dedup(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], keep="last")
    return tidy(out.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"))


def feature_target_matrix(spark, sf):
    bars = A.bars_hourly(spark, sf)
    feats = X.build(bars, macro=A.macro_daily(spark, sf), rules=RULES)
    return tidy(feats.join(T.build(bars), ["asset", "ts"]))


@query(
    "feature_matrix",
    with_(
        BARS_H, LR, VOL, MACRO, macro_sql("0 DAY"), CROSS_SQL, REGIME_SQL, BOLL_SQL,
        RSI_SQL.replace("e(asset", "re(asset").replace("e.g", "re.g").replace("e.l", "re.l").replace("FROM e", "FROM re").replace("e.asset", "re.asset").replace("e.k", "re.k"),
        MACD_SQL.replace("g(asset", "mg(asset").replace("g.m", "mg.m").replace("g.s", "mg.s").replace("FROM g", "FROM mg").replace("JOIN g ON", "JOIN mg ON").replace("g.asset", "mg.asset").replace("g.k", "mg.k"),
        ATR_SQL.replace("e(asset", "ae(asset").replace("e.y", "ae.y").replace("FROM e", "FROM ae").replace("JOIN e ON", "JOIN ae ON").replace("e.asset", "ae.asset").replace("e.k", "ae.k"),
        TARGETS,
        recursive=True,
    )
    + f"""SELECT v.asset, {ts('v.ts')}, {rds('vol_20', 'rsi_14', 'macd', 'macd_signal', 'macd_hist', *BB, 'atr_14', 'dxy', 'vix', 'spy')},
    {rds(*[r.name for r in RULES])}, {', '.join(X.REGIMES)}, {rds('ret_1h', 'ret_4h', 'norm_ret_4h')}
    FROM v JOIN t ON t.asset = v.asset AND t.ts = v.ts JOIN rsi ON rsi.asset = v.asset AND rsi.ts = v.ts
    JOIN macd ON macd.asset = v.asset AND macd.ts = v.ts JOIN bb ON bb.asset = v.asset AND bb.ts = v.ts
    JOIN atr ON atr.asset = v.asset AND atr.ts = v.ts JOIN c ON c.asset = v.asset AND c.ts = v.ts
    JOIN g ON g.asset = v.asset AND g.ts = v.ts ASOF LEFT JOIN mf ON v.ts >= mf.ts""",
)
def _(spark, sf):
    return feature_target_matrix(spark, sf).select(
        "asset", "ts", "vol_20", "rsi_14", "macd", "macd_signal", "macd_hist", *BB, "atr_14", "dxy", "vix", "spy",
        *[r.name for r in RULES], *X.REGIMES, "ret_1h", "ret_4h", "norm_ret_4h",
    )
