"""Trade rules, accounting, trade analytics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import columns as C
from barflow.functions.output import tidy
from barflow.operators import bars as B
from barflow.operators import correlation as CR
from barflow.operators import evaluation as E
from barflow.operators import indicators as I
from barflow.operators import reports as R
from barflow.operators import trades as TR
from barflow.operators import windows as W
from barflow.plans.oracle import BARS_D, BARS_H, FORECASTS, LR, TRADES, VOL, WA, frame, rd, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A

TIES = ["exit_time", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
TIE_SQL = ", ".join(TIES)
T_SQL = with_(TRADES)

# ---- signals -----------------------------------------------------------------

THRESHOLDS = {"CLICK": 0.0, "VIEW": 0.02, "SIGNUP": 0.05, "ERROR": 0.1}
SIGNALS = f"""g0 AS (SELECT asset, ts, 0.1::DOUBLE * lr AS p, abs(0.1::DOUBLE * lr) AS ss, lr AS ret_1,
  CASE WHEN count(lr) OVER w = 4 THEN sum(lr) OVER w END AS ret_4 FROM r
  WINDOW w AS ({WA} ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING)),
g AS (SELECT *, CASE upper(asset) WHEN 'VIEW' THEN 0.02 WHEN 'SIGNUP' THEN 0.05 WHEN 'ERROR' THEN 0.1 ELSE 0 END::DOUBLE AS thr FROM g0 WHERE p IS NOT NULL)"""


def _signals(spark, sf):
    s = I.apply(B.bar_series(A.bars_hourly(spark, sf)), I.lagged_returns((1, 4)))
    p = F.col("ret_1") * 0.1
    df = s.frame().filter("ret_1 is not null")
    return df.withColumns({"predicted_log_return": p, "signal_strength": F.abs(p)})


@query(
    "p20_entry_eligibility",
    with_(BARS_H, LR, SIGNALS)
    + f"""SELECT asset, {ts()},
    (thr <= 0 OR ss <= 0 OR ss >= thr) AND coalesce(thr <= 0 OR p = 0 OR (p > thr AND CASE WHEN ret_4 = 0 THEN ret_1 ELSE ret_4 END >= -0.0005::DOUBLE), false) AS may_long,
    (thr <= 0 OR ss <= 0 OR ss >= thr) AND coalesce(thr <= 0 OR p = 0 OR (p < -thr AND CASE WHEN ret_4 = 0 THEN ret_1 ELSE ret_4 END <= 0.0005::DOUBLE), false) AS may_short FROM g""",
)
def _(spark, sf):
    out = TR.eligible(_signals(spark, sf), THRESHOLDS)
    return tidy(out.select("asset", "ts", "may_long", "may_short"))


@query(
    "p21_risk_cap",
    """WITH z AS (SELECT event_id, ['BTC', 'ETH', 'GOLD', 'OIL', 'XAU'][(event_id % 5 + 1)::INT] AS asset, (event_id % 3)::INT AS r, value / 10000 AS s FROM events)
    SELECT event_id, least(CASE WHEN asset = 'ETH' AND r = 2 AND s < 0.005::DOUBLE THEN 1 WHEN asset IN ('GOLD', 'OIL') AND r = 2 THEN 0
      WHEN asset IN ('GOLD', 'OIL') AND r = 1 AND s < 0.006::DOUBLE THEN 0 ELSE r END,
      CASE asset WHEN 'ETH' THEN 1 WHEN 'GOLD' THEN 0 WHEN 'OIL' THEN 0 ELSE 2 END)::INT AS risk FROM z""",
)
def _(spark, sf):
    names = F.array(*[F.lit(a) for a in ("BTC", "ETH", "GOLD", "OIL", "XAU")])
    e = A.table(spark, sf, "events").select(
        "event_id",
        names[(F.col("event_id") % 5).cast("int")].alias("asset"),
        (F.col("event_id") % 3).cast("int").alias("r"),
        (F.col("value") / 10000).alias("s"),
    )
    return e.select("event_id", TR.cap_risk(F.col("asset"), F.col("r"), F.col("s")).cast("int").alias("risk"))


@query(
    "p22_decode_actions",
    f"""WITH z AS (SELECT o_orderkey, (o_orderkey % 4)::INT AS d, (o_custkey % 3)::INT AS s, (o_orderkey // 4 % 3)::INT AS r FROM orders),
    n AS (SELECT *, ['HOLD', 'FLAT', 'LONG', 'SHORT'][d + 1] AS dn, ['SMALL', 'MEDIUM', 'LARGE'][s + 1] AS sn, ['CONSERVATIVE', 'BALANCED', 'AGGRESSIVE'][r + 1] AS rn FROM z)
    SELECT o_orderkey, CASE WHEN d < 2 THEN dn ELSE dn || '_' || sn || '_' || rn END AS action_name,
      CASE d WHEN 0 THEN 'Hold' WHEN 1 THEN 'Flat' ELSE left(dn, 1) || '-' || ['Small', 'Med', 'Large'][s + 1] || '-' || ['Cons', 'Bal', 'Agg'][r + 1] END AS action_short,
      [0.25::DOUBLE, 0.5, 1][s + 1] AS position_fraction, [1::DOUBLE, 1.5, 2][r + 1] AS leverage_used, [1::DOUBLE, 1.5, 2][r + 1] AS sl_mult, [1.5::DOUBLE, 2.5, 4][r + 1] AS tp_mult FROM n""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 4).cast("int").alias("direction"),
        (F.col("o_custkey") % 3).cast("int").alias("size"),
        (F.floor(F.col("o_orderkey") / 4) % 3).cast("int").alias("risk"),
    )
    cols = ("action_name", "action_short", "position_fraction", "leverage_used", "sl_mult", "tp_mult")
    return tidy(TR.decode(o).select("o_orderkey", *cols))


# ---- accounting --------------------------------------------------------------

BOOK = """k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS side,
  l_extendedprice AS entry_price, l_extendedprice * (1 + l_discount - l_tax) AS exit_price, l_tax AS transaction_cost_total,
  0.25::DOUBLE AS position_fraction, 1 + l_discount AS leverage_used, 10000::DOUBLE AS portfolio_value_before FROM lineitem),
ac AS (SELECT *, portfolio_value_before * position_fraction * leverage_used AS notional_value,
  CASE WHEN side = 'LONG' THEN 1 ELSE -1 END * (exit_price - entry_price) / entry_price * portfolio_value_before * position_fraction * leverage_used AS gross_pnl FROM k)"""


def _book(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("side"),
        F.col("l_extendedprice").alias("entry_price"),
        (F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("exit_price"),
        F.col("l_tax").alias("transaction_cost_total"),
        F.lit(0.25).alias("position_fraction"),
        (1 + F.col("l_discount")).alias("leverage_used"),
        F.lit(10000.0).alias("portfolio_value_before"),
    )


@query(
    "p23_price_levels",
    with_(BARS_H)
    + f"""SELECT asset, {ts()}, {rd("close - s * 1.5 * (high - low)", 'sl_price')}, {rd("close + s * 2.5 * (high - low)", 'tp_price')}, {rd('2.5::DOUBLE / 1.5', 'risk_reward_ratio')}
    FROM (SELECT *, CASE WHEN close >= open THEN 1 ELSE -1 END AS s FROM b)""",
)
def _(spark, sf):
    return tidy(_entries(spark, sf).select("asset", "ts", "sl_price", "tp_price", "risk_reward_ratio"))


@query(
    "p24_trade_accounting",
    with_(BOOK)
    + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rds('notional_value', 'gross_pnl')}, {rd('gross_pnl - transaction_cost_total', 'net_pnl')},
    {rd('(gross_pnl - transaction_cost_total) / notional_value', 'return_pct')}, {rd('10000 + gross_pnl - transaction_cost_total', 'portfolio_value_after')} FROM ac""",
)
def _(spark, sf):
    cols = ("notional_value", "gross_pnl", "net_pnl", "return_pct", "portfolio_value_after")
    return tidy(TR.account(_book(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols))


@query(
    "p25_sign_errors",
    with_(BOOK)
    + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, side, {rd('-gross_pnl', 'gross_pnl')} FROM ac WHERE l_linenumber % 3 = 1 AND gross_pnl < 0 AND exit_price <> entry_price",
)
def _(spark, sf):
    # the profit's sign is turned round in a third of the trades: of those the losing ones are errors
    turned = F.when(F.col("l_linenumber") % 3 == 1, -F.col("gross_pnl")).otherwise(F.col("gross_pnl"))
    wrong = TR.account(_book(spark, sf)).withColumn("gross_pnl", turned)
    return tidy(TR.sign_errors(wrong).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "side", "gross_pnl"))


# ---- exits and paths -----------------------------------------------------------


def _entries(spark, sf):
    side = F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)
    b = A.bars_hourly(spark, sf).withColumns(
        {
            "side": side, "entry_price": F.col("close"), "atr": F.col("high") - F.col("low"),
            "sl_mult": F.lit(1.5), "tp_mult": F.lit(2.5),
        }
    )
    return TR.price_levels(b)


TOUCH = """i AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS k, CASE WHEN close >= open THEN 1 ELSE -1 END AS s FROM b),
en AS (SELECT asset, ts, k, s, close AS e, close - s * 1.5 * (high - low) AS sl, close + s * 2.5 * (high - low) AS tp FROM i),
pt AS (SELECT en.*, x.k AS xk, x.ts AS xts, x.close AS xc, CASE WHEN en.s > 0 THEN x.low <= sl ELSE x.high >= sl END AS st,
  CASE WHEN en.s > 0 THEN x.high >= tp ELSE x.low <= tp END AS tk FROM en JOIN i x ON x.asset = en.asset AND x.k BETWEEN en.k + 1 AND en.k + 48),
fx AS (SELECT asset, ts, min(xk) FILTER (st OR tk) AS hk, max(xk) AS lk, count(*) AS n FROM pt GROUP BY 1, 2),
ex AS (SELECT en.asset, en.ts AS entry_time, en.s AS side, en.e AS entry_price, pt.xts AS exit_time, pt.xc AS exit_price, (pt.xk - en.k)::INT AS holding_bars,
  CASE WHEN hk IS NOT NULL AND pt.st THEN 'SL' WHEN hk IS NOT NULL THEN 'TP' WHEN n = 48 THEN 'MAX_HOLD' WHEN n > 0 THEN 'END' END AS exit_reason
  FROM en LEFT JOIN fx ON fx.asset = en.asset AND fx.ts = en.ts LEFT JOIN pt ON pt.asset = en.asset AND pt.ts = en.ts AND pt.xk = coalesce(hk, lk))"""


@query(
    "j14_first_touch",
    with_(BARS_H, TOUCH)
    + f"SELECT asset, {ts('entry_time')}, side, {rds('entry_price')}, {ts('exit_time')}, {rds('exit_price')}, holding_bars, exit_reason FROM ex",
)
def _(spark, sf):
    return tidy(TR.first_touch(A.bars_hourly(spark, sf), _entries(spark, sf)))


@query(
    "j15_trade_paths",
    with_(
        BARS_H,
        TOUCH,
        """ps AS (SELECT ex.asset, entry_time, any_value(side) AS side, any_value(entry_price) AS e, count(*) - 1 AS holding_bars, max(b.high) AS hi, min(b.low) AS lo,
          max(b.close) AS top, min(b.close) AS bot FROM ex JOIN b ON b.asset = ex.asset AND b.ts BETWEEN entry_time AND exit_time GROUP BY 1, 2)""",
    )
    + f"""SELECT asset, {ts('entry_time')}, holding_bars, {rd('hi', 'high_during_trade')}, {rd('lo', 'low_during_trade')},
    {rd('greatest(CASE WHEN side > 0 THEN top / e - 1 ELSE 1 - bot / e END, 0)', 'max_favorable_excursion')},
    {rd('least(CASE WHEN side > 0 THEN bot / e - 1 ELSE 1 - top / e END, 0)', 'max_adverse_excursion')} FROM ps""",
)
def _(spark, sf):
    bars = A.bars_hourly(spark, sf)
    t = TR.first_touch(bars, _entries(spark, sf)).filter("exit_time is not null")
    t = t.withColumn("side", F.when(F.col("side") > 0, "LONG").otherwise("SHORT")).drop("holding_bars")
    out = TR.path_stats(t, bars, ["asset", "entry_time"])
    cols = ("holding_bars", "high_during_trade", "low_during_trade", "max_favorable_excursion", "max_adverse_excursion")
    return tidy(out.select("asset", "entry_time", *cols))


# ---- trade analytics -------------------------------------------------------------

_AGG = """count(*) AS n_trades, sum(net_pnl) AS net_pnl, avg((net_pnl > 0)::INT) AS win_rate, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS gross_profit,
  abs(coalesce(sum(net_pnl) FILTER (net_pnl {op} 0), 0)) AS gross_loss, sum(transaction_cost_total) AS total_cost, avg(risk_reward_ratio) AS avg_risk_reward, avg(holding_bars) AS avg_holding"""
_COLS = ("n_trades", "net_pnl", "win_rate", "gross_profit", "gross_loss", "total_cost", "avg_risk_reward", "avg_holding", "profit_factor", "return_pct")


def _summary_sql(op, group):
    money = rds("net_pnl", "gross_profit", "gross_loss", "total_cost", digits=4)
    return (
        T_SQL
        + f", g AS (SELECT exit_reason, {_AGG.format(op=op)} FROM t GROUP BY {group}) SELECT exit_reason, n_trades, {money}, "
        + f"{rds('win_rate', 'avg_risk_reward', 'avg_holding', digits=8)}, {rd('gross_profit / nullif(gross_loss, 0)', 'profit_factor')}, {rd('net_pnl / 10000 * 100', 'return_pct', 4)} FROM g"
    )


MONEY = {c: 4 for c in ("net_pnl", "gross_profit", "gross_loss", "total_cost", "return_pct")}
MONEY |= {c: 8 for c in ("win_rate", "avg_risk_reward", "avg_holding")}


@query("a25_trade_summary", _summary_sql("<=", "ROLLUP (exit_reason)"))
def _(spark, sf):
    return tidy(TR.summary(A.trades(spark, sf), ["exit_reason"], total=True), **MONEY)


@query("a25_trade_summary_strict", _summary_sql("<", "exit_reason"))
def _(spark, sf):
    return tidy(TR.summary(A.trades(spark, sf), ["exit_reason"], zero_loss="null"), **MONEY)


@query(
    "a26_pnl_by_category",
    T_SQL + f"SELECT exit_reason, {rd('avg(net_pnl)', 'mean_pnl')}, count(*) AS n FROM t GROUP BY 1",
)
def _(spark, sf):
    return tidy(TR.by_category(A.trades(spark, sf), ["exit_reason"]).select("exit_reason", "mean_pnl", "n"))


@query(
    "a27_win_rate_by_category",
    T_SQL + f"SELECT side, {rd('avg((net_pnl > 0)::INT)', 'win_rate')}, count(*) AS n FROM t GROUP BY 1",
)
def _(spark, sf):
    return tidy(TR.by_category(A.trades(spark, sf), ["side"]).select("side", "win_rate", "n"))


PARTS = ("net_pnl", "transaction_cost_total", "risk_reward_ratio")


@query(
    "a28_component_means",
    T_SQL
    + " UNION ALL ".join(f"SELECT side, '{c}' AS component, {rd(f'avg({c})', 'value')} FROM t GROUP BY 1" for c in PARTS),
)
def _(spark, sf):
    return tidy(TR.component_means(A.trades(spark, sf), ["side"], PARTS))


@query(
    "a28_component_totals",
    T_SQL
    + " UNION ALL ".join(f"SELECT side, '{c}' AS component, {rd(f'sum({c})', 'value', 3)} FROM t GROUP BY 1" for c in PARTS),
)
def _(spark, sf):
    return tidy(TR.component_means(A.trades(spark, sf), ["side"], PARTS, how="sum"), digits=3)


for _col in ("exit_reason", "side"):

    def _counts(spark, sf, col=_col):
        return R.value_counts(A.trades(spark, sf), col)

    query(f"a24_trade_{_col}", T_SQL + f"SELECT {_col} AS value, count(*) AS n FROM t GROUP BY 1")(_counts)


@query(
    "p18_trade_filters",
    T_SQL
    + f"SELECT l_orderkey, l_linenumber, {rds('net_pnl')} FROM t WHERE side = 'O' AND exit_reason IN ('A', 'N') AND net_pnl > 0 ORDER BY {TIE_SQL} LIMIT 100",
)
def _(spark, sf):
    out = TR.filtered(A.trades(spark, sf), sides=["O"], exits=["A", "N"], profitable=True, first=100, order=TIES)
    return tidy(out.select("l_orderkey", "l_linenumber", "net_pnl"))


@query(
    "w27_cumulative_pnl",
    T_SQL
    + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rd(f'sum(net_pnl) OVER (PARTITION BY exit_reason ORDER BY {TIE_SQL} ROWS UNBOUNDED PRECEDING)', 'cum_net_pnl', 5)} FROM t",
)
def _(spark, sf):
    out = TR.cumulative(A.trades(spark, sf).select("exit_reason", *TIES, "net_pnl"), ["exit_reason"], TIES, ["net_pnl"])
    return tidy(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cum_net_pnl"), digits=5)


CURVE = f"""c AS (SELECT *, 1000000 + sum(net_pnl) OVER (PARTITION BY exit_reason ORDER BY {TIE_SQL} ROWS UNBOUNDED PRECEDING) AS pv FROM t),
d AS (SELECT *, max(pv) OVER (PARTITION BY exit_reason ORDER BY {TIE_SQL} ROWS UNBOUNDED PRECEDING) AS peak FROM c)"""


def _curve(spark, sf, **more):
    # rows are written and sorted: with the columns of the curve alone
    t = A.trades(spark, sf).select("exit_reason", *TIES, "net_pnl")
    s = W.arrange(t, ["exit_reason"], TIES).running(_c=("sum", F.col("net_pnl")), **more)
    return s.map(lambda d: d.withColumn("portfolio_value", F.col("_c") + 1_000_000).drop("_c"))


@query(
    "w26_drawdown",
    with_(TRADES, CURVE)
    + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rd('peak', 'peak', 5)}, {rd('(pv - peak) / greatest(peak, 1e-9) * 100', 'drawdown_pct')} FROM d",
)
def _(spark, sf):
    # sum and peak in one call: one pass over the rows; adding the capital keeps the order of sums, so the peak is the same
    s = _curve(spark, sf, peak=("peak", F.col("net_pnl"))).map(lambda d: d.withColumn("peak", F.col("peak") + 1_000_000))
    out = s.frame().withColumn(
        "drawdown_pct", (F.col("portfolio_value") - F.col("peak")) / F.greatest("peak", F.lit(1e-9)) * 100
    )
    return tidy(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "peak", "drawdown_pct"), peak=5)


@query(
    "w26_max_drawdown",
    with_(BARS_D, f"d AS (SELECT asset, close, max(close) OVER ({WA} ROWS UNBOUNDED PRECEDING) AS peak FROM b)")
    + f"SELECT asset, {rd('min((close - peak) / greatest(peak, 1e-9) * 100)', 'max_drawdown_pct')} FROM d GROUP BY 1",
)
def _(spark, sf):
    return tidy(TR.max_drawdown(A.bars_daily(spark, sf), ["asset"], ["ts"], "close"))


@query(
    "w33_side_bias",
    T_SQL
    + f""", w AS (SELECT *, count(*) OVER q AS n_recent, avg((side = 'F')::INT) OVER q AS side_ratio FROM t WINDOW q AS (PARTITION BY exit_reason ORDER BY {TIE_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n_recent, {rds('side_ratio')}, coalesce(n_recent >= 3 AND side_ratio > 0.7::DOUBLE AND risk_reward_ratio < 0.05::DOUBLE, false) AS blocked FROM w""",
)
def _(spark, sf):
    out = TR.side_bias(
        A.trades(spark, sf).select("exit_reason", *TIES, "side", "risk_reward_ratio"), ["exit_reason"], TIES, side="F", strength="risk_reward_ratio", override=0.05
    )
    return tidy(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_recent", "side_ratio", "blocked"))


@query(
    "w34_step_columns",
    with_(BARS_D, "s AS (SELECT asset, ts, close, CASE WHEN close >= open THEN 0.5 ELSE -0.25 END::DOUBLE AS p FROM b)")
    + f"""SELECT asset, {ts()}, {rd(f'coalesce(close / lag(close) OVER ({WA}) - 1, 0)', 'step_return')}, {rd(f'abs(p - coalesce(lag(p) OVER ({WA}), 0))', 'turnover')},
    {rd(f'abs(p - coalesce(lag(p) OVER ({WA}), 0)) * 0.001::DOUBLE * coalesce(lag(close) OVER ({WA}), close)', 'transaction_cost', 8)} FROM s""",
)
def _(spark, sf):
    b = A.bars_daily(spark, sf).withColumn(
        "effective_position", F.when(F.col("close") >= F.col("open"), 0.5).otherwise(-0.25)
    )
    out = TR.step_columns(b, ["asset"], ["ts"], "close")
    return tidy(out.select("asset", "ts", "step_return", "turnover", "transaction_cost"), transaction_cost=8)


@query(
    "a39_reconciliation",
    T_SQL
    + f"""SELECT exit_reason, {rd("sum(net_pnl) + 2 * count(*) FILTER (exit_reason = 'R' AND l_linenumber = 7)", 'trade_pnl', 5)}, {rd('sum(net_pnl)', 'portfolio_pnl', 5)},
    0.0 - 2 * count(*) FILTER (exit_reason = 'R' AND l_linenumber = 7)::DOUBLE AS difference, count(*) FILTER (exit_reason = 'R' AND l_linenumber = 7) = 0 AS ok FROM t GROUP BY 1""",
)
def _(spark, sf):
    steps = _curve(spark, sf).frame().withColumn("at", F.struct(*TIES))
    # some trades of one kind were booked with too much profit
    over = F.when((F.col("exit_reason") == "R") & (F.col("l_linenumber") == 7), 2.0).otherwise(0.0)
    booked = A.trades(spark, sf).withColumn("net_pnl", F.col("net_pnl") + over)
    out = TR.reconcile(booked, steps, ["exit_reason"], ts="at", capital=1_000_000.0)
    return tidy(out, difference=3, trade_pnl=5, portfolio_pnl=5)


# ---- reports -----------------------------------------------------------------------


@query(
    "a03_row_counts",
    with_(BARS_H, LR, VOL, FORECASTS)
    + "SELECT asset, max(p) AS prices, max(e) AS ticks, max(q) AS predictions FROM (SELECT asset, count(*) AS p, 0 AS e, 0 AS q FROM b GROUP BY 1 UNION ALL SELECT event_type, 0, count(*), 0 FROM events GROUP BY 1 UNION ALL SELECT asset, 0, 0, count(*) FROM f GROUP BY 1) GROUP BY 1",
)
def _(spark, sf):
    return R.row_counts(
        {"prices": A.bars_hourly(spark, sf), "ticks": A.ticks(spark, sf), "predictions": A.forecasts(spark, sf)}
    )


@query("a04_group_counts", T_SQL + "SELECT exit_reason, side, count(*) AS n FROM t GROUP BY 1, 2")
def _(spark, sf):
    return R.group_counts(A.trades(spark, sf), ["exit_reason", "side"])


@query(
    "a05_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return R.duplicates(A.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "a06_time_ranges",
    with_(BARS_H)
    + f"SELECT 'bars' AS \"table\", asset, {ts('min(ts)', 'first')}, {ts('max(ts)', 'last')} FROM b GROUP BY asset UNION ALL SELECT 'ticks', event_type, {ts('min(ts)', 'first')}, {ts('max(ts)', 'last')} FROM events GROUP BY event_type",
)
def _(spark, sf):
    return tidy(R.time_range({"bars": A.bars_hourly(spark, sf), "ticks": A.ticks(spark, sf)}))


@query(
    "a07_forecast_stats",
    with_(BARS_H, LR, VOL, FORECASTS)
    + " UNION ALL ".join(
        f"SELECT asset, '{n}' AS \"column\", {rd(f'avg({c})', 'mean')}, {rd(f'stddev_samp({c})', 'std')}, {rd(f'min({c})', 'min')}, {rd(f'max({c})', 'max')} FROM f GROUP BY 1"
        for n, c in (("predicted_log_return", "p"), ("signal_strength", "abs(p)"))
    ),
)
def _(spark, sf):
    f = E.derived(A.forecasts(spark, sf))
    return tidy(R.column_stats(f, ["asset"], ["predicted_log_return", "signal_strength"]))


TYPES = ("click", "error", "purchase", "signup", "view")
CORR_SQL = (
    "w AS (SELECT ts, " + ", ".join(f"avg(close) FILTER (asset = '{t}') AS {t}" for t in TYPES) + " FROM b GROUP BY 1), "
    "ff AS (SELECT ts, "
    + ", ".join(f"last_value({t} IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {t}" for t in TYPES)
    + " FROM w), pc AS (SELECT "
    + ", ".join(f"{t} / lag({t}) OVER (ORDER BY ts) - 1 AS {t}" for t in TYPES)
    + " FROM ff)"
)


A19 = with_(BARS_H, CORR_SQL) + " UNION ALL ".join(
    f"SELECT '{a}' AS asset_a, '{b}' AS asset_b, {rd(f'round(corr({a}, {b}), 3)', 'corr')} FROM pc" for a in TYPES for b in TYPES
)


@query("a19_correlation", A19)
def _(spark, sf):
    return tidy(R.return_correlation(A.bars_hourly(spark, sf), TYPES))


@query("a19_correlation_all", A19)
def _(spark, sf):
    return tidy(CR.correlations(A.bars_hourly(spark, sf)))


@query(
    "a32_null_profile",
    with_(BARS_H, LR, VOL)
    + " UNION ALL ".join(
        f"SELECT asset, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, {rd(f'1 - count({c})::DOUBLE / count(*)', 'null_share')}, count({c}) = 0 AS all_null FROM v GROUP BY 1"
        for c in ("lr", "vol_20", "close")
    ),
)
def _(spark, sf):
    s = I.apply(B.bar_series(A.bars_hourly(spark, sf)), I.lagged_returns((1,)), I.volatility())
    df = s.frame().withColumnRenamed("ret_1", "lr")
    return tidy(R.null_profile(df, ["asset"], ["lr", "vol_20", "close"]))


for _name, _ddof, _sd in (("a38_buy_and_hold", 0, "stddev_pop"), ("a38_buy_and_hold_sample", 1, "stddev_samp")):

    def _hold(spark, sf, ddof=_ddof):
        return tidy(R.buy_and_hold(A.bars_daily(spark, sf), ddof=ddof))

    query(
        _name,
        with_(BARS_D, LR, f"d AS (SELECT *, max(close) OVER ({WA} ROWS UNBOUNDED PRECEDING) AS peak FROM r)")
        + f"""SELECT asset, count(*) AS n, {rd('arg_max(close, ts) / arg_min(close, ts) - 1', 'cumulative_return')}, {rd(f'avg(pct) / {_sd}(pct) * sqrt(8760::DOUBLE)', 'sharpe_ratio')},
        {rd('-min((close - peak) / peak)', 'max_drawdown')} FROM d GROUP BY 1""",
    )(_hold)


@query(
    "a40_trade_table_check",
    T_SQL
    + f"SELECT exit_reason, count(*) AS n, {ts('min(exit_time)', 'first')}, {ts('max(exit_time)', 'last')}, {rd('avg((net_pnl > 0)::INT)', 'win_rate')} FROM t GROUP BY 1",
)
def _(spark, sf):
    return tidy(R.trade_table_check(A.trades(spark, sf), ["side", "net_pnl", "exit_reason"], ["exit_reason"]))


@query(
    "w22_latest_row",
    with_(BARS_H) + f"SELECT asset, {rd('arg_max(close, ts)', 'close')}, {rd('arg_max(CASE WHEN volume >= 5 THEN high END, CASE WHEN volume >= 5 THEN ts END)', 'big')} FROM b GROUP BY 1",
)
def _(spark, sf):
    b = A.bars_hourly(spark, sf).withColumn("big", F.when(F.col("volume") >= 5, F.col("high")))
    return tidy(W.latest(b, ["asset"], "ts", ["close", "big"]))


@query(
    "w23_snapshot",
    with_(BARS_H, LR, VOL, FORECASTS)
    + f""", n AS (SELECT *, lag(close) OVER ({WA}) AS c1, lag(close, 24) OVER ({WA}) AS c24, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS rn FROM b),
    m AS (SELECT asset, avg(abs(p - a)) AS mae, avg((sign(p) = sign(a))::INT) AS dir_acc, arg_max(p, ts) AS lp FROM f GROUP BY 1)
    SELECT n.asset, {rd('close', 'price')}, {rd('(close / c1 - 1) * 100', 'ret_1_pct')}, {rd('(close / c24 - 1) * 100', 'ret_24_pct')}, {rds('mae', 'dir_acc')}, {rd('abs(lp)', 'signal_strength')},
      CASE WHEN lp > 0.002 THEN 'UP' WHEN lp < -0.002 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM n JOIN m USING (asset) WHERE rn = 1""",
)
def _(spark, sf):
    f = E.derived(A.forecasts(spark, sf))
    return tidy(R.snapshot(A.bars_hourly(spark, sf), f, E.metrics(f, ["asset"])))


@query(
    "w25_normalised_price",
    with_(BARS_D) + f"SELECT asset, {ts()}, {rd(f'close / first_value(close) OVER ({WA}) * 100', 'normalised')} FROM b",
)
def _(spark, sf):
    return tidy(R.normalised_price(A.bars_daily(spark, sf)).select("asset", "ts", "normalised"))


@query("p01_range_filter", f"SELECT event_id, {rds('value')} FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
def _(spark, sf):
    from barflow.sources.readers import between

    e = A.table(spark, sf, "events")
    return tidy(e.filter(between("ts", "2024-01-05", "2024-01-20 12:00:00")).select("event_id", "value"))


@query("p02_asset_filter", with_(BARS_H) + f"SELECT asset, {ts()}, {rds('close')} FROM b WHERE asset = 'view'")
def _(spark, sf):
    return tidy(R.of_asset(A.bars_hourly(spark, sf), "view").select("asset", "ts", "close"))


@query("p03_last_days", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 7 DAY")
def _(spark, sf):
    return R.last_days(A.table(spark, sf, "events"), 7, "ts", "2024-01-28 00:00:00").select("event_id")


@query("l01_global_sort", with_(BARS_D) + f"SELECT asset, {ts()}, {rds('close')} FROM b ORDER BY asset, ts")
def _(spark, sf):
    return tidy(A.bars_daily(spark, sf).select("asset", "ts", "close").orderBy("asset", "ts"))


@query("l02_newest_news", f"SELECT event_id, {ts()} FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    return tidy(R.newest(A.table(spark, sf, "events"), 50, "ts", ["event_id"]).select("event_id", "ts"))


@query("l04_row_limit", with_(BARS_D) + f"SELECT asset, {ts()}, {rds('close')} FROM b ORDER BY ts, asset LIMIT 500")
def _(spark, sf):
    b = A.bars_daily(spark, sf).select("asset", "ts", "close")
    return tidy(b.orderBy("ts", "asset").limit(500))


@query(
    "x_time_and_text",
    f"""SELECT event_id, {rd("hour(ts) / 24::DOUBLE", 'hour_fraction')}, strftime(ts, '%Y-%m') AS month, {ts("ts - INTERVAL 9 HOUR", 'utc')},
    CASE WHEN event_type = 'error' THEN '—' WHEN value > 100 THEN '$' || printf('%.2f', value) ELSE '$' || printf('%.4f', value) END AS price,
    printf('%+.3f%%', value - 50) AS change FROM events""",
)
def _(spark, sf):
    e = A.table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return tidy(
        e.select(
            "event_id",
            C.hour_fraction(F.col("ts")).alias("hour_fraction"),
            C.month_label(F.col("ts")).alias("month"),
            C.to_utc(F.col("ts"), "Asia/Tokyo").alias("utc"),
            C.price_text(value).alias("price"),
            C.percent_text(F.col("value") - 50).alias("change"),
        )
    )


@query(
    "a40_performance",
    with_(BARS_D, f"s AS (SELECT *, coalesce(close / lag(close) OVER ({WA}) - 1, 0) AS r, max(close) OVER ({WA} ROWS UNBOUNDED PRECEDING) AS peak FROM b)")
    + f"""SELECT asset, {rd('arg_max(close, ts) / arg_min(close, ts) - 1', 'cumulative_return')}, {rd('avg(r) / stddev_pop(r) * sqrt(8760::DOUBLE)', 'sharpe_ratio')},
    {rd('count(*) FILTER (r > 0) / count(*) FILTER (r <> 0)', 'win_rate')}, {rd('max((peak - close) / peak)', 'max_drawdown')}, count(*) FILTER (r <> 0) AS n_trades,
    {rd('arg_max(close, ts)', 'final_value')} FROM s GROUP BY 1""",
)
def _(spark, sf):
    b = A.bars_daily(spark, sf).withColumn("effective_position", F.lit(1.0))
    steps = TR.step_columns(b, ["asset"], ["ts"], "close")
    return tidy(TR.performance(steps, ["asset"], ["ts"], "close"))


@query(
    "j09_trade_markers",
    with_(
        BARS_H,
        TOUCH,
        "la AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY entry_time DESC) AS rn FROM ex)",
        """mk AS (SELECT asset, entry_time AS at, CASE WHEN side > 0 THEN 'LONG entry' ELSE 'SHORT entry' END AS marker, entry_price AS price FROM la WHERE rn <= 50
        UNION ALL SELECT asset, exit_time, 'exit:' || exit_reason, exit_price FROM la WHERE rn <= 50 AND exit_time IS NOT NULL)""",
    )
    + f"SELECT mk.asset, {ts('mk.at', 'at')}, marker, {rds('price')}, {ts('b.ts', 'bar_ts')}, {rd('b.close', 'close')} FROM mk ASOF LEFT JOIN b ON mk.asset = b.asset AND mk.at >= b.ts",
)
def _(spark, sf):
    bars = A.bars_hourly(spark, sf)
    t = TR.first_touch(bars, _entries(spark, sf))
    t = t.withColumn("side", F.when(F.col("side") > 0, "LONG").otherwise("SHORT"))
    return tidy(TR.markers(t, bars, 50).select("asset", "at", "marker", "price", "bar_ts", "close"))
