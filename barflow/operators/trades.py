"""Trade rules as table operators: entries, exits, accounting, trade analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.operators.asof import asof_backward, asof_forward
from barflow.operators.series import arrange, lookup
from barflow.operators.windows import latest_n

# Fixed values.
CAPITAL = 10_000.0
COST_RATE = 0.001
MAX_HOLD = 48
ENTRY_THRESHOLDS = {"BTC": 0.0, "ETH": 0.002, "GOLD": 0.0035, "OIL": 0.0035}
TREND_TOLERANCE = 0.0005
RISK_CAPS = {"BTC": 2, "ETH": 1, "GOLD": 0, "OIL": 0}
# asset -> (requested risk, least strength for it, risk granted below that strength)
WEAK_RISK = {
    "ETH": ((2, 0.005, 1),),
    "GOLD": ((2, float("inf"), 0), (1, 0.006, 0)),
    "OIL": ((2, float("inf"), 0), (1, 0.006, 0)),
}
DIRECTIONS = {0: "HOLD", 1: "FLAT", 2: "LONG", 3: "SHORT"}
SIZES = {0: "SMALL", 1: "MEDIUM", 2: "LARGE"}
SIZE_FRACTIONS = {0: 0.25, 1: 0.50, 2: 1.00}
RISKS = {0: "CONSERVATIVE", 1: "BALANCED", 2: "AGGRESSIVE"}
LEVERAGE = {0: 1.0, 1: 1.5, 2: 2.0}
STOP_MULT = {0: 1.0, 1: 1.5, 2: 2.0}
TAKE_MULT = {0: 1.5, 1: 2.5, 2: 4.0}
SHORT_PARTS = {
    "LONG": "L", "SHORT": "S", "SMALL": "Small", "MEDIUM": "Med", "LARGE": "Large",
    "CONSERVATIVE": "Cons", "BALANCED": "Bal", "AGGRESSIVE": "Agg",
}
REWARDS = (
    "reward_pnl", "reward_tp_bonus", "reward_transaction_cost", "reward_drawdown_penalty",
    "reward_overtrading_penalty", "reward_missed_opportunity_penalty", "reward_wrong_side_penalty", "reward_sl_penalty",
)


def choose(code: Column, table: dict) -> Column:
    """Look a code up in a small fixed table; NULL for others."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(code == F.lit(k), F.lit(v)).otherwise(out)
    return out


def eligible(
    df: DataFrame,
    thresholds: dict[str, float] = ENTRY_THRESHOLDS,
    tolerance: float = TREND_TOLERANCE,
    predicted: str = "predicted_log_return",
) -> DataFrame:
    """may_long and may_short per signal row.

    Assets with a positive threshold need a signal of at least that strength and a
    recent trend (ret_4, else ret_1) not against it beyond the tolerance. Rows
    without a forecast pass, as do assets without a threshold.
    """
    thr = F.coalesce(choose(F.upper("asset"), thresholds), F.lit(0.0))
    p = F.coalesce(F.col(predicted), F.lit(0.0))
    strength = F.when(F.col("signal_strength") > 0, F.col("signal_strength")).otherwise(F.abs(p))
    strong = (thr <= 0) | (strength <= 0) | (strength >= thr)
    free = (thr <= 0) | (p == 0)
    trend = F.when(F.col("ret_4") == 0, F.col("ret_1")).otherwise(F.col("ret_4"))

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return df.withColumns(
        {
            "may_long": strong & sure(free | ((p > thr) & (trend >= -tolerance))),
            "may_short": strong & sure(free | ((p < -thr) & (trend <= tolerance))),
        }
    )


def cap_risk(
    asset: Column, risk: Column, strength: Column, caps: dict[str, int] = RISK_CAPS, weak: dict = WEAK_RISK
) -> Column:
    """Requested risk index, lowered where the asset's signal does not carry it."""
    name, out = F.upper(asset), risk
    for a, rules in weak.items():
        lowered = risk
        for wanted, least, granted in rules:
            lowered = F.when((risk == wanted) & (strength < F.lit(float(least))), F.lit(granted)).otherwise(lowered)
        out = F.when(name == a, lowered).otherwise(out)
    return F.least(out, F.coalesce(choose(name, caps), F.lit(max(RISKS))))


def decode(df: DataFrame, direction: str = "direction", size: str = "size", risk: str = "risk") -> DataFrame:
    """Names and multipliers of action codes, the action's full name and its short label."""
    d, s, r = F.col(direction), F.col(size), F.col(risk)
    out = df.withColumns(
        {
            "direction_name": choose(d, DIRECTIONS),
            "size_label": choose(s, SIZES),
            "risk_profile": choose(r, RISKS),
            "position_fraction": choose(s, SIZE_FRACTIONS),
            "leverage_used": choose(r, LEVERAGE),
            "sl_mult": choose(r, STOP_MULT),
            "tp_mult": choose(r, TAKE_MULT),
        }
    )
    name = F.when(d < 2, F.col("direction_name")).otherwise(
        F.concat_ws("_", "direction_name", "size_label", "risk_profile")
    )
    return out.withColumn("action_name", name).withColumn("action_short", short_label(F.col("action_name")))


def short_label(name: Column) -> Column:
    """HOLD -> Hold, LONG_SMALL -> L-Small, SHORT_LARGE_BALANCED -> S-Large-Bal; others unchanged."""
    parts = F.split(name, "_")
    brief = F.array_join(F.transform(parts, lambda x: F.coalesce(choose(x, SHORT_PARTS), x)), "-")
    return (
        F.when(name.isin("HOLD", "FLAT"), F.initcap(name)).when(F.size(parts).isin(2, 3), brief).otherwise(name)
    )


def price_levels(df: DataFrame) -> DataFrame:
    """Stop and target around the entry price by multiples of the ATR; side is 1 or -1."""
    e, a, side = F.col("entry_price"), F.col("atr"), F.col("side")
    return df.withColumns(
        {
            "sl_price": e - side * F.col("sl_mult") * a,
            "tp_price": e + side * F.col("tp_mult") * a,
            "risk_reward_ratio": F.when(F.col("sl_mult") > 0, F.col("tp_mult") / F.col("sl_mult")).otherwise(0.0),
        }
    )


def account(df: DataFrame) -> DataFrame:
    """Profit of completed trades from prices, position and capital at entry."""
    side = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    out = df.withColumn("effective_position", F.col("position_fraction") * F.col("leverage_used"))
    out = out.withColumn("notional_value", F.col("portfolio_value_before") * F.col("effective_position"))
    out = out.withColumn(
        "gross_pnl",
        F.try_divide(side * (F.col("exit_price") - F.col("entry_price")), F.col("entry_price")) * F.col("notional_value"),
    )
    out = out.withColumn("net_pnl", F.col("gross_pnl") - F.col("transaction_cost_total"))
    return out.withColumns(
        {
            "return_pct": F.when(F.col("notional_value") > 0, F.col("net_pnl") / F.col("notional_value")).otherwise(0.0),
            "portfolio_value_after": F.col("portfolio_value_before") + F.col("net_pnl"),
        }
    )


def sign_errors(df: DataFrame) -> DataFrame:
    """Trades whose gross profit contradicts the move from entry to exit."""
    up = F.col("exit_price") - F.col("entry_price")
    wrong = F.when(F.col("side") == "LONG", up < 0).otherwise(up > 0)
    return df.filter(wrong & (F.col("gross_pnl") > 0))


def first_touch(bars: DataFrame, entries: DataFrame, max_hold: int = MAX_HOLD) -> DataFrame:
    """Where each entry leaves: the first later bar touching the stop or the target.

    `entries` has asset, ts (a bar's), side (1 or -1), sl_price, tp_price (may be
    NULL). The stop wins a bar touching both; with neither the trade ends after
    `max_hold` bars (MAX_HOLD) or with the series (END). Entries on the last bar
    have no exit. The path looked at is at most `max_hold` bars.
    """
    path = F.struct("ts", "high", "low", "close")

    def fn(d, w):
        return d.withColumn("_path", F.collect_list(path).over(w.rowsBetween(1, max_hold)))

    marked = bars.select("asset", "ts", "high", "low", "close").join(
        entries.select("asset", "ts", "side", "sl_price", "tp_price"), ["asset", "ts"], "left"
    )
    rows = arrange(marked, ["asset"], ["ts"], bound=[bars, entries]).bounded(fn, ahead=max_hold).frame()
    rows = rows.filter(F.col("side").isNotNull())
    sl, tp, long = F.col("sl_price"), F.col("tp_price"), F.col("side") > 0

    def stopped(x: Column) -> Column:
        return F.coalesce(F.when(long, x["low"] <= sl).otherwise(x["high"] >= sl), F.lit(False))

    def taken(x: Column) -> Column:
        return F.coalesce(F.when(long, x["high"] >= tp).otherwise(x["low"] <= tp), F.lit(False))

    numbered = F.transform(
        "_path",
        lambda x, i: F.struct(
            x["ts"].alias("ts"), x["close"].alias("close"), (i + 1).alias("held"),
            stopped(x).alias("stopped"), taken(x).alias("taken"),
        ),
    )
    rows = rows.withColumn("_path", numbered)
    hit = F.try_element_at(F.filter("_path", lambda x: x["stopped"] | x["taken"]), F.lit(1))
    last = F.try_element_at("_path", F.lit(-1))
    rows = rows.withColumns({"_hit": hit, "_end": F.coalesce(hit, last)})
    return rows.select(
        "asset",
        F.col("ts").alias("entry_time"),
        "side",
        F.col("close").alias("entry_price"),
        F.col("_end.ts").alias("exit_time"),
        F.col("_end.close").alias("exit_price"),
        F.col("_end.held").cast("int").alias("holding_bars"),
        F.when(F.col("_hit.stopped"), "SL")
        .when(F.col("_hit.taken"), "TP")
        .when(F.size("_path") == max_hold, "MAX_HOLD")
        .when(F.size("_path") > 0, "END")
        .alias("exit_reason"),
    )


def path_stats(trades: DataFrame, bars: DataFrame, trade_key: Sequence[str] = ("asset", "trade_id")) -> DataFrame:
    """High, low and best and worst unrealised return between entry and exit, inclusive.

    `trades` has asset, entry_time, exit_time, entry_price, side ('LONG'/'SHORT').
    A trade is not joined to every bar it spans: bars are summarised in aligned runs
    of 1, 2, 4, ... positions, and a trade of n bars reads at most 2*log2(n) of them
    by equality. Trades that span no bar get NULLs.
    """
    key = list(trade_key)
    # a bar without a high or a low counts with its close
    filled = bars.select("asset", "ts", F.coalesce("high", "close").alias("high"), F.coalesce("low", "close").alias("low"), "close")
    placed = arrange(filled, ["asset"], ["ts"]).position("_p").frame()
    at = placed.select("asset", "ts", "_p")
    spans = asof_forward(
        trades.select(*dict.fromkeys([*key, "asset", "entry_time", "exit_time"])), at.withColumnRenamed("_p", "_lo"), ["asset"], ["_lo"], left_ts="entry_time"
    )
    spans = asof_backward(spans, at.withColumnRenamed("_p", "_hi"), ["asset"], ["_hi"], left_ts="exit_time")
    spans = spans.select(*dict.fromkeys([*key, "asset"]), "_lo", "_hi").filter(F.col("_lo") <= F.col("_hi"))
    spans = session.settle(spans, "spans")
    longest = spans.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_k")
    size = F.pow(F.lit(2.0), F.col("_k")).cast("long")
    runs = (
        placed.select("*", level)
        .groupBy("asset", "_k", F.floor(F.col("_p") / size).alias("_node"))
        .agg(
            F.max("high").alias("high"), F.min("low").alias("low"),
            F.max("close").alias("top"), F.min("close").alias("bottom"),
        )
    )
    left, right = F.ceil(F.col("_lo") / size), F.floor((F.col("_hi") + 1) / size)
    nodes = F.array(
        F.when((left < right) & (left % 2 == 1), left),
        F.when((left < right) & (right % 2 == 1), right - 1),
    )
    wanted = (
        spans.select("*", level)
        .select(*dict.fromkeys([*key, "asset"]), "_k", F.explode(F.filter(nodes, lambda x: x.isNotNull())).alias("_node"))
    )
    found = wanted.join(runs, ["asset", "_k", "_node"]).groupBy(*key).agg(
        F.max("high").alias("high_during_trade"),
        F.min("low").alias("low_during_trade"),
        F.max("top").alias("_top"),
        F.min("bottom").alias("_bottom"),
    )
    counts = spans.select(*key, (F.col("_hi") - F.col("_lo")).alias("holding_bars"))
    out = trades.drop("high_during_trade", "low_during_trade", "holding_bars").join(counts, key, "left").join(found, key, "left")
    e, long = F.col("entry_price"), F.col("side") == "LONG"
    best = F.when(long, F.col("_top") / e - 1).otherwise(1 - F.col("_bottom") / e)
    worst = F.when(long, F.col("_bottom") / e - 1).otherwise(1 - F.col("_top") / e)
    return out.withColumns(
        {
            "max_favorable_excursion": F.when(best.isNotNull(), F.greatest(best, F.lit(0.0))),
            "max_adverse_excursion": F.when(worst.isNotNull(), F.least(worst, F.lit(0.0))),
        }
    ).drop("_top", "_bottom")


def filtered(
    df: DataFrame,
    sides: Sequence[str] = (),
    exits: Sequence[str] = (),
    risks: Sequence[str] = (),
    profitable: bool = False,
    first: int | None = None,
    order: Sequence[str] = ("entry_time",),
) -> DataFrame:
    """Trade table filters; an empty list does not restrict, `first` keeps the earliest."""
    for col, wanted in (("side", sides), ("exit_reason", exits), ("risk_profile_at_entry", risks)):
        if wanted:
            df = df.filter(F.col(col).isin(list(wanted)))
    if profitable:
        df = df.filter(F.col("net_pnl") > 0)
    return df.orderBy(*order).limit(first) if first else df


def summary(df: DataFrame, keys: Sequence[str], zero_loss: str = "inf", capital: float = CAPITAL, total: bool = False) -> DataFrame:
    """Completed-trade summary per key (and over all with `total`).

    `zero_loss="inf"` counts break-even trades as losses and gives an infinite
    profit factor without any loss; `"null"` counts losses below 0 and gives NULL.
    """
    pnl = F.col("net_pnl")
    lost = pnl <= 0 if zero_loss == "inf" else pnl < 0
    grouped = df.rollup(*keys) if total else df.groupBy(*keys)
    out = grouped.agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum(pnl).alias("net_pnl"),
        F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(F.when(lost, pnl)), F.lit(0.0))).alias("gross_loss"),
        F.sum("transaction_cost_total").alias("total_cost"),
        F.avg("risk_reward_ratio").alias("avg_risk_reward"),
        F.avg("holding_bars").alias("avg_holding"),
    )
    none = F.lit(float("inf")) if zero_loss == "inf" else F.lit(None).cast("double")
    return out.withColumns(
        {
            "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(none),
            "return_pct": F.col("net_pnl") / capital * 100,
        }
    )


def by_category(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean profit, win rate and count per category."""
    return df.groupBy(*keys).agg(
        F.avg("net_pnl").alias("mean_pnl"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def component_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "avg") -> DataFrame:
    """Mean (or sum) of each reward component, one row per key and component."""
    agg = F.avg if how == "avg" else F.sum
    wide = df.groupBy(*keys).agg(*[agg(c).alias(c) for c in cols])
    return wide.unpivot(list(keys), list(cols), "component", "value")


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Running sums; `order` ends in a tie-break, NULLs count as nothing."""
    return arrange(df, keys, order).running(**{f"cum_{c}": ("sum", F.col(c)) for c in cols}).frame()


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "portfolio_value") -> DataFrame:
    """Running peak and percent below it."""
    s = arrange(df, keys, order).running(peak=("max", F.col(value)))
    floor = F.greatest(F.col("peak"), F.lit(1e-9))
    return s.frame().withColumn("drawdown_pct", (F.col(value) - F.col("peak")) / floor * 100)


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "portfolio_value") -> DataFrame:
    dd = drawdown(df, keys, order, value)
    return dd.groupBy(*keys).agg(F.min("drawdown_pct").alias("max_drawdown_pct"))


def step_columns(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "portfolio_value", rate: float = COST_RATE) -> DataFrame:
    """Step return against the previous value (0 at the start), turnover and its cost.

    Turnover is the change of the effective position; its cost is charged on the
    previous portfolio value.
    """
    def fn(d, w):
        prev, pos = F.lag(value, 1).over(w), F.lag("effective_position", 1, 0.0).over(w)
        turn = F.abs(F.col("effective_position") - pos)
        return d.withColumns(
            {
                "step_return": F.coalesce(F.try_divide(F.col(value) - prev, prev), F.lit(0.0)),
                "turnover": turn,
                "transaction_cost": turn * rate * F.coalesce(prev, F.col(value)),
            }
        )

    return arrange(df, keys, order).bounded(fn, back=1).frame()


def side_bias(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    side: str = "SHORT",
    lookback: int = 20,
    limit: float = 0.70,
    least: int = 3,
    strength: str | None = None,
    override: float = 0.006,
) -> DataFrame:
    """Share of `side` among the previous trades, and whether another one is blocked.

    Blocked means more than `limit` of at least `least` trades and, with a strength
    column, a signal weaker than `override`.
    """
    def fn(d, w):
        frame = w.rowsBetween(-lookback, -1)
        return d.withColumns(
            {
                "n_recent": F.count(F.lit(1)).over(frame),
                "side_ratio": F.avg((F.col("side") == side).cast("double")).over(frame),
            }
        )

    weak = F.col(strength) < override if strength else F.lit(True)
    out = arrange(df, keys, order).bounded(fn, back=lookback).frame()
    return out.withColumn("blocked", F.coalesce((F.col("n_recent") >= least) & (F.col("side_ratio") > limit) & weak, F.lit(False)))


def reconcile(trades: DataFrame, steps: DataFrame, keys: Sequence[str], ts: str = "ts", capital: float = CAPITAL, tolerance: float = 0.01) -> DataFrame:
    """Sum of trade profits against the change of the portfolio from its capital."""
    t = trades.groupBy(*keys).agg(F.sum("net_pnl").alias("trade_pnl"))
    p = steps.groupBy(*keys).agg(F.max_by("portfolio_value", ts).alias("_last"))
    out = lookup(t, p, list(keys)).withColumn("portfolio_pnl", F.col("_last") - capital).drop("_last")
    gap = F.col("portfolio_pnl") - F.col("trade_pnl")
    return out.withColumns({"difference": gap, "ok": F.coalesce(F.abs(gap) <= tolerance, F.lit(False))})


def performance(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "portfolio_value", step: str = "step_return",
    periods: int = 365 * 24,
) -> DataFrame:
    """Summary of a step table: returns as in buy_and_hold, plus the share of gains among the steps that moved.

    Sharpe is 0 without deviation, and so is the win rate without a step that moved.
    """
    rows = drawdown(df, keys, order, value)
    at, sd, moved = F.struct(*order), F.stddev_pop(step), F.count_if(F.col(step) != 0)
    first, last = F.min_by(value, at), F.max_by(value, at)
    return rows.groupBy(*keys).agg(
        F.try_divide(last - first, first).alias("cumulative_return"),
        F.when(sd > 0, F.avg(step) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe_ratio"),
        F.coalesce(F.try_divide(F.count_if(F.col(step) > 0), moved), F.lit(0.0)).alias("win_rate"),
        (-F.min("drawdown_pct") / 100).alias("max_drawdown"),
        moved.alias("n_trades"),
        last.alias("final_value"),
    )


def markers(trades: DataFrame, bars: DataFrame, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Entries and exits of the last `n` trades per asset, each with the bar it falls into.

    `trades` has asset, side, entry_time, entry_price, exit_time, exit_price, exit_reason. A marker is the entry by its
    side or the exit by its reason; open trades have no exit marker, and times before the first bar have no bar.
    """
    last = latest_n(trades, ["asset"], "entry_time", n, ties)
    entry = last.select("asset", F.col("entry_time").alias("at"), F.concat("side", F.lit(" entry")).alias("marker"), F.col("entry_price").alias("price"))
    leave = last.select("asset", F.col("exit_time").alias("at"), F.concat(F.lit("exit:"), "exit_reason").alias("marker"), F.col("exit_price").alias("price"))
    every = entry.unionByName(leave.filter("at is not null and marker is not null"))
    return asof_backward(every, bars.select("asset", "ts", "close"), ["asset"], ["close"], left_ts="at", matched_ts="bar_ts")
