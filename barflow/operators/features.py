"""Feature matrix: price features, indicators, regimes, cross-asset and joined series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators import indicators as I
from barflow.operators.asof import asof_backward
from barflow.operators.bars import bar_series
from barflow.operators.quantiles import quantiles
from barflow.operators.series import lookup
from barflow.operators.windows import forward_fill

REGIMES = ("regime_low_vol", "regime_bull", "regime_bear", "regime_high_vol")
SENTIMENT = (
    "sentiment_mean",
    "sentiment_std",
    "news_volume",
    "positive_ratio",
    "negative_ratio",
    "avg_confidence",
)


@dataclass(frozen=True)
class CrossRule:
    """Put `source`, lagged on the leader's own rows, on the follower's rows of the same time."""

    leader: str
    follower: str
    source: str
    lag: int
    name: str


# Fixed values of the four-asset universe.
DEFAULT_RULES = (
    CrossRule("BTC", "ETH", "log_ret", 1, "btc_ret_lag_1"),
    CrossRule("BTC", "ETH", "log_ret", 4, "btc_ret_lag_4"),
    CrossRule("OIL", "GOLD", "vol_20", 1, "oil_vol_lag_1"),
)


def regime_thresholds(df: DataFrame, std: str = "vol_20") -> DataFrame:
    """p25 and p75 of the rolling deviation per asset (the whole series: looks ahead)."""
    return quantiles(df, ["asset"], [std], {"p25": 0.25, "p75": 0.75}).drop("column")


def regimes(
    df: DataFrame, thresholds: DataFrame | None = None, mean: str = "mean_lr_20", std: str = "vol_20"
) -> DataFrame:
    """One-hot regimes; all False while the deviation is missing.

    Pass `thresholds` (asset, p25, p75) fitted on a training part to avoid look-ahead.
    """
    cut = regime_thresholds(df, std) if thresholds is None else thresholds
    out = lookup(df, cut, ["asset"])
    s, m = F.col(std), F.col(mean)
    warm = s.isNotNull()
    low, high = warm & (s < F.col("p25")), warm & (s >= F.col("p75"))
    mid = warm & ~low & ~high

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return out.withColumns(
        {
            "regime_low_vol": sure(low),
            "regime_bull": sure(mid & (m > 0)),
            "regime_bear": sure(mid & (m <= 0)),
            "regime_high_vol": sure(high),
        }
    ).drop("p25", "p75")


def cross_asset(df: DataFrame, lagged: DataFrame, rules: Sequence[CrossRule] = DEFAULT_RULES) -> DataFrame:
    """Left-join the rules' columns; NULL where the leader has no row at that time.

    `lagged` has asset, ts and one column per rule name (see `leader_lags`).
    """
    names = list(dict.fromkeys(r.name for r in rules))
    pairs = F.array(
        *[F.struct(F.lit(a).alias("leader"), F.lit(b).alias("asset")) for a, b in sorted({(r.leader, r.follower) for r in rules})]
    )
    shown = [
        F.max(
            F.when(
                F.concat_ws(">", "p.leader", "p.asset").isin([f"{r.leader}>{r.follower}" for r in rules if r.name == n]),
                F.col(n),
            )
        ).alias(n)
        for n in names
    ]
    side = (
        lagged.filter(F.col("asset").isin(sorted({r.leader for r in rules})))
        .withColumn("p", F.explode(pairs))
        .filter(F.col("asset") == F.col("p.leader"))
        .groupBy(F.col("p.asset").alias("asset"), "ts")
        .agg(*shown)
    )
    return df.join(side, ["asset", "ts"], "left")


def leader_lags(rules: Sequence[CrossRule] = DEFAULT_RULES) -> I.Step:
    """The rules' lagged sources on every asset's own rows."""

    def fn(d, w):
        d = d.withColumn("log_ret", F.col(I.LR))
        return d.withColumns({r.name: F.lag(r.source, r.lag).over(w) for r in rules}).drop("log_ret")

    return I.Step(fn, back=22 + max(r.lag for r in rules))


def join_macro(
    df: DataFrame, macro: DataFrame, cols: Sequence[str] = ("dxy", "vix", "spy"), availability_lag: str | None = None
) -> DataFrame:
    """Latest known daily value at each bar.

    By default a day's value counts from 00:00 of that day, before it is known;
    `availability_lag="1 day"` removes the leak.
    """
    filled = forward_fill(macro.select("ts", *cols), [], ["ts"], cols)
    if availability_lag:
        filled = filled.withColumn("ts", F.col("ts") + F.expr(f"interval {availability_lag}"))
    return asof_backward(df, filled, [], cols)


def join_sentiment(df: DataFrame, hourly: DataFrame, cols: Sequence[str] = SENTIMENT) -> DataFrame:
    """Hourly sentiment at exactly the bar's time; missing cells and columns are 0."""
    present = [c for c in cols if c in hourly.columns]
    out = df.join(hourly.select("asset", "ts", *present), ["asset", "ts"], "left")
    return out.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0) for c in cols}
    )


def filled_cells(df: DataFrame, hourly: DataFrame, cols: Sequence[str] = SENTIMENT) -> DataFrame:
    """Per asset, how many cells `join_sentiment` fills with 0."""
    present = [c for c in cols if c in hourly.columns]
    out = df.select("asset", "ts").join(hourly.select("asset", "ts", *present), ["asset", "ts"], "left")
    return out.groupBy("asset").agg(
        *[(F.count_if(F.col(c).isNull()) if c in present else F.count(F.lit(1))).alias(c) for c in cols]
    )


def attach_bars(df: DataFrame, bars: DataFrame, cols: Sequence[str] = ("open", "high", "low")) -> DataFrame:
    """Feature rows left-joined to the raw bars' prices."""
    return df.join(bars.select("asset", "ts", *cols), ["asset", "ts"], "left")


def price_steps(rules: Sequence[CrossRule]) -> list[I.Step]:
    steps = [I.lagged_returns(), I.rolling_close(), I.momentum(), I.volatility(), I.mean_return(), I.bollinger()]
    return [*steps, leader_lags(rules)] if rules else steps


def build(
    bars: DataFrame,
    macro: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    rules: Sequence[CrossRule] = DEFAULT_RULES,
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """The whole feature matrix for all assets as one plan."""
    names = [r.name for r in rules]
    priced = I.apply(bar_series(bars), *price_steps(rules)).fixed()
    # both come from the prices alone, not from what is derived of them below
    cut = regime_thresholds(priced.frame()) if thresholds is None else thresholds
    lagged = priced.frame().select("asset", "ts", *names)
    df = I.atr(I.macd(I.rsi(priced.map(lambda d: d.drop(*names))))).frame()
    if rules:
        df = cross_asset(df, lagged, rules)
    df = regimes(df, cut).drop("mean_lr_20")
    if macro is not None:
        df = join_macro(df, macro)
    if sentiment is not None:
        df = join_sentiment(df, sentiment)
    return df.withColumns({f"alpha_{i}": F.lit(0.0) for i in range(1, 6)} | {"market_open": F.lit(True)})
