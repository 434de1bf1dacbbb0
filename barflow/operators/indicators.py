"""Rolling and exponentially weighted indicators.

The definitions are the published ones (Wilder's RSI and ATR, Appel's MACD,
Bollinger's bands). Row-based: a window of 20 is 20 bars, whatever their spacing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from barflow.functions.columns import finite, log_return, pct_change, rolling
from barflow.operators import ewm
from barflow.operators.series import Series

LR = "_lr"


@dataclass(frozen=True)
class Step:
    """Window columns with the number of earlier and later rows they read."""

    fn: Callable[[DataFrame, WindowSpec], DataFrame]
    back: int
    ahead: int = 0


def apply(s: Series, *steps: Step) -> Series:
    """All steps in one pass over the series, hence in one shuffle."""

    def fn(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn(LR, log_return(F.col("close"), w))
        for step in steps:
            d = step.fn(d, w)
        return d.drop(LR)

    return s.bounded(fn, back=max(x.back for x in steps) + 1, ahead=max(x.ahead for x in steps))


def lagged_returns(lags: Sequence[int] = (1, 4, 8, 16), lagged: bool = True) -> Step:
    """ret_L: the sum of L log returns, by default ending L-1 bars ago."""

    def fn(d, w):
        out = {}
        for n in lags:
            end = n - 1 if lagged else 0
            frame = w.rowsBetween(-(end + n - 1), -end)
            out[f"ret_{n}"] = F.when(F.count(LR).over(frame) == n, F.sum(LR).over(frame))
        return d.withColumns(out)

    return Step(fn, back=2 * max(lags))


def rolling_close(windows: Sequence[int] = (4, 8, 16)) -> Step:
    """mean_w and std_w (sample) of the close."""

    def fn(d, w):
        c = F.col("close")
        return d.withColumns(
            {f"mean_{n}": rolling(F.avg, c, w, n) for n in windows}
            | {f"std_{n}": rolling(F.stddev_samp, c, w, n) for n in windows}
        )

    return Step(fn, back=max(windows))


def momentum(lags: Sequence[int] = (4, 16)) -> Step:
    def fn(d, w):
        return d.withColumns({f"mom_{k}": pct_change(F.col("close"), w, k) for k in lags})

    return Step(fn, back=max(lags))


def volatility(window: int = 20, name: str = "vol_20") -> Step:
    """Sample deviation of the last `window` log returns."""
    return Step(lambda d, w: d.withColumn(name, rolling(F.stddev_samp, F.col(LR), w, window)), back=window)


def mean_return(window: int = 20, name: str = "mean_lr_20") -> Step:
    return Step(lambda d, w: d.withColumn(name, rolling(F.avg, F.col(LR), w, window)), back=window)


def bollinger(window: int = 20, width: float = 2.0) -> Step:
    """Bands at the mean plus and minus `width` population deviations."""

    def fn(d, w):
        c = F.col("close")
        d = d.withColumns(
            {"bb_middle": rolling(F.avg, c, w, window), "_sd": rolling(F.stddev_pop, c, w, window)}
        )
        d = d.withColumns(
            {
                "bb_upper": F.col("bb_middle") + width * F.col("_sd"),
                "bb_lower": F.col("bb_middle") - width * F.col("_sd"),
            }
        )
        gap = F.col("bb_upper") - F.col("bb_lower")
        return d.withColumns(
            {
                "bb_width": F.try_divide(gap, F.col("bb_middle")) * 100,
                "bb_pct": F.try_divide(c - F.col("bb_lower"), gap),
            }
        ).drop("_sd")

    return Step(fn, back=window)


def population_volatility(window: int = 20, at_least: int = 2, name: str = "rolling_vol_20") -> Step:
    """Population deviation of up to `window` log returns, from the second on."""
    return Step(
        lambda d, w: d.withColumn(name, rolling(F.stddev_pop, F.col(LR), w, window, at_least)), back=window
    )


def moving_average(window: int = 20, name: str = "ma_20") -> Step:
    return Step(lambda d, w: d.withColumn(name, rolling(F.avg, F.col("close"), w, window)), back=window)


def scaled_volatility(window: int = 20, scale: float = 24**0.5 * 100, name: str = "vol_scaled") -> Step:
    """Sample deviation of percent changes times `scale`."""

    def fn(d, w):
        d = d.withColumn("_pct", pct_change(F.col("close"), w))
        return d.withColumn(name, rolling(F.stddev_samp, F.col("_pct"), w, window) * scale).drop("_pct")

    return Step(fn, back=window)


def rsi(s: Series, window: int = 14, name: str = "rsi_14") -> Series:
    """Wilder's RSI from the 14th bar on; 100 where no loss is left."""

    def changes(d, w):
        diff = F.col("close") - F.lag("close", 1).over(w)
        # The first bar has no change and enters as zero.
        return d.withColumns(
            {
                "_up": F.greatest(F.coalesce(diff, F.lit(0.0)), F.lit(0.0)),
                "_down": F.greatest(-F.coalesce(diff, F.lit(0.0)), F.lit(0.0)),
            }
        )

    a = ewm.wilder(window)
    out = ewm.ewm(
        s.bounded(changes, back=1),
        {"_gain": (F.col("_up"), a), "_loss": (F.col("_down"), a)},
        F.col("close").isNotNull(),
        min_obs=window,
    )
    value = F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(
        100 - 100 / (1 + F.try_divide(F.col("_gain"), F.col("_loss")))
    )
    return out.map(
        lambda d: d.withColumn(name, F.when(F.col("_gain").isNotNull(), value)).drop("_up", "_down", "_gain", "_loss")
    )


def macd(s: Series, fast: int = 12, slow: int = 26, sign: int = 9) -> Series:
    """macd from the slow span on, its signal from `sign` values later, and their gap."""
    c = F.col("close")
    out = ewm.ewm(
        s,
        {"_fast": (c, ewm.span(fast)), "_slow": (c, ewm.span(slow))},
        c.isNotNull(),
        min_obs=slow,
    ).map(lambda d: d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"))
    m = F.col("macd")
    out = ewm.ewm(out, {"macd_signal": (m, ewm.span(sign))}, m.isNotNull(), min_obs=sign)
    return out.map(lambda d: d.withColumn("macd_hist", m - F.col("macd_signal")))


def atr(s: Series, window: int = 14, name: str = "atr_14") -> Series:
    """Wilder's average true range, seeded with the mean of the first 14."""

    def true_range(d, w):
        prev = F.lag("close", 1).over(w)
        h, l = F.col("high"), F.col("low")
        return d.withColumn("_tr", F.greatest(h - l, F.abs(h - prev), F.abs(l - prev)))

    out = ewm.ewm(
        s.bounded(true_range, back=1),
        {name: (F.col("_tr"), ewm.wilder(window))},
        F.col("_tr").isNotNull(),
        seed_rows=window,
    )
    return out.map(lambda d: d.drop("_tr"))


def atr_or_fallback(s: Series, window: int = 14, name: str = "atr_used") -> Series:
    """A positive range for every bar.

    With an `atr_14` column: non-positive values are dropped, the last good one is
    carried forward, 1 before the first. Without: price times the deviation of up to
    14 log returns (0.001 while there is but one).
    """
    if "atr_14" in s.df.columns:
        good = F.when(F.col("atr_14") > 0, F.col("atr_14"))
        return s.running(**{name: ("last", good)}).map(
            lambda d: d.withColumn(name, F.coalesce(F.col(name), F.lit(1.0)))
        )

    def fn(d, w):
        c, floor = F.col("close"), F.lit(1e-10)
        prev = F.lag("close", 1).over(w)
        step = F.when(prev > 0, F.ln(F.greatest(c, floor) / F.greatest(prev, floor))).otherwise(F.lit(0.0))
        d = d.withColumn("_step", step)
        sd = rolling(F.stddev_samp, F.col("_step"), w, window, at_least=2)
        return d.withColumn(name, c * F.coalesce(sd, F.lit(0.001))).drop("_step")

    return s.bounded(fn, back=window)


def carry_forward(s: Series, cols: Sequence[str]) -> Series:
    out = s.running(**{f"_f_{c}": ("last", F.col(c)) for c in cols})
    return out.map(
        lambda d: d.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])
    )


def clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})
