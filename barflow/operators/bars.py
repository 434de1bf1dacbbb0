"""Bars: resampling, repair, returns, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import finite, log_return, pct_change
from barflow.operators.series import Series, arrange

OHLC = ("open", "high", "low", "close")


def resample(
    df: DataFrame,
    step: str,
    tie: str | None = None,
    opens: str = "open",
    highs: str = "high",
    lows: str = "low",
    closes: str = "close",
    volume: str = "volume",
    ts: str = "ts",
) -> DataFrame:
    """Bars of length `step`, closed and labelled on the left, incomplete ones dropped.

    First and last skip NULLs. Where times repeat give a `tie`, an integer column: time
    and tie make up one number, so ticks are hash-aggregated without a sort.
    """
    instant = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    when = instant
    if tie:  # a bigint has at most 19 digits
        when = instant * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")

    def at(c: str):
        return F.when(F.col(c).isNotNull(), when)

    out = df.groupBy("asset", F.window(ts, step).alias("_w")).agg(
        F.min_by(opens, at(opens)).alias("open"),
        F.max(highs).alias("high"),
        F.min(lows).alias("low"),
        F.max_by(closes, at(closes)).alias("close"),
        F.sum(volume).alias("volume"),
    )
    return out.dropna(subset=list(OHLC)).select("asset", F.col("_w.start").alias("ts"), *OHLC, "volume")


def bar_series(bars: DataFrame) -> Series:
    return arrange(bars, ["asset"], ["ts"])


def simple_returns(bars: DataFrame) -> DataFrame:
    """One-bar log return and percent change."""
    def step(d, w):
        return d.withColumns({"log_ret": log_return(F.col("close"), w), "pct": pct_change(F.col("close"), w)})

    return bar_series(bars).bounded(step, back=1).frame()


def reconstruct(s: Series) -> Series:
    """Fill missing open, high, low from closes; say where and mark the source."""
    def step(d, w):
        return (
            d.withColumn(
                "ohlc_source",
                F.when(
                    F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull(), "raw"
                ).otherwise("reconstructed"),
            )
            .withColumn("_prev", F.lag("close", 1).over(w))
            .withColumn("open", F.coalesce("open", "_prev", "close"))
            .withColumn("high", F.coalesce("high", F.greatest("open", "close")))
            .withColumn("low", F.coalesce("low", F.least("open", "close")))
            .drop("_prev")
        )

    return s.bounded(step, back=1)


def reconstructed_share(df: DataFrame) -> DataFrame:
    return df.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("ohlc_source") == "reconstructed").cast("double")).alias("reconstructed_share"),
    )


def quality(bars: DataFrame) -> DataFrame:
    """One row per asset: row count, all-NULL columns, mean OHLC NULL share, verdicts.

    A frame without a required column is rejected before any job runs.
    """
    missing = [c for c in (*OHLC, "volume") if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack columns {missing}")
    cols = (*OHLC, "volume")
    counts = bars.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in cols]
    )
    empty = F.filter(
        F.array(*[F.when(F.col(f"n_{c}") == 0, F.lit(c)) for c in cols]), lambda x: x.isNotNull()
    )
    share = sum((1 - F.col(f"n_{c}") / F.col("n_rows") for c in OHLC), F.lit(0.0)) / len(OHLC)
    return counts.select(
        "asset",
        "n_rows",
        F.concat_ws(",", empty).alias("empty_columns"),
        share.alias("null_share"),
        (share > 0.10).alias("warn"),
        (F.size(empty) == 0).alias("ok"),
    )


def clean_numbers(df: DataFrame, cols) -> DataFrame:
    """Numeric coercion: text that is no number, NaN and infinities become NULL."""
    return df.withColumns({c: finite(F.expr(f"try_cast(`{c}` as double)")) for c in cols})
