"""Dashboard and health reports over stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import correlation, pct_change
from barflow.operators.bars import bar_series
from barflow.operators.series import arrange, lookup
from barflow.operators.windows import latest_n


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per asset, one column per table; 0 where an asset is absent."""
    tagged = [
        t.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name)) for name, t in tables.items()
    ]
    out = reduce(DataFrame.unionByName, tagged)
    return out.groupBy("asset").pivot("table", list(tables)).agg(F.sum("n")).fillna(0)


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once."""
    return group_counts(df, keys).filter(F.col("n") > 1)


def time_range(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """First and last time per table and asset."""
    parts = [
        t.groupBy("asset").agg(F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn("table", F.lit(name))
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def column_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each column in one pass."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*keys).agg(*[fn(c).alias(f"{c}_{n}") for c in cols for n, fn in stats.items()])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{n}").alias(n) for n in stats]) for c in cols])
    return wide.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*")


def null_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key and column: rows, NULLs, their share, and whether all are NULL."""
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    tall = wide.unpivot([*keys, "_n"], list(cols), "column", "_there")
    n = F.col("_n")
    return tall.select(
        *keys, "column", n.alias("n_rows"), (n - F.col("_there")).alias("n_null"),
        (1 - F.col("_there") / n).alias("null_share"), (F.col("_there") == 0).alias("all_null"),
    )


def feature_status(df: DataFrame, expected: Sequence[str], sentiment: Sequence[str] = (), keys: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """Per key, the expected feature columns against those that hold a value: one row, from one pass.

    `missing` are expected columns without any value for that key, in the expected order; `extra` are other columns with one,
    in the table's; both comma-joined. `valid` says that nothing is missing, `has_sentiment` that a sentiment column has a
    value. Sentiment columns are neither expected nor extra.
    """
    held = [c for c in df.columns if c not in (*keys, ts)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_h_{i}") for i, c in enumerate(held)])
    there = {c: F.col(f"_h_{i}") > 0 for i, c in enumerate(held)}

    def named(cols: Sequence[str], wanted) -> Column:
        return F.array_compact(F.array(*[F.when(wanted(c), F.lit(c)) for c in cols], F.lit(None).cast("string")))

    missing = named(expected, lambda c: ~there.get(c, F.lit(False)))
    extra = named([c for c in held if c not in expected and c not in sentiment], lambda c: there[c])
    any_sentiment = reduce(lambda a, b: a | b, [there[c] for c in sentiment if c in there], F.lit(False))
    return counts.select(
        *keys,
        F.col("_n").alias("n_rows"),
        F.lit(len(expected)).cast("long").alias("n_expected"),
        (F.lit(len(expected)) - F.size(missing)).cast("long").alias("n_present"),
        F.array_join(missing, ",").alias("missing"),
        F.array_join(extra, ",").alias("extra"),
        (F.size(missing) == 0).alias("valid"),
        any_sentiment.alias("has_sentiment"),
    )


def return_correlation(bars: DataFrame, assets: Sequence[str], fill: bool = True) -> DataFrame:
    """Correlation of percent changes between the given assets, rounded to 3.

    Closes are laid side by side per time, gaps carried forward (`fill`), then one
    aggregation takes each pair over the times both have.
    """
    cols = [f"_a{i}" for i in range(len(assets))]
    wide = bars.filter(F.col("asset").isin(list(assets))).groupBy("ts").agg(
        *[F.avg(F.when(F.col("asset") == a, F.col("close"))).alias(c) for a, c in zip(assets, cols)]
    )
    s = arrange(wide, [], ["ts"])
    if fill:
        s = s.running(**{f"_f{c}": ("last", F.col(c)) for c in cols}).map(
            lambda d: d.withColumns({c: F.col(f"_f{c}") for c in cols}).drop(*[f"_f{c}" for c in cols])
        )
    moved = s.bounded(
        lambda d, w: d.withColumns({f"_r{c}": pct_change(F.col(c), w) for c in cols}), back=1
    ).frame()
    pairs = [(i, j) for i in range(len(assets)) for j in range(len(assets))]
    one = moved.agg(*[correlation(F.col(f"_r{cols[i]}"), F.col(f"_r{cols[j]}")).alias(f"_{i}_{j}") for i, j in pairs if i <= j])
    cells = F.array(
        *[
            F.struct(
                F.lit(assets[i]).alias("asset_a"), F.lit(assets[j]).alias("asset_b"),
                F.round(F.col(f"_{min(i, j)}_{max(i, j)}"), 3).alias("corr"),
            )
            for i, j in pairs
        ]
    )
    return one.select(F.explode(cells).alias("c")).select("c.*")


def buy_and_hold(bars: DataFrame, ddof: int = 0, periods: int = 365 * 24) -> DataFrame:
    """Cumulative return, annualised Sharpe ratio and largest drawdown of holding each asset.

    `ddof` picks the population (0) or sample (1) deviation; a constant series has
    Sharpe 0.
    """
    closes = bars.filter(F.col("close").isNotNull()).select("asset", "ts", "close")
    s = bar_series(closes).bounded(lambda d, w: d.withColumn("_r", pct_change(F.col("close"), w)), back=1)
    rows = s.running(_peak=("max", F.col("close"))).frame()
    sd = F.stddev_samp("_r") if ddof else F.stddev_pop("_r")
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    down = F.when(F.col("_peak") == 0, F.col("close") - F.col("_peak")).otherwise((F.col("close") - F.col("_peak")) / F.col("_peak"))
    return rows.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(last - first, first).alias("cumulative_return"),
        F.when(sd > 0, F.avg("_r") / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe_ratio"),
        (-F.min(down)).alias("max_drawdown"),
    ).filter(F.col("n") >= 2)


def normalised_price(bars: DataFrame, base: float = 100.0, by: str = "close") -> DataFrame:
    """Close over the first close times `base`; assets starting at 0 are left out."""
    first = bars.groupBy("asset").agg(F.min_by(by, "ts").alias("_first"))
    out = lookup(bars, first, ["asset"]).filter(F.col("_first") != 0)
    return out.withColumn("normalised", F.col(by) / F.col("_first") * base).drop("_first")


def snapshot(bars: DataFrame, predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per asset: last price, 1-bar and 24-bar return in percent, direction, error metrics.

    Only the last 25 bars of an asset leave their tasks.
    """
    tail = latest_n(bars.select("asset", "ts", "close"), ["asset"], "ts", 25)
    recent = tail.groupBy("asset").agg(
        F.sort_array(F.collect_list(F.struct("ts", "close")), asc=False).alias("_t")
    )

    def back(k: int):
        return F.try_element_at("_t", F.lit(k + 1))["close"]

    prices = recent.select(
        "asset",
        back(0).alias("price"),
        ((F.try_divide(back(0), back(1)) - 1) * 100).alias("ret_1_pct"),
        ((F.try_divide(back(0), back(24)) - 1) * 100).alias("ret_24_pct"),
    )
    d = F.col("predicted_direction")
    last = predictions.groupBy("asset").agg(
        F.max_by("predicted_direction", F.when(d.isNotNull(), F.col("ts"))).alias("_d"),
        F.max_by("signal_strength", F.when(F.col("signal_strength").isNotNull(), F.col("ts"))).alias("signal_strength"),
    )
    out = prices.join(last, "asset", "left").join(metrics.select("asset", "mae", "dir_acc"), "asset", "left")
    return out.withColumn(
        "direction", F.when(F.col("_d") > 0, "UP").when(F.col("_d") < 0, "DOWN").otherwise("NEUTRAL")
    ).drop("_d")


def metrics_pivot(models: Sequence[DataFrame], metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per asset with <model>_<metric> columns from metric tables tagged `model`."""
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), models)
    return tall.groupBy("asset").pivot("model", list(names)).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])


def trade_table_check(df: DataFrame, required: Sequence[str], keys: Sequence[str], ts: str = "exit_time") -> DataFrame:
    """Rows, time range and win rate per key; raises when a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"trade table lacks {missing}")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("win_rate"),
    )


def last_days(df: DataFrame, days: int, ts: str, reference) -> DataFrame:
    """Rows of the `days` days up to `reference` (a datetime or timestamp text)."""
    ref = F.lit(reference).cast("timestamp")
    return df.filter(F.col(ts) >= ref - F.make_dt_interval(days=F.lit(days)))


def of_asset(df: DataFrame, asset: str, col: str = "asset") -> DataFrame:
    return df if asset == "All" else df.filter(F.col(col) == asset)


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts per value, most frequent first, ties by value; with `n` only the top n."""
    out = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = out.orderBy(F.col("n").desc(), "value")
    return ordered.limit(n) if n else ordered


def newest(df: DataFrame, k: int, ts: str, ties: Sequence[str] = ()) -> DataFrame:
    """The k newest rows overall; Spark keeps k rows per task."""
    return df.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties]).limit(k)

