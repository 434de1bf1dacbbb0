"""The driver's tables seen as market data. The SQL twins are in plans/oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import session
from barflow.operators import bars as B
from barflow.operators import indicators as I


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Times come without a zone and mean UTC.
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("asset"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
        "event_id",
    )


def bars_from_ticks(t: DataFrame, step: str, tie: str) -> DataFrame:
    return B.resample(t, step, tie=tie, opens="price", highs="price", lows="price", closes="price")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), "1 hour", "event_id")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("asset"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("volume"),
        "o_orderkey",
    )
    return bars_from_ticks(t, "1 day", "o_orderkey")


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily series stamped at midnight."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(
        *[
            F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(name)
            for name, t in (("dxy", "view"), ("vix", "click"), ("spy", "purchase"))
        ]
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored article per event; a user's events within an hour share a URL."""
    return articles_of(table(spark, sf_dir, "events"))


def articles_of(events: DataFrame) -> DataFrame:
    score = (
        F.when(F.col("event_type").isin("purchase", "signup"), 1)
        .when(F.col("event_type") == "error", -1)
        .otherwise(0)
    )
    return events.select(
        "event_id",
        F.col("event_type").alias("asset"),
        F.col("ts").alias("timestamp_utc"),
        F.concat(F.lit("u/"), "user_id", F.lit("/"), F.date_format("ts", "yyyyMMddHH")).alias("url"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("d"), F.col("user_id") % 20).alias("domain"),
        F.concat(F.lit("c"), F.col("user_id") % 7).alias("sourcecountry"),
        score.alias("sentiment_score"),
        F.when(score == 1, "positive").when(score == -1, "negative").otherwise("neutral").alias("label"),
        (F.from_json("props", "k int")["k"] / 100.0).alias("confidence"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred = 0.1 * last log return, actual = forward 4-bar log return, vol = vol_20."""
    def fn(d, w):
        return d.withColumns(
            {
                "predicted_log_return": F.col(I.LR) * 0.1,
                "actual_log_return": F.ln(F.try_divide(F.lead("close", 4).over(w), F.col("close"))),
            }
        )

    s = I.apply(B.bar_series(bars_hourly(spark, sf_dir)), I.Step(fn, back=1, ahead=4), I.volatility(20, "vol"))
    return (
        s.frame()
        .select("asset", "ts", "close", "predicted_log_return", "actual_log_return", "vol")
        .dropna(subset=["predicted_log_return", "actual_log_return"])
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("exit_reason"),
        F.col("l_linestatus").alias("side"),
        F.col("l_shipdate").alias("exit_time"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("net_pnl"),
        F.col("l_extendedprice").alias("notional_value"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("transaction_cost_total"),
        F.col("l_quantity").alias("holding_bars"),
        (F.col("l_discount") + 0.01).alias("risk_reward_ratio"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
