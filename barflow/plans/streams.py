"""Streaming jobs run over the event table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow import session
from barflow.functions.output import tidy
from barflow.operators.features import SENTIMENT
from barflow.plans.oracle import ARTICLES, BARS_H, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A
from barflow.streaming import jobs as J


def _events(spark, sf):
    session.prepare(spark)
    return J.watch(spark, sf, "events.parquet")


def _paths(spark):
    return session.scratch(spark, "stream"), session.scratch(spark, "progress")


# A bar is out once the watermark (latest time, in milliseconds, less 10 minutes) passes its end.
CLOSED = "date_trunc('millisecond', (SELECT max({c}) FROM {t})) - INTERVAL 10 MINUTE >= ts + INTERVAL 1 HOUR"


@query(
    "r01_stream_bars",
    with_(BARS_H) + f"SELECT asset, {ts()}, {rds('open', 'high', 'low', 'close', 'volume')} FROM b WHERE {CLOSED.format(c='ts', t='events')}",
)
def _(spark, sf):
    out, progress = _paths(spark)
    J.bars(A.ticks_of(_events(spark, sf)), "1 hour", out, progress, once=True).awaitTermination()
    return tidy(spark.read.parquet(out))


LATE = """l AS (SELECT * REPLACE (timestamp_utc + INTERVAL 15 MINUTE AS timestamp_utc) FROM a),
h AS (SELECT asset, date_trunc('hour', timestamp_utc) AS ts, avg(sentiment_score) AS sentiment_mean, coalesce(stddev_samp(sentiment_score), 0) AS sentiment_std,
  count(url)::DOUBLE AS news_volume, avg((sentiment_score = 1)::INT) AS positive_ratio, avg((sentiment_score = -1)::INT) AS negative_ratio, avg(confidence) AS avg_confidence FROM l GROUP BY 1, 2)"""


@query(
    "r02_stream_sentiment",
    with_(ARTICLES, LATE) + f"SELECT asset, {ts()}, {rds(*SENTIMENT)} FROM h WHERE {CLOSED.format(c='timestamp_utc', t='l')}",
)
def _(spark, sf):
    out, progress = _paths(spark)
    J.hourly_sentiment(A.articles_of(_events(spark, sf)), out, progress, latency_minutes=15, once=True).awaitTermination()
    return tidy(spark.read.parquet(out))


@query("r03_stream_unique_articles", with_(ARTICLES) + "SELECT DISTINCT url, left(url, 2) AS prefix FROM a")
def _(spark, sf):
    out, progress = _paths(spark)
    J.unique_articles(A.articles_of(_events(spark, sf)), out, progress, ["timestamp_utc", "event_id"], once=True).awaitTermination()
    return spark.read.parquet(out).select("url", F.substring("url", 1, 2).alias("prefix"))


EWM_SQL = """k AS (SELECT event_type AS asset, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events),
e(asset, event_id, k, y) AS (SELECT asset, event_id, k, value FROM k WHERE k = 0
  UNION ALL SELECT k.asset, k.event_id, k.k, 0.1::DOUBLE * k.value + 0.9::DOUBLE * e.y FROM e JOIN k ON k.asset = e.asset AND k.k = e.k + 1)"""


@query("r04_stream_smoothed", with_(EWM_SQL, recursive=True) + f"SELECT asset, event_id, {rds('y').replace('AS y', 'AS smoothed')} FROM e")
def _(spark, sf):
    out, progress = _paths(spark)
    arrivals = session.scratch(spark, "arrivals")
    e = A.table(spark, sf, "events")
    # Three deliveries, each smoothed before the next one comes, so that state is carried twice.
    first, second = F.lit("2024-01-11").cast("timestamp"), F.lit("2024-01-21").cast("timestamp")
    at = F.coalesce(F.when(F.col("ts") >= second, 2), F.when(F.col("ts") >= first, 1), F.lit(0))
    for delivery in range(3):
        e.filter(at == delivery).write.mode("append").parquet(arrivals)
        J.smoothed(A.ticks_of(J.watch(spark, arrivals, "*.parquet")), out, progress, alpha=0.1, once=True).awaitTermination()
    return tidy(J.read_smoothed(spark, out).select("asset", "event_id", "smoothed"))
