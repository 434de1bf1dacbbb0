"""Raw feeds to the schemas of `schemas`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import finite
from barflow.operators.windows import dedup
from barflow.sources.schemas import ARTICLES

_NESTED = (
    "content struct<title:string,summary:string,pubDate:string,"
    "canonicalUrl:struct<url:string>,provider:struct<displayName:string>>"
)
_FLAT = "datetime bigint, headline string, title string, source string, url string, summary string"


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def normalize_ohlcv(df: DataFrame, symbol: str | Column, order: Sequence[str] = ()) -> DataFrame:
    """Raw price rows as (symbol, ts, open, high, low, close, volume).

    The time is the column named datetime, date or index, else the first; rows whose
    time does not parse are dropped. Values that are no number become NULL. Of rows
    with one time the first in `order` (default: the price columns) stays.
    """
    out = lower_names(df)
    stamp = next((c for c in ("datetime", "date", "index") if c in out.columns), out.columns[0])
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in out.columns]
    extra = [c.lower() for c in order]
    out = out.select(
        (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"),
        F.expr(f"try_cast(`{stamp}` as timestamp)").alias("ts"),
        *[finite(F.expr(f"try_cast(`{c}` as double)")).alias(c) for c in prices],
        *[F.col(c) for c in extra],
    ).filter(F.col("ts").isNotNull())
    return dedup(out, ["symbol", "ts"], extra or prices).select("symbol", "ts", *prices)


def flatten_nested_news(df: DataFrame, json: str = "json") -> DataFrame:
    """Nested feed items; a date that does not parse becomes the epoch."""
    c = F.from_json(json, _NESTED)["content"]
    return df.select(
        F.coalesce(c["title"], F.lit("")).alias("title"),
        F.coalesce(c["canonicalUrl"]["url"], F.lit("")).alias("url"),
        F.coalesce(F.try_to_timestamp(c["pubDate"]), F.timestamp_seconds(F.lit(0))).alias("published_at"),
        F.coalesce(c["provider"]["displayName"], F.lit("")).alias("source"),
        F.coalesce(c["summary"], F.lit("")).alias("summary"),
    )


def flatten_feed(df: DataFrame, json: str = "json", default_source: str = "feed") -> DataFrame:
    """Flat feed items with epoch seconds; headline, else title, else empty."""
    j = F.from_json(json, _FLAT)

    def text(*names: str) -> Column:
        return F.coalesce(*[F.nullif(j[n], F.lit("")) for n in names], F.lit(""))

    return df.select(
        text("headline", "title").alias("title"),
        F.date_format(F.timestamp_seconds(F.coalesce(j["datetime"], F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(
            "published_at"
        ),
        F.coalesce(j["source"], F.lit(default_source)).alias("source"),
        text("url").alias("url"),
        text("summary").alias("summary"),
    )


def normalize_articles(
    df: DataFrame, asset: str | Column, query: str | Column = "unknown", order: Sequence[str] = ("seendate", "title")
) -> DataFrame:
    """Article feed with all required columns, tagged, one row per (asset, URL): the first in `order`."""
    out = lower_names(df)
    for f in ARTICLES.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = out.withColumn("asset", F.upper(F.lit(asset) if isinstance(asset, str) else asset))
    out = out.withColumn("query", F.lit(query) if isinstance(query, str) else query)
    return dedup(out, ["asset", "url"], order)


def usable(df: DataFrame) -> DataFrame:
    """Records that have a URL and a time."""
    return df.filter((F.coalesce("url", F.lit("")) != "") & F.col("published_at").isNotNull())


def shift_latency(df: DataFrame, minutes: int, ts: str = "timestamp_utc") -> DataFrame:
    """News counts as known `minutes` after it was seen."""
    return df.withColumn(ts, F.col(ts) + F.make_dt_interval(mins=F.lit(minutes))) if minutes else df
