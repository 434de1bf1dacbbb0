"""Incremental versions of the batch operators.

Each takes a streaming DataFrame and a sink folder and returns the running query;
pass `once=True` to work off what is there and stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barflow.operators import bars as B
from barflow.operators import news as N
from barflow.sources import sinks as SK
from barflow.sources.normalize import shift_latency
from barflow.streaming.smoothing import read_smoothed, smoothed

__all__ = ["bars", "hourly_sentiment", "read_smoothed", "smoothed", "unique_articles", "watch"]


def _start(writer, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def bars(ticks: DataFrame, step: str, path: str, checkpoint: str, late: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """OHLCV bars; a bar is written when the watermark passes its end, later ticks drop.

    `ticks` has asset, ts, price, volume, event_id.
    """
    out = B.resample(
        ticks.withWatermark("ts", late), step, tie="event_id", opens="price", highs="price", lows="price", closes="price"
    )
    return _start(out.writeStream.outputMode("append").format("parquet"), path, checkpoint, once)


def hourly_sentiment(
    articles: DataFrame, path: str, checkpoint: str, latency_minutes: int = 0, late: str = "10 minutes", once: bool = False
) -> StreamingQuery:
    """Hourly sentiment with a news latency; the leakage shift is applied on reading."""
    a = shift_latency(articles, latency_minutes).withWatermark("timestamp_utc", late)
    hour = F.window("timestamp_utc", "1 hour").alias("_w")
    out = a.groupBy("asset", hour).agg(*N.hourly_columns()).withColumn("ts", F.col("_w.start")).drop("_w")
    return _start(out.writeStream.outputMode("append").format("parquet"), path, checkpoint, once)


def unique_articles(
    articles: DataFrame, path: str, checkpoint: str, order: list[str], late: str = "2 hours", once: bool = False
) -> StreamingQuery:
    """Articles by URL, each once: copies within the watermark drop in state, older ones
    meet the stored table. A repeated batch adds nothing.
    """
    seen = articles.withWatermark("timestamp_utc", late).dropDuplicatesWithinWatermark(["url"])

    def save(batch: DataFrame, _: int) -> None:
        SK.insert_if_absent(batch, path, ["url"], order)

    return _start(seen.writeStream.foreachBatch(save), "", checkpoint, once)


def watch(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder; zoneless times mean UTC."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    df = reader.parquet(folder)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
