"""Smoothing of a stream with keyed state, in parallel along each series.

y[k] = a*x[k] + (1-a)*y[k-1] runs from tick to tick, but over a stretch it is an affine
map of what came before. So state is kept for each (asset, stretch of time), not for each
asset: stretches are smoothed in tasks of their own, from zero, however many ticks one
asset has, and reading composes them. A timer clears a stretch once the watermark is past it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barflow import session
from barflow.operators import ewm as W

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_ID = -(1 << 63)
_ROWS = "asset string, stretch bigint, at bigint, event_id bigint, x double, n bigint, z double"


class Stretches(StatefulProcessor):
    """Ticks of one (asset, stretch), each with its number `n` in the stretch and `z`, the recurrence from zero.

    The state is the number, z and place of the last tick. A micro-batch's ticks of one stretch are sorted here; one that
    is not after the stretch's last one is dropped. A tick without a value has no z and no number of its own.
    """

    def __init__(self, alpha: float, width_us: int):
        self.alpha, self.width_us = alpha, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "n bigint, z double, at bigint, id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
        n, z = 0, 0.0
        if self.last.exists():
            n, z, at, last_id = self.last.get()
            ticks = ticks[(ticks["at"] > at) | ((ticks["at"] == at) & (ticks["id"] > last_id))].reset_index(drop=True)
        else:
            self.handle.registerTimer((int(key[1]) + 1) * self.width_us // 1000)
        if not len(ticks):
            return
        x = ticks["x"].to_numpy(float)
        here = ~np.isnan(x)
        along = pd.Series(np.concatenate([[z], x[here]])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]
        values = np.full(len(x), np.nan)
        values[here] = along
        numbers = n + np.cumsum(here)
        end = float(along[-1]) if len(along) else float(z)
        self.last.update((int(numbers[-1]), end, int(ticks["at"].iloc[-1]), int(ticks["id"].iloc[-1])))
        yield pd.DataFrame(
            {"asset": key[0], "stretch": key[1], "at": ticks["at"], "event_id": ticks["id"], "x": x, "n": numbers, "z": values}
        )

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def _settings(spark: SparkSession, path: str) -> dict | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.text(f"{path}/settings").first()[0])


def smoothed(
    ticks: DataFrame, path: str, checkpoint: str, alpha: float, value: str = "price", once: bool = False,
    stretch: str = "1 day", late: str = "10 minutes",
) -> StreamingQuery:
    """Exponentially weighted value per asset across micro-batches, of ticks in the order of (ts, event_id).

    `stretch` is the unit of state and of work: a fixed length of time, of which one task takes an asset's ticks of one
    micro-batch; take a shorter one for busier assets. Dropped are ticks older than the watermark, the latest time less
    `late`, ticks that are not after the last one of their stretch, and ticks without a time. What is kept is smoothed in
    order, whichever micro-batch a stretch came with. A missing value is NULL in the result and skipped; a NULL event_id
    comes first at its instant; NULL is an asset. Rows are written by Spark's file sink, each once, also after a restart
    from the checkpoint; a table is smoothed by one alpha and one stretch, given again at each start.
    """
    spark = ticks.sparkSession
    width = spark.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + interval {stretch})")).first()[0]
    wanted = {"alpha": alpha, "width_us": width}
    known = _settings(spark, path)
    if known is None:
        spark.createDataFrame([(json.dumps(wanted),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
    elif known != wanted:
        raise ValueError(f"smoothed with {known} so far, not {wanted}")
    session.ship(spark)
    at = F.unix_micros("ts")
    rows = ticks.filter(F.col("ts").isNotNull()).withWatermark("ts", late).select(
        "asset", F.floor(at / F.lit(width)).alias("stretch"), "ts", at.alias("at"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(value).cast("double").alias("x"),
    )
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # read when a query starts
    try:
        out = rows.groupBy("asset", "stretch").transformWithStateInPandas(Stretches(alpha, width), _ROWS, "Append", "EventTime")
        writer = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start(f"{path}/rows")
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def read_smoothed(spark: SparkSession, path: str) -> DataFrame:
    """asset, ts, event_id, value, smoothed: the stretches written so far, composed along each asset."""
    rows = spark.read.parquet(f"{path}/rows")
    alpha = _settings(spark, path)["alpha"]
    whole = W.compose(rows, "asset", "stretch", F.col("n") - 1, "x", "z", alpha, "smoothed")
    return whole.select(
        "asset", F.timestamp_micros("at").alias("ts"), F.when(F.col("event_id") != NO_ID, F.col("event_id")).alias("event_id"),
        F.col("x").alias("value"), "smoothed",
    )
