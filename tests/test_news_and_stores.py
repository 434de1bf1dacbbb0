from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions import text as TX
from barflow.operators import news as N
from barflow.sources import normalize as Z
from barflow.sources import readers as RD
from barflow.sources import schemas as SC
from barflow.sources import sinks as SK
from barflow.streaming import jobs as J


def articles(spark):
    """Nine articles from 10:05 on, one per hour, alternating in tone; the last repeats a URL."""
    rows = [
        (f"https://n/{min(i, 7)}", "BTC rally and record gains" if i % 2 == 0 else "BTC crash and losses", f"20260401T{10 + min(i, 7)}0500Z")
        for i in range(9)
    ]
    raw = spark.createDataFrame(rows, "URL string, Title string, seendate string")
    df = Z.normalize_articles(raw, "btc").withColumn("timestamp_utc", TX.parse_seen(F.col("seendate")))
    return N.score(df.withColumn("text_for_sentiment", F.col("title"))).withColumnRenamed("score", "sentiment_score")


def test_articles_end_to_end(spark, mode):
    a = articles(spark)
    assert a.count() == 8 and {"domain", "language", "sourcecountry"} <= set(a.columns)
    hourly = N.hourly(a)
    out = N.shift(hourly).orderBy("ts").toPandas()
    assert len(out) == 8 and out.iloc[0].drop(["asset", "ts"]).eq(0).all()
    assert out["sentiment_mean"].tolist() == [0, 1, -1, 1, -1, 1, -1, 1]
    assert out.notna().all().all()
    late = N.shift(hourly, "calendar").orderBy("ts").toPandas()
    assert str(late["ts"][0]) == "2026-04-01 11:00:00" and late["sentiment_mean"][0] == 1
    assert N.to_wide(hourly, "BTC").columns == ["timestamp_utc", *SC.sentiment_columns("BTC")]
    assert N.shift(N.hourly(a.limit(0))).count() == 0


def test_bad_dates_and_missing_urls(spark):
    df = spark.createDataFrame([("x", None), ("soon", "u"), ("20260401T100000Z", "u")], "seendate string, url string")
    got = [r[0] for r in df.select(TX.parse_seen(F.col("seendate"))).collect()]
    assert got[0] is None and got[1] is None and str(got[2]) == "2026-04-01 10:00:00"


def test_lexicon_scorer_contract(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("profit and loss",), ("Strong rally!",), ("crash",)], "t string")
    got = [tuple(r) for r in N.score(df, text="t").select("label", "confidence", "score").collect()]
    assert got == [("neutral", 0.0, 0)] * 4 + [("positive", 1.0, 1), ("negative", 1.0, -1)]


def test_batch_scorer_failures_are_neutral(spark):
    def make():
        def run(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model failed")
            return [("POSITIVE" if "up" in t else "odd", 0.9) for t in texts]

        return run

    df = spark.createDataFrame([("up",), ("boom",), (None,), ("?",)], "t string").coalesce(1)
    got = {r["t"]: (r["label"], r["score"]) for r in N.score_with(df, make, text="t").collect()}
    assert got == {"up": ("positive", 1), "boom": ("neutral", 0), None: ("neutral", 0), "?": ("odd", 0)}


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"alpha_1": 0.5, "alpha_2": -3}', (0.5, -1.0, 0.0)),
        ('```json\n{"alpha_1": 2}\n```', (1.0, 0.0, 0.0)),
        ('```\n{"alpha_3": 0.25}\n``` trailing', (0.0, 0.0, 0.25)),
        ('{"alpha_1": "high", "alpha_2": 0.4}', (0.0, 0.0, 0.0)),
        ("no json", (0.0, 0.0, 0.0)),
        (None, (0.0, 0.0, 0.0)),
    ],
)
def test_alpha_json(spark, reply, want):
    r = spark.createDataFrame([(reply,)], "t string").select(TX.parse_alphas(F.col("t")).alias("s")).first()["s"]
    assert (r["alpha_1"], r["alpha_2"], r["alpha_3"]) == want


def test_article_on_the_hour_joins_its_own_bar(spark, mode):
    bars = spark.createDataFrame(pd.DataFrame({"asset": "a", "ts": pd.date_range("2026-01-01", periods=3, freq="h")}))
    arts = spark.createDataFrame(pd.DataFrame({"asset": "a", "timestamp_utc": pd.to_datetime(["2026-01-01 01:00", "2026-01-01 01:01", "2026-01-01 09:00"])}))
    got = [str(r["bar_ts"]) for r in N.align_to_bars(arts, bars).orderBy("timestamp_utc").collect()]
    assert got == ["2026-01-01 01:00:00", "2026-01-01 02:00:00"]


def test_normalize_ohlcv(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "2", "x", 1), ("2024-01-01", "1", "5", 2), ("2024-01-01", "9", "5", 3), ("never", "1", "1", 4)],
        "Datetime string, Open string, Close string, no int",
    )
    got = Z.normalize_ohlcv(raw, "BTC", order=["no"]).orderBy("ts").select("symbol", "open", "close").collect()
    assert [tuple(r) for r in got] == [("BTC", 1.0, 5.0), ("BTC", 2.0, None)]


def sample(spark, close=1.0, days=60, assets=("a", "b")):
    pdf = pd.concat([pd.DataFrame({"asset": x, "ts": pd.date_range("2024-01-01", periods=days), "close": close}) for x in assets])
    return SK.with_month(SC.conform(spark.createDataFrame(pdf), SC.BARS))


KEY, PARTS = ["asset", "ts", "month"], ["asset", "month"]


def test_insert_if_absent_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "bars")
    twice = sample(spark).unionByName(sample(spark, close=2.0))
    assert SK.insert_if_absent(twice, path, KEY, ["close"], PARTS) == SK.Written(240, 120)
    assert SK.insert_if_absent(sample(spark, close=9.0), path, KEY, ["close"], PARTS) == SK.Written(120, 0)
    assert SK.insert_if_absent(sample(spark, close=9.0, days=61), path, KEY, ["close"], PARTS).saved == 2
    got = RD.read_bars(spark, path, SC.BARS).groupBy("close").count().collect()
    assert {r["close"]: r["count"] for r in got} == {1.0: 120, 9.0: 2}


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "bars")
    SK.upsert(sample(spark), path, KEY, ["close"], PARTS)
    before = {f: os.stat(f.removeprefix("file://").removeprefix("file:")).st_mtime_ns for f in spark.read.parquet(path).inputFiles()}
    batch = sample(spark, close=5.0, days=1, assets=("a",))
    for _ in range(2):
        SK.upsert(batch, path, KEY, ["close"], PARTS)
    after = spark.read.parquet(path)
    assert after.count() == 120 and after.filter("close = 5").count() == 1
    kept = [f for f in after.inputFiles() if f in before]
    assert len(kept) == len(before) - 1
    assert RD.read_bars(spark, path, SC.BARS, "a", "2024-01-01", "2024-01-02").first()["close"] == 5.0


def test_reads_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    SK.upsert(sample(spark), path, KEY, ["close"], PARTS)
    plan = RD.read_bars(spark, path, SC.BARS, "a", "2024-02-01", "2024-02-10")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(asset" in scan and "month" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(ts" in plan


def test_touched_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "bars")
    SK.upsert(sample(spark), path, KEY, ["close"], PARTS)
    batch = sample(spark, days=3, assets=("a",))
    old = SK._touched(spark.read.parquet(path), batch, PARTS)
    assert old.count() == 31
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = old._jdf.queryExecution().executedPlan().toString()
    part = next(line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters" in line)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert ">= a)" in part and "<= a)" in part and "2024-01" in part


def test_delete_and_replace(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("a", 4, m, i) for m in ("raw", "raw_test", "rawXtest") for i in range(3)]
    df = spark.createDataFrame(rows, "asset string, prediction_horizon int, target_mode string, v int")
    SK.replace_slice(df, path)
    slices = ["asset", "prediction_horizon", "target_mode"]
    assert SK.delete_where(spark, path, SK.ends_with("target_mode", "_test"), slices) == 3
    assert SK.delete_where(spark, path, F.col("v") == 0, slices) == 2
    SK.replace_slice(df.filter("target_mode = 'raw'").withColumn("v", F.lit(7)), path)
    got = sorted((r["target_mode"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("raw", 7)] * 3 + [("rawXtest", 1), ("rawXtest", 2)]
    assert SK.delete_where(spark, str(tmp_path / "none"), F.lit(True)) == 0


def test_absent_tables_are_empty(spark, tmp_path):
    assert RD.read_news(spark, str(tmp_path / "x"), SC.NEWS).count() == 0
    assert RD.read_csv(spark, str(tmp_path / "y.csv"), SC.SENTIMENT).columns == SC.SENTIMENT.names


def test_date_windows(spark):
    got = [tuple(map(str, r)) for r in RD.date_windows(spark, "2024-01-01", "2024-01-17", 7).collect()]
    assert got == [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-17")]
    assert RD.date_windows(spark, "2024-01-01", "2024-01-01", 7).count() == 0


def ticks(spark, start, n, first_id):
    pdf = pd.DataFrame({"asset": "a", "ts": pd.date_range(start, periods=n, freq="10min"), "price": [float(i % 7) for i in range(n)], "volume": 1.0, "event_id": range(first_id, first_id + n)})
    return spark.createDataFrame(pdf)


def test_stream_bars_drop_late_ticks(spark, tmp_path):
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    ticks(spark, "2024-01-01 00:00", 30, 0).coalesce(1).write.parquet(src)

    def run():
        J.bars(J.watch(spark, src, "*.parquet"), "1 hour", out, chk, once=True).awaitTermination()
        return {str(r["ts"]): r["volume"] for r in spark.read.parquet(out).collect()}

    # 04:50 less 10 minutes has passed the end of the fourth hour
    assert run() == {f"2024-01-01 0{h}:00:00": 6.0 for h in range(4)}
    ticks(spark, "2024-01-01 00:05", 2, 900).coalesce(1).write.mode("append").parquet(src)
    ticks(spark, "2024-01-01 05:00", 12, 100).coalesce(1).write.mode("append").parquet(src)
    got = run()
    assert got["2024-01-01 00:00:00"] == 6.0 and got["2024-01-01 04:00:00"] == 6.0 and got["2024-01-01 05:00:00"] == 6.0


def test_stream_smoothing_resumes(spark, tmp_path, mode):
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    parts = [ticks(spark, "2024-01-01", 40, 0), ticks(spark, "2024-01-02", 25, 100), ticks(spark, "2024-01-03", 30, 200)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
        J.smoothed(J.watch(spark, src, "*.parquet"), out, chk, alpha=0.3, once=True).awaitTermination()
    got = J.read_smoothed(spark, out).orderBy("event_id").toPandas()
    prices = pd.concat([p.toPandas() for p in parts], ignore_index=True)["price"]
    pd.testing.assert_series_equal(got["smoothed"], prices.ewm(alpha=0.3, adjust=False).mean(), check_names=False)


def test_stream_articles_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    for day in (1, 2):
        pdf = pd.DataFrame({"url": ["u1", "u1", f"d{day}"], "timestamp_utc": pd.Timestamp(f"2024-01-0{day}"), "event_id": range(3)})
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(src)
        J.unique_articles(J.watch(spark, src, "*.parquet"), out, chk, ["event_id"], once=True).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["d1", "d2", "u1"]
