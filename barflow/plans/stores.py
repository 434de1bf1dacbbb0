"""Stored tables: each query writes to a fresh folder and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow import session
from barflow.functions.output import tidy
from barflow.operators import evaluation as E
from barflow.plans.oracle import ARTICLES, BARS_D, BARS_H, FORECASTS, LR, VOL, rd, rds, ts, with_
from barflow.plans.registry import query
from barflow.sources import adapters as A
from barflow.sources import readers as RD
from barflow.sources import schemas as SC
from barflow.sources import sinks as SK

PARTS = ["asset", "month"]
KEY = ["asset", "ts", "month"]


def _bars(spark, sf):
    return SC.conform(A.bars_daily(spark, sf), SC.BARS)


def _store(df, parts=("asset", "month")):
    path = session.scratch(df.sparkSession, "table")
    SK.insert_if_absent(SK.with_month(df), path, KEY, ["close"], list(parts))
    return path


@query(
    "s01_read_bars",
    with_(BARS_D)
    + f"SELECT asset, {ts()}, {rds('open', 'close')}, true AS market_open FROM b WHERE asset = '5-LOW' AND ts >= TIMESTAMP '1996-02-10' AND ts < TIMESTAMP '1998-07-03'",
)
def _(spark, sf):
    path = _store(_bars(spark, sf))
    df = RD.read_bars(spark, path, SC.BARS, "5-LOW", "1996-02-10", "1998-07-03")
    return tidy(df.select("asset", "ts", "open", "close", "market_open"))


@query(
    "s02_read_news",
    with_(ARTICLES)
    + f"SELECT url, title, {ts('timestamp_utc', 'published_at')} FROM a WHERE timestamp_utc >= TIMESTAMP '2024-01-10' AND timestamp_utc < TIMESTAMP '2024-01-12 06:00:00'",
)
def _(spark, sf):
    a = A.articles(spark, sf).withColumnRenamed("timestamp_utc", "published_at")
    path = session.scratch(spark, "news")
    SK.append(SC.conform(a, SC.NEWS), path)
    df = RD.read_news(spark, path, SC.NEWS, "2024-01-10", "2024-01-12 06:00:00")
    return tidy(df.select("url", "title", "published_at"))


@query("s03_read_closes", with_(BARS_H) + f"SELECT asset, {ts()}, {rds('close')} FROM b WHERE volume >= 3")
def _(spark, sf):
    b = SC.conform(A.bars_hourly(spark, sf), SC.BARS)
    path = _store(b.withColumn("close", F.when(F.col("volume") >= 3, F.col("close"))))
    return tidy(RD.read_closes(spark, path, SC.BARS))


CSV_DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@query("s04_read_csv", "SELECT doc_id, text, n_chars FROM documents")
def _(spark, sf):
    path = session.scratch(spark, "csv")
    docs = A.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    absent = RD.read_csv(spark, path + "-absent", CSV_DOC)
    return RD.union_all(RD.read_csv(spark, path, CSV_DOC), absent)


KINDS = ("click", "error", "purchase", "signup", "view")


@query("s05_tagged_files", "SELECT event_type AS asset, event_id, round(value, 6) + 0.0 AS value FROM events")
def _(spark, sf):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    base = session.scratch(spark, "tagged")
    e = A.table(spark, sf, "events")
    for asset in KINDS:
        e.filter(F.col("event_type") == asset).select("event_id", "value").write.option("header", True).csv(f"{base}/{asset}")
    return tidy(RD.read_tagged(spark, {a: f"{base}/{a}" for a in (*KINDS, "absent")}, schema))


@query(
    "s10_insert_if_absent",
    with_(BARS_H) + f"SELECT asset, {ts()}, {rd('CASE WHEN volume >= 2 THEN close ELSE close + 1 END', 'close')} FROM b",
)
def _(spark, sf):
    b = SC.conform(A.bars_hourly(spark, sf), SC.BARS)
    path = _store(b.filter("volume >= 2"))
    again = SK.with_month(b.withColumn("close", F.col("close") + 1))
    SK.insert_if_absent(again, path, KEY, ["close"], PARTS)
    return tidy(RD.read_bars(spark, path, SC.BARS).select("asset", "ts", "close"))


@query(
    "s11_upsert",
    with_(BARS_H) + f"SELECT asset, {ts()}, {rd('CASE WHEN volume >= 3 THEN close * 2 ELSE close END', 'close')} FROM b",
)
def _(spark, sf):
    b = SC.conform(A.bars_hourly(spark, sf), SC.BARS)
    path = _store(b)
    SK.upsert(SK.with_month(b.filter("volume >= 3").withColumn("close", F.col("close") * 2)), path, KEY, ["close"], PARTS)
    return tidy(RD.read_bars(spark, path, SC.BARS).select("asset", "ts", "close"))


def _predictions(spark, sf):
    f = E.derived(A.forecasts(spark, sf)).withColumns({"prediction_horizon": F.lit(4), "target_mode": F.lit("raw")})
    return SC.conform(f, SC.PREDICTIONS)


@query(
    "s12_replace_slice",
    with_(BARS_H, LR, VOL, FORECASTS)
    + f"SELECT asset, prediction_horizon, {ts()}, {rd('p', E.P)} FROM (SELECT asset, ts, 4 AS prediction_horizon, CASE WHEN asset = 'view' THEN p * 2 ELSE p END AS p FROM f UNION ALL SELECT asset, ts, 1, p FROM f WHERE asset = 'view')",
)
def _(spark, sf):
    path = session.scratch(spark, "predictions")
    p = _predictions(spark, sf)
    SK.replace_slice(p, path)
    SK.replace_slice(p.filter("asset = 'view'").withColumn("prediction_horizon", F.lit(1)), path)
    SK.replace_slice(p.filter("asset = 'view'").withColumn(E.P, F.col(E.P) * 2), path)
    return tidy(spark.read.parquet(path).select("asset", "prediction_horizon", "ts", E.P))


@query(
    "s13_delete_where",
    with_(BARS_H, LR, VOL, FORECASTS) + f"SELECT asset, target_mode, {ts()} FROM f, (VALUES ('raw'), ('rawXtest')) m(target_mode) WHERE p <= 0.05::DOUBLE",
)
def _(spark, sf):
    path = session.scratch(spark, "predictions")
    p = _predictions(spark, sf)
    for mode in ("raw", "raw_test", "rawXtest"):
        SK.replace_slice(p.withColumn("target_mode", F.lit(mode)), path)
    slices = ["asset", "prediction_horizon", "target_mode"]
    SK.delete_where(spark, path, SK.ends_with("target_mode", "_test"), slices)
    SK.delete_where(spark, path, F.col(E.P) > 0.05, slices)
    return tidy(spark.read.parquet(path).select("asset", "target_mode", "ts"))


@query(
    "s14_append_log",
    with_(BARS_H, LR, VOL, FORECASTS)
    + f"SELECT asset, run, {rd('mae', 'test_mae')} FROM (SELECT asset, 'first' AS run, avg(abs(p - a)) AS mae FROM f GROUP BY 1 UNION ALL SELECT asset, 'second', avg(abs(a)) FROM f GROUP BY 1)",
)
def _(spark, sf):
    path = session.scratch(spark, "experiments")
    m = E.metrics(A.forecasts(spark, sf), ["asset"])
    SK.append(m.select("asset", F.lit("first").alias("run"), F.col("mae").alias("test_mae")), path)
    SK.append(m.select("asset", F.lit("second").alias("run"), F.col("zero_mae").alias("test_mae")), path)
    return tidy(spark.read.parquet(path))


@query(
    "s15_latest_news",
    with_(
        ARTICLES,
        "k AS (SELECT *, row_number() OVER (PARTITION BY url, asset ORDER BY confidence > 0.5 DESC, timestamp_utc DESC, event_id DESC) AS rn FROM a)",
    )
    + "SELECT url, asset, event_id FROM k WHERE rn = 1",
)
def _(spark, sf):
    path = session.scratch(spark, "latest")
    # by a hash of the url, so that a batch rewrites the folders of its own urls
    a = A.articles(spark, sf).select(
        "url", "asset", "event_id", "timestamp_utc", "confidence", F.pmod(F.xxhash64("url"), F.lit(16)).alias("shelf")
    )
    order, key, shelf = ["timestamp_utc", "event_id"], ["url", "asset"], ["shelf"]
    SK.upsert(a.filter("confidence <= 0.5"), path, key, order, shelf)
    SK.upsert(a.filter("confidence > 0.5"), path, key, order, shelf)
    return spark.read.parquet(path).select("url", "asset", "event_id")


@query(
    "s16_export_csv",
    with_(BARS_H, LR, VOL, FORECASTS)
    + f"SELECT asset, {ts()}, printf('%.8f', p) AS {E.P}, CASE WHEN vol IS NOT NULL THEN printf('%.8f', vol) END AS vol FROM f",
)
def _(spark, sf):
    path = session.scratch(spark, "export")
    SK.export_csv(A.forecasts(spark, sf).select("asset", "ts", E.P, "vol"), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("asset", "ts", E.P, "vol")])
    return RD.read_csv(spark, path, schema)


@query(
    "s17_run_log",
    with_(BARS_H)
    + "SELECT 'bars' AS source, asset, 'ok' AS status, count(*) + count(*) FILTER (volume >= 3) AS rows_attempted, count(*) AS rows_saved, 1 AS has_time FROM b GROUP BY asset",
)
def _(spark, sf):
    path = session.scratch(spark, "log")
    bars = A.bars_hourly(spark, sf)
    SK.log_run(bars, path, "bars", attempted=bars.unionByName(bars.filter("volume >= 3")))
    out = spark.read.parquet(path)
    return out.select("source", "asset", "status", "rows_attempted", "rows_saved", F.col("run_at").isNotNull().cast("int").alias("has_time"))


@query(
    "s18_conform",
    with_(BARS_D) + f"SELECT asset, NULL::VARCHAR AS source, {ts()}, {rds('open', 'high', 'low', 'close', 'volume')} FROM b",
)
def _(spark, sf):
    raw = A.bars_daily(spark, sf)
    raw = raw.withColumns({"volume": F.col("volume").cast("int"), "extra": F.lit(1)}).select("extra", *reversed(raw.columns))
    return tidy(SC.conform(raw, SC.BARS))


@query(
    "s19_date_windows",
    """WITH d AS (SELECT ts::DATE AS d FROM events), e AS (SELECT min(d) AS s, max(d) + 1 AS e FROM d)
    SELECT strftime(s + (floor((d - s) / 7) * 7)::INT, '%Y-%m-%d') AS window_start, strftime(least(s + (floor((d - s) / 7) * 7 + 7)::INT, e), '%Y-%m-%d') AS window_end, count(*) AS n
    FROM d, e GROUP BY 1, 2""",
)
def _(spark, sf):
    return tidy(RD.cut_windows(A.table(spark, sf, "events"), "ts", 7))


@query(
    "s19_backfill_windows",
    """WITH d AS (SELECT ts::DATE AS d FROM events), e AS (SELECT min(d) AS s, max(d) + 1 AS e FROM d)
    SELECT strftime(greatest(e - (floor((e - d - 1) / 4) * 4 + 4)::INT, s), '%Y-%m-%d') AS window_start, strftime(e - (floor((e - d - 1) / 4) * 4)::INT, '%Y-%m-%d') AS window_end, count(*) AS n
    FROM d, e GROUP BY 1, 2""",
)
def _(spark, sf):
    return tidy(RD.cut_windows(A.table(spark, sf, "events"), "ts", 4, backwards=True))


@query(
    "j10_uncached_keys",
    with_(BARS_H) + f"SELECT asset, {ts()} FROM b WHERE volume < 4",
)
def _(spark, sf):
    b = A.bars_hourly(spark, sf).select("asset", "ts", "volume")
    return tidy(SK.missing_keys(b, b.filter("volume >= 4"), ["asset", "ts"]).select("asset", "ts"))


@query(
    "j10_matching_keys",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return SK.matching_keys(A.table(spark, sf, "orders"), c, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(
    "u01_union_missing",
    "SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
)
def _(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return RD.union_all(c, s)
