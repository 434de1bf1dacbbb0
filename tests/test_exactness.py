"""Values far back, NULL keys, time bounds of any form, ticks at the same instant."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barflow import session
from barflow.operators import ewm
from barflow.operators.series import arrange
from barflow.sources import readers as RD
from barflow.sources import schemas as SC
from barflow.sources import sinks as SK
from barflow.streaming import jobs as J


def smooth(xs, alpha, seed):
    ys = []
    for k, x in enumerate(xs):
        ys.append(None if k < seed - 1 else sum(xs[:seed]) / seed if k == seed - 1 else alpha * x + (1 - alpha) * ys[-1])
    return ys


@pytest.mark.parametrize(
    "alphas, seed, n", [((0.2,), 1, 3000), ((0.1, 0.5, 0.0005), 1, 1500), ((1 / 14,), 14, 900), ((1.0,), 5, 40), ((0.999999, 0.9), 3, 300)]
)
def test_ewm_is_exact(spark, mode, alphas, seed, n):
    r = random.Random(n)
    xs = [1e25 if k == 2270 else 0.0 for k in range(n)] if alphas == (0.2,) else [r.gauss(0, 1) for _ in range(n)]
    df = spark.createDataFrame([(a, k, x) for a in ("a", None) for k, x in enumerate(xs)], "asset string, k int, x double")
    columns = {f"y{i}": (F.col("x"), a) for i, a in enumerate(alphas)}
    out = ewm.ewm(arrange(df, ["asset"], ["k"]), columns, F.col("x").isNotNull(), seed_rows=seed).frame().collect()
    assert len(out) == 2 * n
    want = [smooth(xs, a, seed) for a in alphas]
    for row in out:
        for i in range(len(alphas)):
            y = want[i][row.k]
            assert row[f"y{i}"] is None if y is None else math.isclose(row[f"y{i}"], y, rel_tol=1e-9, abs_tol=1e-12)


def bars(spark, rows):
    return spark.createDataFrame([(a, "s", t, 1.0, 1.0, 1.0, c, 1.0) for a, t, c in rows], SC.BARS)


def test_time_bounds_of_any_form(spark):
    utc = dt.timezone.utc
    df = bars(spark, [("A", dt.datetime(2024, 1, 31, 19, tzinfo=utc), 1.0), ("A", dt.datetime(2024, 2, 1, tzinfo=utc), 2.0)])
    with_month, without = session.scratch(spark, "bars"), session.scratch(spark, "bars")
    SK.with_month(df).write.partitionBy("asset", "month").parquet(with_month)
    df.write.parquet(without)
    for path in (with_month, without):
        for start, rows in (("2024-01-31 19:00:00", 2), ("2024-02-01 00:00:00+05:00", 2), ("2024-1-05", 2), ("2024-02-01", 1)):
            assert RD.read_bars(spark, path, SC.BARS, start=start).count() == rows, (path, start)
        assert RD.read_bars(spark, path, SC.BARS, end="2024-02-01 01:00:00+05:00").count() == 1


def test_null_is_a_key_and_a_partition(spark):
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    path, other = session.scratch(spark, "t"), session.scratch(spark, "t")
    row = SK.with_month(bars(spark, [(None, at[0], 1.0)]))
    for _ in range(3):
        SK.insert_if_absent(row, other, ["asset", "ts"], ["close"], ["asset", "month"])
    assert spark.read.parquet(other).count() == 1
    SK.upsert(SK.with_month(bars(spark, [(None, at[0], 1.0), ("A", at[0], 5.0), ("B", at[1], 6.0)])), path, ["asset", "ts"], ["close"], ["asset", "month"])
    SK.upsert(SK.with_month(bars(spark, [(None, at[1], 2.0), ("A", at[0], 7.0)])), path, ["asset", "ts"], ["close"], ["asset", "month"])
    got = sorted((r.asset or "", r.ts.day, r.close) for r in spark.read.parquet(path).collect())
    assert got == [("", 1, 1.0), ("", 2, 2.0), ("A", 1, 7.0), ("B", 2, 6.0)]


def test_ticks_at_one_instant_in_two_batches(spark):
    arrivals, out, progress = (session.scratch(spark, x) for x in ("arrivals", "rows", "progress"))
    at = dt.datetime(2024, 1, 1)
    for batch in ([(1, 10.0), (2, 20.0)], [(3, 30.0)], [(2, 99.0), (4, 40.0)]):
        rows = [("A", at, i, x) for i, x in batch]
        spark.createDataFrame(rows, "asset string, ts timestamp, event_id long, price double").write.mode("append").parquet(arrivals)
        J.smoothed(J.watch(spark, arrivals, "*.parquet"), out, progress, alpha=0.5, once=True).awaitTermination()
    got = {r.event_id: r.smoothed for r in J.read_smoothed(spark, out).collect()}
    assert got == {1: 10.0, 2: 15.0, 3: 22.5, 4: 31.25}


def test_column_mismatch_tells_what_differs():
    with pytest.raises(SC.ColumnMismatch) as error:
        SC.validate_columns(["b", "x"], ["a", "b"], "t")
    assert error.value.absent == ["a"] and error.value.unknown == ["x"]
