"""Smoothing with keyed state: against one pass, over restarts, with hot and quiet assets."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest

from barflow import session
from barflow.streaming import jobs as J

SHAPE = "asset string, ts timestamp, event_id long, price double"
START = dt.datetime(2024, 1, 1)


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def run(spark, src, out, progress, **more):
    q = J.smoothed(J.watch(spark, src, "*.parquet"), out, progress, once=True, **{"alpha": 0.2, "stretch": "1 hour"} | more)
    q.awaitTermination()
    return q


@pytest.fixture
def folders(spark):
    return [session.scratch(spark, x) for x in ("arrivals", "rows", "progress")]


def test_hot_asset_over_restarts(spark, folders):
    src, out, progress = folders
    rng = np.random.default_rng(5)
    n = 3000
    at = [START + dt.timedelta(seconds=int(s)) for s in np.sort(rng.integers(0, 86_400, n))]
    assets = [str(a) if a != "none" else None for a in rng.choice(["hot", "b", "none"], n, p=[0.8, 0.1, 0.1])]
    price = [None if i % 50 == 7 else float(p) for i, p in enumerate(100 + rng.normal(size=n).cumsum())]
    rows = list(zip(assets, at, range(n), price))
    for part in (rows[:1200], rows[1200:1201], rows[1201:]):
        # within a micro-batch the order of rows is any
        deliver(spark, src, [part[i] for i in rng.permutation(len(part))])
        run(spark, src, out, progress)
    got = J.read_smoothed(spark, out).toPandas().sort_values("event_id").set_index("event_id")["smoothed"]
    assert len(got) == n
    table = pd.DataFrame(rows, columns=["asset", "ts", "event_id", "price"]).set_index("event_id")
    table["price"] = table["price"].astype(float)
    for _, own in table.groupby(table["asset"].fillna("?")):
        want = own["price"].ewm(alpha=0.2, adjust=False, ignore_na=True).mean().where(own["price"].notna())
        np.testing.assert_allclose(got.loc[own.index].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_no_folder_per_batch_and_state_expires(spark, folders):
    src, out, progress = folders
    for day in range(3):
        deliver(spark, src, [("a", START + dt.timedelta(days=day, hours=h), day * 24 + h, 1.0) for h in range(24)])
        q = run(spark, src, out, progress)
    # 72 stretches were opened; the watermark has passed all but the last
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    assert sorted(os.listdir(out)) == ["rows", "settings"]
    assert not [d for d in os.listdir(f"{out}/rows") if "batch" in d]


def test_late_ticks(spark, folders):
    src, out, progress = folders
    deliver(spark, src, [("a", START, 1, 10.0), ("a", START + dt.timedelta(hours=5), 2, 20.0)])
    run(spark, src, out, progress, alpha=0.5)
    # the first is older than the watermark, the second not after the last tick of its stretch
    deliver(spark, src, [("a", START + dt.timedelta(hours=1), 3, 99.0), ("a", START + dt.timedelta(hours=5), 2, 99.0)])
    deliver(spark, src, [("a", START + dt.timedelta(hours=6), 4, 30.0), ("a", None, 5, 99.0)])
    run(spark, src, out, progress, alpha=0.5)
    got = {r.event_id: r.smoothed for r in J.read_smoothed(spark, out).collect()}
    assert got == {1: 10.0, 2: 15.0, 4: 22.5}


def test_one_alpha_per_table(spark, folders):
    src, out, progress = folders
    deliver(spark, src, [("a", START, None, 1.0)])
    run(spark, src, out, progress)
    assert [tuple(r) for r in J.read_smoothed(spark, out).collect()] == [("a", START, None, 1.0, 1.0)]
    with pytest.raises(ValueError):
        run(spark, src, out, progress, alpha=0.3)


def test_alpha_of_one_and_nothing_to_smooth(spark, folders):
    src, out, progress = folders
    deliver(spark, src, [("a", START, 1, None), ("a", START + dt.timedelta(hours=3), 2, 4.0), ("a", START + dt.timedelta(hours=4), 3, 6.0)])
    run(spark, src, out, progress, alpha=1.0)
    assert {r.event_id: r.smoothed for r in J.read_smoothed(spark, out).collect()} == {1: None, 2: 4.0, 3: 6.0}
