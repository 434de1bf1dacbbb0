"""Series operators against pandas, in one task per key and in blocks of 7 rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow import session
from barflow.operators import ewm as EW
from barflow.operators import series
from barflow.operators import windows as W
from barflow.operators.asof import asof_backward, asof_forward
from barflow.operators.quantiles import quantiles
from barflow.operators.series import arrange
from barflow.plans import registry, trading


def walk(n=120, seed=42, assets=("a", "b", "c"), null_share=0.2):
    """Random walks; the first asset holds most rows, times have gaps."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, a in enumerate(assets):
        m = n if i == 0 else max(3, n // (3 * i + 2))
        x = 100 + np.cumsum(rng.normal(size=m))
        x[rng.random(m) < null_share] = np.nan
        hours = np.sort(rng.choice(5 * n, m, replace=False))
        parts.append(pd.DataFrame({"asset": a, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"), "x": x}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t == "double"})


def collect(df):
    out = df.toPandas().sort_values(["asset", "ts"]).reset_index(drop=True)
    return out


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-9)


def test_bounded_frames(spark, mode):
    pdf = walk()
    s = arrange(to_spark(spark, pdf), ["asset"], ["ts"]).bounded(
        lambda d, w: d.withColumns(
            {"m": F.avg("x").over(w.rowsBetween(-4, 2)), "lead": F.lead("x", 3).over(w), "lag": F.lag("x", 5).over(w)}
        ),
        back=5,
        ahead=3,
    )
    got = collect(s.frame())
    assert s.blocked == (mode == "blocked")
    pdf = pdf.sort_values(["asset", "ts"]).reset_index(drop=True)
    g = pdf.groupby("asset")["x"]
    same(got["lead"], g.shift(-3))
    same(got["lag"], g.shift(5))

    def mean(x):
        return pd.Series([np.nanmean(x[max(0, i - 4) : i + 3]) if not np.isnan(x[max(0, i - 4) : i + 3]).all() else np.nan for i in range(len(x))])

    want = pd.concat([mean(v.to_numpy()) for _, v in g], ignore_index=True)
    same(got["m"], want)


@pytest.mark.parametrize("reverse", [False, True])
def test_running(spark, mode, reverse):
    pdf = walk()
    s = arrange(to_spark(spark, pdf), ["asset"], ["ts"]).running(
        reverse=reverse,
        s=("sum", F.col("x")), n=("count", F.col("x")), hi=("max", F.col("x")), lo=("min", F.col("x")), f=("last", F.col("x")),
    )
    got = collect(s.frame())
    pdf = pdf.sort_values(["asset", "ts"], ascending=[True, not reverse]).reset_index(drop=True)
    g = pdf.groupby("asset")["x"]
    pdf["f"] = g.ffill()
    pdf["n"] = pdf["x"].notna().groupby(pdf["asset"]).cumsum()
    pdf["s"] = pdf["x"].fillna(0).groupby(pdf["asset"]).cumsum().where(pdf["n"] > 0)
    pdf["hi"] = g.cummax().groupby(pdf["asset"]).ffill()
    pdf["lo"] = g.cummin().groupby(pdf["asset"]).ffill()
    pdf = pdf.sort_values(["asset", "ts"]).reset_index(drop=True)
    for c in ("s", "n", "hi", "lo", "f"):
        same(got[c], pdf[c])


@pytest.mark.parametrize("reverse", [False, True])
def test_peak_of_the_running_sum(spark, mode, reverse, monkeypatch):
    """The same as a running sum and then its running maximum, over several groups of blocks, leading NULLs and NULL keys."""
    monkeypatch.setattr(series, "BLOCKS_PER_GROUP", 2)
    rng = np.random.default_rng(5)
    xs = [None] * 20 + [None if k % 9 == 0 else float(x) for k, x in enumerate(rng.normal(size=100) * 1e3)]
    rows = [(a, i, x) for a in ("a", None) for i, x in enumerate(xs)] + [("c", i, None) for i in range(9)] + [("d", 0, -1.0)]
    s = arrange(spark.createDataFrame(rows, "asset string, ts int, x double"), ["asset"], ["ts"])
    want = s.running(reverse=reverse, s=("sum", F.col("x"))).running(reverse=reverse, hi=("max", F.col("s"))).frame()
    got = s.running(reverse=reverse, hi=("peak", F.col("x")), s=("sum", F.col("x"))).frame()
    cols = ("asset", "ts", "x", "s", "hi")
    key = lambda r: (str(r["asset"]), r["ts"])
    have, due = (sorted(df.select(*cols).collect(), key=key) for df in (got, want))
    assert have == due and len(have) == len(rows) and any(r["hi"] > r["s"] for r in have if r["s"] is not None)


def scratch_tables(monkeypatch):
    """Label and path of every scratch table from here on."""
    made, scratch = [], session.scratch

    def watch(spark, label):
        path = scratch(spark, label)
        made.append((label, path))
        return path

    monkeypatch.setattr(session, "scratch", watch)
    return made


def test_the_drawdown_writes_its_rows_twice(spark, monkeypatch):
    """Once in order and once with the sums of their block, with no column that the curve does not need."""
    spark.conf.set(session.SINGLE_TASK_BYTES[0], "-1")
    spark.conf.set(session.BLOCK_ROWS[0], "61")
    trades = spark.createDataFrame(
        [("R" if i % 3 else None, "F", i % 40, float(i % 7 - 3), 1.0, 1.0, 1.0, 1.0, i, 1, 2, 3) for i in range(900)],
        "exit_reason string, side string, exit_time int, net_pnl double, notional_value double, transaction_cost_total double, "
        "holding_bars double, risk_reward_ratio double, l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int",
    )
    monkeypatch.setattr(trading.A, "trades", lambda spark, sf: trades)
    made = scratch_tables(monkeypatch)
    try:
        assert registry.queries()["w26_drawdown"](spark, "").count() == 900
    finally:
        for option, _ in (session.SINGLE_TASK_BYTES, session.BLOCK_ROWS):
            spark.conf.unset(option)
    large = [df for df in (spark.read.parquet(path) for _, path in made) if df.count() == 900]
    assert len(large) == 2
    assert not {c for df in large for c in df.columns} & {"side", "notional_value", "transaction_cost_total", "holding_bars", "risk_reward_ratio"}


@pytest.mark.parametrize("alpha", [0.02, 1 / 14, 0.2, 0.9])
def test_ewm_matches_the_recurrence(spark, mode, alpha):
    pdf = walk(400, null_share=0.0)
    s = EW.ewm(arrange(to_spark(spark, pdf), ["asset"], ["ts"]), {"y": (F.col("x"), alpha)}, F.col("x").isNotNull())
    pdf = pdf.sort_values(["asset", "ts"])
    want = pdf.groupby("asset")["x"].transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean())
    same(collect(s.frame())["y"], want)


def test_ewm_over_many_chunks_and_nulls(spark):
    n = 30_000
    rng = np.random.default_rng(1)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.1] = np.nan
    pdf = pd.DataFrame({"asset": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "min"), "x": x})
    s = EW.ewm(arrange(to_spark(spark, pdf), ["asset"], ["ts"]), {"y": (F.col("x"), 0.3)}, F.col("x").isNotNull())
    got = collect(s.frame())["y"]
    want = pdf["x"].dropna().ewm(alpha=0.3, adjust=False).mean().reindex(pdf.index)
    same(got, want)


def test_ewm_seed(spark, mode):
    pdf = walk(200, null_share=0.0)
    s = EW.ewm(
        arrange(to_spark(spark, pdf), ["asset"], ["ts"]), {"y": (F.col("x"), 1 / 14)}, F.col("x").isNotNull(), seed_rows=14
    )

    def wilder(x):
        y = np.full(len(x), np.nan)
        v = x.to_numpy()
        if len(v) >= 14:
            y[13] = v[:14].mean()
            for i in range(14, len(v)):
                y[i] = (y[i - 1] * 13 + v[i]) / 14
        return pd.Series(y, index=x.index)

    want = pdf.sort_values(["asset", "ts"]).groupby("asset", group_keys=False)["x"].apply(wilder)
    same(collect(s.frame())["y"], want)


def asof_brute(left, right, forward):
    out = []
    for r in left.itertuples():
        c = right[(right.asset == r.asset) & ((right.ts >= r.ts) if forward else (right.ts <= r.ts))]
        c = c.sort_values(["ts", "no"])
        out.append((np.nan if c.empty else (c.iloc[0] if forward else c.iloc[-1]).v))
    return pd.Series(out)


@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, mode, forward):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"asset": rng.choice(list("aab"), 80), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, 80), "h"), "id": range(80)})
    right = pd.DataFrame({"asset": rng.choice(list("aac"), 50), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, 50), "h"), "no": range(50)})
    right["v"] = right["no"].astype(float)
    join = asof_forward if forward else asof_backward
    got = join(spark.createDataFrame(left), spark.createDataFrame(right), ["asset"], ["v"], tie=["no"])
    got = got.toPandas().sort_values("id")["v"].reset_index(drop=True)
    same(got, asof_brute(left, right, forward))


def test_asof_tolerance_and_null_values(spark, mode):
    left = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 00:00:00")], "asset string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("a", "2024-01-01 08:00:00", 1.0), ("a", "2024-01-01 09:30:00", None)], "asset string, t string, v double").withColumn("ts", F.col("t").cast("timestamp"))
    rows = asof_backward(left, right.drop("t"), ["asset"], ["v"], tolerance="2 hours", matched_ts="at").orderBy("ts").collect()
    assert rows[0]["v"] is None and str(rows[0]["at"]) == "2024-01-01 09:30:00"
    assert rows[1]["at"] is None


def test_null_keys_form_their_own_series(spark, mode):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(20)] + [("a", i, 2.0) for i in range(20)], "asset string, ts int, x double")
    got = arrange(df, ["asset"], ["ts"]).running(s=("sum", F.col("x"))).position("p").frame()
    ends = {r["asset"]: (r["s"], r["p"]) for r in got.filter("ts = 19").collect()}
    assert ends == {None: (20.0, 19), "a": (40.0, 19)}


def test_quantiles(spark, mode):
    pdf = walk(150)
    got = quantiles(to_spark(spark, pdf), ["asset"], ["x"], {"q1": 0.25, "med": 0.5, "q9": 0.9}).toPandas().set_index("asset")
    for name, p in (("q1", 0.25), ("med", 0.5), ("q9", 0.9)):
        same(got[name].sort_index(), pdf.groupby("asset")["x"].quantile(p))


def test_quantiles_of_ties_and_nothing(spark, mode):
    df = spark.createDataFrame([("a", 5.0, None)] * 40 + [("a", 7.0, None)] * 2 + [("b", None, None)], "asset string, x double, y double")
    got = {(r["asset"], r["column"]): r["m"] for r in quantiles(df, ["asset"], ["x", "y"], {"m": 0.5}).collect()}
    assert got == {("a", "x"): 5.0, ("a", "y"): None, ("b", "x"): None, ("b", "y"): None}


@pytest.fixture
def large(spark):
    spark.conf.set(session.SINGLE_TASK_BYTES[0], "-1")
    yield
    spark.conf.unset(session.SINGLE_TASK_BYTES[0])


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_any_doubles(spark, large, seed):
    """All magnitudes and signs, neighbouring doubles, infinities and heavy ties: what stands at the ranks, to the last bit."""
    rng = np.random.default_rng(seed)
    wild = rng.normal(size=300) * 10.0 ** rng.integers(-320, 300, 300)
    near = 1.0 + np.arange(200) * 2.0**-52
    values = np.concatenate([wild, near, -near, [0.0, -0.0, 5e-324, np.inf, -np.inf, 1.7e308, -1.7e308], np.full(150, 0.1)])
    values = rng.permutation(values)
    n = len(values)
    probs = {f"r{i}": i / (n - 1) for i in range(0, n, 37)} | {"least": 0.0, "most": 1.0}
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": values})).repartition(6)
    got = quantiles(df, ["k"], ["x"], probs).first().asDict()
    ranked = np.sort(values)
    for name, p in probs.items():
        at = p * (n - 1)
        lo, hi = ranked[int(np.floor(at))], ranked[int(np.ceil(at))]
        assert got[name] == (lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))), name


def test_quantiles_read_the_rows_once_a_level(spark, large):
    df = spark.range(40).selectExpr("id % 3 AS asset", "double(id) AS x")
    q = quantiles(df, ["asset"], ["x"], {"a": 0.2, "b": 0.7})
    # the last histogram, its written intervals, and the sizes for columns without a value
    assert leaves(q) == 3
    assert {r["column"] for r in quantiles(df, [], ["x"], {"m": 0.5}).collect()} == {"x"}
    assert quantiles(df.limit(0), [], ["x"], {"m": 0.5}).first()["m"] is None


def test_spine_fills_gaps(spark, mode):
    pdf = pd.DataFrame({"asset": ["a", "a", "b"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 18:00", "2024-01-02 00:00"]), "n": [1, 2, 3]})
    got = W.on_spine(spark.createDataFrame(pdf), ["asset"], "ts", "6 hours", fill={"n": 0}).orderBy("asset", "ts").collect()
    assert [(r["asset"], r["n"]) for r in got] == [("a", 1), ("a", 0), ("a", 0), ("a", 2), ("b", 3)]


def test_split_and_sequences(spark, mode):
    pdf = walk(100, null_share=0.0)
    s = W.split(to_spark(spark, pdf), ["asset"], ["ts"])
    got = s.groupBy("asset", "split").count().toPandas().set_index(["asset", "split"])["count"].to_dict()
    for a, n in pdf.groupby("asset").size().items():
        want = {"train": int(0.7 * n), "val": int(0.15 * n)}
        want["test"] = n - sum(want.values())
        assert {k: got.get((a, k), 0) for k in want} == want
    seq = W.sequences(s, ["asset", "split"], ["ts"], ["x"], length=8)
    n_seq = seq.groupBy("asset", "split").count().toPandas().set_index(["asset", "split"])["count"].to_dict()
    assert n_seq == {k: n - 7 for k, n in got.items() if n >= 8}


def test_dedup_and_latest(spark, mode):
    df = spark.createDataFrame([("u", i, i % 5) for i in range(300)] + [("v", 1, 9)], "url string, no int, v int")
    assert {(r["url"], r["no"]) for r in W.dedup(df, ["url"], ["v", "no"]).collect()} == {("u", 0), ("v", 1)}
    assert {(r["url"], r["no"]) for r in W.dedup(df, ["url"], ["v", "no"], keep="last").collect()} == {("u", 299), ("v", 1)}
    top = W.latest_n(df, ["url"], "no", 50)
    assert sorted(r["no"] for r in top.filter("url = 'u'").collect()) == list(range(250, 300))


def test_partition_count_does_not_matter(spark, mode):
    df = to_spark(spark, walk())
    got = [
        collect(arrange(df.repartition(k), ["asset"], ["ts"]).running(s=("sum", F.col("x"))).frame())["s"] for k in (1, 5)
    ]
    same(*got)


def test_empty_input(spark, mode):
    df = spark.createDataFrame([], "asset string, ts timestamp, x double")
    assert arrange(df, ["asset"], ["ts"]).running(s=("sum", F.col("x"))).position("p").frame().count() == 0
    assert quantiles(df, ["asset"], ["x"], {"m": 0.5}).count() == 0


def leaves(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def test_chained_plans_stay_small(spark, mode):
    """Smoothing and running columns one after the other: every call reads one table, whatever went before."""
    df = to_spark(spark, walk(60))
    s = arrange(df, ["asset"], ["ts"])
    for k in range(4):
        s = EW.ewm(s, {f"y{k}": (F.col("x"), 0.3), f"z{k}": (F.col("x"), 0.1)}, F.col("x").isNotNull())
        s = s.running(**{f"s{k}": ("sum", F.col(f"y{k}"))})
    assert leaves(s.df) == (1 if mode == "single" else 2)
    assert s.frame().count() == df.count()


def test_ewm_before_any_value(spark, mode):
    """Blocks without a value, values only far on, and a seed that begins in one block and ends in another."""
    xs = [None] * 40 + [1.0, None, 2.0, *[None] * 20, 4.0, *[float(i) for i in range(30)]]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)] + [("b", i, None) for i in range(20)], "asset string, ts int, x double")
    got = EW.ewm(arrange(df, ["asset"], ["ts"]), {"y": (F.col("x"), 0.25)}, F.col("x").isNotNull(), seed_rows=5).frame()
    have = {r["ts"]: r["y"] for r in got.filter("asset = 'a'").collect()}
    assert got.filter("asset = 'b' and y is not null").count() == 0 and len(have) == len(xs)
    values = [(i, x) for i, x in enumerate(xs) if x is not None]
    y = None
    for k, (i, x) in enumerate(values):
        y = None if k < 4 else sum(v for _, v in values[:5]) / 5 if k == 4 else 0.25 * x + 0.75 * y
        assert have.pop(i) == (y if y is None else pytest.approx(y, rel=1e-12))
    assert set(have.values()) == {None}
