"""Correlation of returns between any number of assets, as a product of matrix blocks.

Times are numbered and cut into slices, assets are numbered and cut into blocks. The returns
of a block in a slice are one matrix; a pair of blocks adds up, slice by slice, what its
correlations need: six products of matrices. The plan is the same for any number of assets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session
from barflow.functions.columns import pct_change
from barflow.operators.series import arrange

SLICE_TIMES = 1024
BLOCK_ASSETS = 64
# Slices whose products one task adds up at a time.
SLICES_TOGETHER = 16
SUMS = ("n", "x", "y", "xx", "yy", "xy")
# A variance below this share of the mean square is rounding.
_CONSTANT = 1e-12


def _pack(size: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One matrix, times x assets, from the runs of a slice and a block; a run is a return at its first time, if any, and no move after it."""

    def pack(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        col = (runs["_i"] % BLOCK_ASSETS).to_numpy()
        first, last = ((runs[c] - key[0] * size).to_numpy() for c in ("_first", "_last"))
        # runs of carried prices, marked by where they start and where they are over
        edge = np.zeros((size + 1, BLOCK_ASSETS), np.int32)
        flat = last > first
        np.add.at(edge, (np.maximum(first[flat] + 1, 0), col[flat]), 1)
        np.add.at(edge, (np.minimum(last[flat], size - 1) + 1, col[flat]), -1)
        live = edge[:size].cumsum(0) > 0
        x = np.zeros((size, BLOCK_ASSETS))
        r = runs["_r"].to_numpy(float)
        own = ~np.isnan(r) & (first >= 0)
        x[first[own], col[own]] = r[own]
        live[first[own], col[own]] = True
        base = np.zeros(BLOCK_ASSETS)
        base[col] = runs["_base"].fillna(0.0)
        x = np.where(live, x - base, 0.0)
        return pd.DataFrame({"_s": [key[0]], "_m": [key[1]], "x": [x.tobytes()], "live": [live.tobytes()]})

    return pack


def _multiply(size: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What the correlations of a pair of blocks need, added up over the slices given."""

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b, c = int(key[0]), int(key[1])
        total = np.zeros((len(SUMS), BLOCK_ASSETS, BLOCK_ASSETS))
        for _, own in rows.groupby("_s"):
            at = {int(m): k for k, m in enumerate(own["_m"])}
            if b in at and c in at:
                x, y = (np.frombuffer(own["x"].iloc[at[m]]).reshape(size, BLOCK_ASSETS) for m in (b, c))
                p, q = (np.frombuffer(own["live"].iloc[at[m]], bool).reshape(size, BLOCK_ASSETS).astype(float) for m in (b, c))
                total += np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])
        i, j = np.indices(total[0].shape).reshape(2, -1)
        out = pd.DataFrame({"_i": b * BLOCK_ASSETS + i, "_j": c * BLOCK_ASSETS + j} | {s: t.ravel() for s, t in zip(SUMS, total)})
        return out[(out["_i"] <= out["_j"]) & (out["n"] > 0)]

    return multiply


def _sums(runs: DataFrame, blocks: Column, size: int) -> DataFrame:
    """_i, _j and SUMS for pairs of assets _i <= _j that meet. A matrix goes to every pair of blocks it is part of."""
    matrices = runs.groupBy("_s", F.floor(F.col("_i") / BLOCK_ASSETS).alias("_m")).applyInPandas(_pack(size), "_s bigint, _m bigint, x binary, live binary")
    matrices = session.settle(matrices, "matrices")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks)).alias("_o")
    dealt = matrices.select("*", other).select(
        F.least("_m", "_o").alias("_b"), F.greatest("_m", "_o").alias("_c"), F.floor(F.col("_s") / SLICES_TOGETHER).alias("_g"), "_s", "_m", "x", "live"
    )
    shape = "_i bigint, _j bigint, " + ", ".join(f"{c} double" for c in SUMS)
    parts = dealt.groupBy("_b", "_c", "_g").applyInPandas(_multiply(size), shape)
    return parts.groupBy("_i", "_j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlations(bars: DataFrame, fill: bool = True, digits: int = 3, slice_times: int = SLICE_TIMES) -> DataFrame:
    """asset_a, asset_b, corr: every pair of assets of `bars` (asset, ts, close), both ways and each with itself.

    The correlation of percent changes over the times both have, rounded. Times are those of any asset; closes of an asset
    at one time are averaged, and gaps carried forward (`fill`). NULL where one is constant or the two never meet. A change
    from a price of 0 is missing. NULL is an asset; rows without a time are left out; an empty table gives no rows.
    """
    session.ship(bars.sparkSession)
    closes = bars.filter(F.col("ts").isNotNull()).groupBy("asset", "ts").agg(F.avg("close").alias("close"))
    closes = session.settle(closes, "closes")
    times = session.settle(arrange(closes.select("ts").distinct(), [], ["ts"]).position("_p").frame(), "times")
    names = session.settle(arrange(closes.select("asset").distinct(), [], ["asset"]).position("_i").frame(), "assets")
    by_name = names.select(F.col("asset").alias("_name"), "_i")
    placed = closes.join(times, "ts").join(by_name, F.col("asset").eqNullSafe(F.col("_name"))).select("_i", "_p", "close")
    placed = session.settle(placed.filter(F.col("close").isNotNull()), "placed")

    def moved(d: DataFrame, w) -> DataFrame:
        d = d.withColumns({"_r": pct_change(F.col("close"), w), "_before": F.lag("_p").over(w), "_next": F.lead("_p").over(w)})
        return d if fill else d.withColumn("_r", F.when(F.col("_before") == F.col("_p") - 1, F.col("_r")))

    s = arrange(placed, ["_i"], ["_p"]).bounded(moved, back=1, ahead=1).frame()
    last = F.col("_p")
    if fill:
        end = times.agg(F.max("_p")).scalar()
        last = F.when(F.col("close") != 0, F.coalesce(F.col("_next") - 1, end)).otherwise(last)
    s = session.settle(s.select("_i", F.col("_p").alias("_first"), last.alias("_last"), F.col("_r").cast("double").alias("_r")), "moves")
    # returns are counted from an asset's first one: a constant side comes out as exactly that
    base = s.groupBy("_i").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_first"))).alias("_base"))
    n = F.lit(slice_times)
    runs = s.filter(F.col("_r").isNotNull() | (F.col("_last") > F.col("_first"))).join(session.settle(base, "base"), "_i")
    runs = runs.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_first") / n), F.floor(F.col("_last") / n))))
    blocks = names.agg(F.floor(F.max("_i") / BLOCK_ASSETS)).scalar()
    sums = _sums(runs, blocks, slice_times)
    n, x, y, xx, yy, xy = (F.col(c) for c in SUMS)
    vx, vy = xx - x * x / n, yy - y * y / n
    varied = (vx > _CONSTANT * xx) & (vy > _CONSTANT * yy)
    corr = F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - x * y / n) / F.sqrt(vx * vy))))
    half = session.settle(sums.select("_i", "_j", F.round(corr, digits).alias("corr")), "correlations")
    found = half.unionByName(half.filter("_i < _j").select(F.col("_j").alias("_i"), F.col("_i").alias("_j"), "corr"))
    # the result has a row for every pair, whether they meet or not
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), names.agg(F.max("_i")).scalar()))
    grid = names.select(F.col("asset").alias("asset_a"), "_i", every.alias("_j")).join(names.select(F.col("asset").alias("asset_b"), F.col("_i").alias("_j")), "_j")
    return grid.join(found, ["_i", "_j"], "left").select("asset_a", "asset_b", "corr")
