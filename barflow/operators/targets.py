"""Forward-return targets, the model dataset and the target audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions.columns import clip, direction
from barflow.operators import indicators as I
from barflow.operators.bars import bar_series
from barflow.operators.windows import latest_n

# Fixed values.
THRESHOLD = 0.002
VOL_FLOOR = 1e-6
CLIP = 5.0


def forward_return(c: Column, w, horizon: int) -> Column:
    """ln(close h bars on / close); NULL for the last h bars."""
    return F.ln(F.try_divide(F.lead(c, horizon).over(w), c))


def forward_returns(horizons: dict[str, int]) -> I.Step:
    def fn(d, w):
        return d.withColumns({n: forward_return(F.col("close"), w, h) for n, h in horizons.items()})

    return I.Step(fn, back=1, ahead=max(horizons.values()))


def normalised(ret: Column, vol: Column) -> Column:
    """Return over volatility (at least VOL_FLOOR), clipped; NULL if either is."""
    scaled = ret / F.greatest(vol, F.lit(VOL_FLOOR))
    return F.when(vol.isNotNull(), clip(scaled, -CLIP, CLIP))


def build(bars: DataFrame) -> DataFrame:
    """Returns, directions and volatility-normalised returns 1 and 4 bars ahead."""
    closes = bars.filter(F.col("close").isNotNull()).select("asset", "ts", "close")
    s = I.apply(
        bar_series(closes), forward_returns({"ret_1h": 1, "ret_4h": 4}), I.volatility(20, "vol_target_20")
    )
    out = s.frame().select(
        "asset",
        "ts",
        "ret_1h",
        "ret_4h",
        *[direction(F.col(f"ret_{h}"), THRESHOLD).alias(f"direction_{h}") for h in ("1h", "4h")],
        *[normalised(F.col(f"ret_{h}"), F.col("vol_target_20")).alias(f"norm_ret_{h}") for h in ("1h", "4h")],
        "vol_target_20",
    )
    return drop_empty(out)


def drop_empty(df: DataFrame, cols: Sequence[str] = ("ret_1h", "ret_4h")) -> DataFrame:
    return df.dropna("all", subset=list(cols))


def dataset(features: DataFrame, targets: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Features with a non-NULL target; both sides keyed by (asset, ts)."""
    t = targets.filter(F.col(target).isNotNull()).select("asset", "ts", target)
    return features.select("asset", "ts", *cols).join(t, ["asset", "ts"])


def audit(bars: DataFrame, stored: DataFrame, horizon: int = 1, column: str = "ret_1h") -> DataFrame:
    """Per asset: rows compared, largest gap between stored and recomputed, verdict."""
    closes = bars.filter(F.col("close").isNotNull()).select("asset", "ts", "close")
    manual = I.apply(bar_series(closes), forward_returns({"manual": horizon})).frame()
    both = stored.select("asset", "ts", F.col(column).alias("stored")).join(
        manual.select("asset", "ts", "manual"), ["asset", "ts"]
    )
    gap = F.abs(F.col("stored") - F.col("manual"))
    return both.groupBy("asset").agg(
        F.count(gap).alias("n_compared"),
        F.max(gap).alias("max_abs_diff"),
        F.coalesce(F.max(gap) < 1e-6, F.lit(False)).alias("passed"),
    )


def audit_sample(df: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows per asset chosen by a seeded hash: the same rows on every run and engine."""
    mark = F.md5(F.concat_ws(":", F.lit(seed), "asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    marked = df.withColumn("_mark", mark)
    return latest_n(marked, ["asset"], "_mark", n, ties=["ts"]).drop("_mark")
