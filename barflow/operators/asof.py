"""As-of joins as one sort of both sides and a carried value; no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.series import arrange


def _asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    tie: Sequence[str],
    forward: bool,
    tolerance: str | None,
    matched_ts: str | None,
) -> DataFrame:
    # On equal times the right row must be met before the left one: it sorts first
    # going backward in time and last going forward.
    right_side, left_side = (1, 0) if forward else (0, 1)
    ties = [f"_tie{i}" for i in range(len(tie))]
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *keys,
        F.col(right_ts).alias("_at"),
        F.lit(right_side).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(tie, ties)],
        F.struct(F.col(right_ts).alias("_match_ts"), *[F.col(v).alias(v) for v in values]).alias("_match"),
    )
    l = left.select(*left.columns, F.col(left_ts).alias("_at"), F.lit(left_side).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    s = arrange(both, keys, ["_at", "_side", *ties], bound=[left, right])
    out = s.running(reverse=forward, _hit=("last", F.col("_match"))).frame()
    hit = F.col("_hit")
    if tolerance:
        gap = F.expr(f"interval {tolerance}")
        near = (
            hit["_match_ts"] <= F.col("_at") + gap if forward else hit["_match_ts"] >= F.col("_at") - gap
        )
        out = out.withColumn("_hit", F.when(near, hit))
    picked = [hit[v].alias(v) for v in values]
    if matched_ts:
        picked.append(hit["_match_ts"].alias(matched_ts))
    return out.filter(F.col("_side") == left_side).select(*left.columns, *picked)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: Sequence[str] = (),
    tolerance: str | None = None,
    matched_ts: str | None = None,
) -> DataFrame:
    """Each left row with the values of the latest right row at or before it.

    Of right rows at one time the last in `tie` order wins. The right row's NULLs
    are taken as they are; forward-fill the right side first to skip them.
    """
    return _asof(left, right, keys, left_ts, right_ts, values, tie, False, tolerance, matched_ts)


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: Sequence[str] = (),
    tolerance: str | None = None,
    matched_ts: str | None = None,
) -> DataFrame:
    """Each left row with the values of the earliest right row at or after it."""
    return _asof(left, right, keys, left_ts, right_ts, values, tie, True, tolerance, matched_ts)
