"""Exact linearly interpolated quantiles without gathering or sorting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import session
from barflow.operators.series import lookup, null_safe_join

# Intervals per octave of the first histogram, and equal parts of an interval in each later one.
PER_OCTAVE, PARTS = 32, 65_536


def quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """One row per key and column: `column`, then one column per named probability.

    NULLs are ignored; a column with none but NULLs gives a row of NULLs; NaN counts as the largest value.

    Small inputs use `percentile`, whose buffer holds a group's distinct values: one round instead of four. In larger ones
    the values at the wanted ranks are found by radix selection. A histogram over intervals of
    a 32nd of an octave gives the interval each rank lies in; two more split that one into 65,536 parts each, which leaves
    some 2 ** 15 neighbouring doubles at most; a last one counts single values. Each of the four aggregations is combined
    in the tasks before its shuffle, so a hot key sends at most its intervals, and no task sorts or holds a group's values.
    """
    keys, group = list(keys), [*keys, "column"]
    if session.fits_one_task(df):
        at = F.array(*[F.lit(float(p)) for p in probs.values()])
        small = df.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), at).alias(c) for c in cols])
        picked = [F.col("_q")[i].alias(n) for i, n in enumerate(probs)]
        return small.unpivot(keys, list(cols), "column", "_q").select(*group, *picked)
    numbers = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    tall = numbers.unpivot(keys, list(cols), "column", "_v").filter(F.col("_v").isNotNull())
    # -0.0 and 0.0 are one value
    tall = tall.withColumn("_v", F.col("_v") + F.lit(0.0))
    counts = numbers.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    sizes = counts.unpivot(keys, list(cols), "column", "_n")

    found = _pick(tall.withColumn("_b", _octave(F.col("_v"))), group, probs)
    for cut in (_part, _part, None):
        within = found.groupBy(*group, "_lo", "_hi", "_before").agg(F.sort_array(F.collect_set("_rank")).alias("_ranks"))
        within = within.groupBy(*group).agg(F.collect_list(F.struct("_lo", "_hi", "_before", "_ranks")).alias("_wanted"))
        rows = lookup(tall, within, group)
        rows = rows.select(*group, "_v", F.explode(F.filter("_wanted", lambda i: F.col("_v").between(i["_lo"], i["_hi"]))).alias("_i"))
        part = F.col("_v") if cut is None else cut(F.col("_v"), F.col("_i._lo"), F.col("_i._hi"))
        rows = rows.select(*group, "_v", F.col("_i._before").alias("_start"), F.col("_i._ranks").alias("_ranks"), part.alias("_b"))
        found = _pick(rows, group)
    at = found.groupBy(*group).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_lo"))).alias("_at"))
    out = null_safe_join(sizes, at, group)
    for name, p in probs.items():
        where = _place(p)
        lo, hi = F.element_at("_at", F.floor(where)), F.element_at("_at", F.ceil(where))
        out = out.withColumn(name, F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (where - F.floor(where))))
    return out.select(*group, *probs)


def _place(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_n") - 1)


def _octave(v: Column) -> Column:
    """Number of an interval, rising with the value; infinities, NaN and 0 have their own."""
    size = F.abs(v)
    step = F.floor(F.log2(size) * PER_OCTAVE) + 40_000
    return (
        F.when(F.isnan(v), F.lit(100_001))
        .when(v == 0, F.lit(0))
        .when(size == float("inf"), F.signum(v) * 100_000)
        .otherwise(F.signum(v) * step)
        .cast("long")
    )


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Which equal part of its interval a value lies in; an interval of one value has one part."""
    return F.when(lo < hi, F.floor((v - lo) / (hi - lo) * PARTS)).otherwise(0).cast("long")


def _pick(rows: DataFrame, group: Sequence[str], probs: dict[str, float] | None = None) -> DataFrame:
    """The parts `_b` in which wanted ranks lie: a row for each rank with `_lo`, `_hi` and `_before`, the values ahead of them.

    With `probs` the rows are whole groups, and the ranks follow from their sizes. Else they are those of split intervals,
    told apart by `_start`, the values ahead of the interval, with the ranks `_ranks` to be found in it.
    """
    whole = probs is not None
    by = list(group) if whole else [*group, "_start", "_ranks"]
    parts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # windows over the parts of one interval, whose number is bounded
    each = Window.partitionBy(*by)
    ahead = F.coalesce(F.sum("_m").over(each.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if whole:
        parts = parts.withColumns({"_before": ahead, "_n": F.sum("_m").over(each)})
        ranks = F.array_distinct(F.array(*[f(_place(p)) for p in probs.values() for f in (F.floor, F.ceil)]))
        parts = parts.withColumn("_ranks", ranks)
    else:
        parts = parts.withColumn("_before", F.col("_start") + ahead)
    inside = F.filter("_ranks", lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_m")))
    return parts.select(*group, "_lo", "_hi", "_before", F.explode(inside).alias("_rank"))
