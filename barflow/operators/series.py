"""Ordered series that scale past one task per key.

A window partitioned by asset puts an asset's whole history into one task, and
four assets keep four cores busy. `arrange` looks at the size first:

* up to `barflow.series.singleTaskBytes` the plain window is the better plan;
* beyond it the rows are range-partitioned on (keys, order), which splits hot
  keys, written once to the shared scratch folder, and given their exact
  position. Blocks of equal row counts then replace keys as the unit of work.

Both forms answer the same calls, so every operator is written once:
`bounded` for frames with a known look-back and look-ahead, `running` for
frames that reach the start or the end of the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barflow import session

# Series id, position in the series, block of positions, block a row is sent to.
SID, POS, BLK, TGT = "_sid", "_pos", "_blk", "_tgt"
# Blocks whose totals are added up in one step.
BLOCKS_PER_GROUP = 1024


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def lookup(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join per-key statistics, such as one row per asset.

    Before it runs, Spark takes an aggregate for nearly as large as its input and
    would shuffle `df` by a handful of keys. Where the input is large the statistics
    are written first: Spark then knows their size, and broadcasts them if small.
    """
    if not session.fits_one_task(stats):
        stats = session.settle(stats, "stats")
    return null_safe_join(df, stats, keys)


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool
    block_rows: int = 0

    @property
    def _inner(self) -> list[str]:
        return [SID, BLK] if self.blocked else list(self.keys)

    def _window(self, reverse: bool = False) -> WindowSpec:
        order = [POS] if self.blocked else list(self.order)
        cols = [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in order]
        return Window.partitionBy(*self._inner).orderBy(*cols)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "Series":
        """Row-wise step; `fn` must neither drop nor add rows."""
        return replace(self, df=fn(self.df))

    def bounded(
        self,
        fn: Callable[[DataFrame, WindowSpec], DataFrame],
        back: int = 0,
        ahead: int = 0,
    ) -> "Series":
        """Apply window columns that read at most `back` earlier and `ahead` later rows."""
        if not self.blocked:
            return replace(self, df=fn(self.df, self._window()))
        n = F.lit(self.block_rows)
        first = F.floor(F.greatest(F.col(POS) - F.lit(ahead), F.lit(0)) / n)
        last = F.floor((F.col(POS) + F.lit(back)) / n)
        spread = self.df.withColumn(TGT, F.explode(F.sequence(first, last)))
        w = Window.partitionBy(SID, TGT).orderBy(POS)
        # Keeping the target column as the block lets Spark reuse its partitioning.
        out = fn(spread, w).filter(F.col(TGT) == F.col(BLK)).drop(BLK).withColumnRenamed(TGT, BLK)
        return replace(self, df=out)

    def running(self, reverse: bool = False, **specs: tuple[str, Column]) -> "Series":
        """Columns over the frame from the series start (or end, `reverse`) to each row.

        A spec is (kind, column); kinds: sum, count, max, min, last, peak. `last` is the
        nearest non-NULL value, which forward-fills, or back-fills when reversed. `peak` is the
        highest running sum so far: one call, so one pass, where a sum and its maximum would take two.
        In blocks the rows are written with what their block comes to so far, and
        every block's total next to them: calls that follow each other read one table each.
        """
        w = self._window(reverse).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        peaks = [n for n, (kind, _) in specs.items() if kind == "peak"]
        plain = {n: spec for n, spec in specs.items() if n not in peaks} | {f"_s_{n}": ("sum", specs[n][1]) for n in peaks}
        rows = self.df.withColumns({n: _over(kind, c).over(w) for n, (kind, c) in plain.items()})
        if peaks:
            rows = rows.withColumns({n: F.max(f"_s_{n}").over(w) for n in peaks}).drop(*[f"_s_{n}" for n in peaks])
        if not self.blocked:
            return replace(self, df=rows)
        on = self._inner
        local = session.settle(rows, "running")
        totals = local.groupBy(*on).agg(
            *[_total(kind, c, reverse).alias(f"_t_{n}") for n, (kind, c) in plain.items()], *[F.max(n).alias(f"_t_{n}") for n in peaks]
        )
        totals = session.settle(totals, "totals")
        carries = _carried(totals, {n: kind for n, (kind, _) in plain.items()}, reverse)
        if peaks:  # a block's peak stands on the sum of the blocks before it
            lifted = totals.join(carries, on).select(*on, *[_lifted(F.col(f"_t_{n}"), n).alias(f"_t_{n}") for n in peaks])
            carries = session.settle(carries.join(_carried(lifted, dict.fromkeys(peaks, "max"), reverse), on), "carries")
        out = local.join(carries, on, "left").withColumns(
            {n: _combine("max", _lifted(F.col(n), n), F.col(f"_c_{n}")) if kind == "peak" else _combine(kind, F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in specs.items()}
        ).drop(*[f"_c_{n}" for n in (*plain, *peaks)])
        return replace(self, df=out)

    def fixed(self) -> "Series":
        """Rows of a series in blocks written as they are, to be read more than once."""
        return replace(self, df=session.settle(self.df, "series")) if self.blocked else self

    def position(self, name: str) -> "Series":
        """0-based row position within the key."""
        if self.blocked:
            return replace(self, df=self.df.withColumn(name, F.col(POS)))
        return replace(self, df=self.df.withColumn(name, (F.row_number().over(self._window()) - 1).cast("long")))

    def frame(self) -> DataFrame:
        return self.df.drop(SID, POS, BLK) if self.blocked else self.df


def arrange(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bound: Sequence[DataFrame] = (),
) -> Series:
    """Series of `df` per `keys` in ascending `order`, which should end in a tie-break.

    `bound` names frames whose summed size bounds that of `df`, for inputs such as
    joins on unique keys whose own estimate is a product.
    """
    if session.fits_one_task(*(bound or [df])):
        return Series(df, tuple(keys), tuple(order), blocked=False)
    return _blocked(df, tuple(keys), tuple(order))


def _blocked(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Series:
    spark = df.sparkSession
    rows = session.setting(spark, session.BLOCK_ROWS)
    path = session.scratch(spark, "series")
    sort = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    # The row id is taken after the sort, so it numbers the rows of each file in
    # order. Writing it fixes the numbering: a lost executor rereads the file.
    (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_mid", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    laid = spark.read.parquet(path).withColumn("_part", F.shiftright("_mid", 33))
    runs = laid.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *keys,
        "_part",
        "_first",
        F.min("_first").over(per_key).alias(SID),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    # One row per key and file: broadcast unless there are very many keys.
    placed = (
        lookup(laid, starts, [*keys, "_part"])
        .withColumn(POS, F.col("_before") + F.col("_mid") - F.col("_first"))
        .withColumn(BLK, F.floor(F.col(POS) / F.lit(rows)))
        .drop("_mid", "_part", "_first", "_before")
    )
    return Series(placed, keys, order, blocked=True, block_rows=rows)


def _carried(totals: DataFrame, kinds: dict[str, str], reverse: bool) -> DataFrame:
    """SID, BLK, _c_ columns: what the blocks before each block come to.

    Blocks are taken in groups, so one task sees a group's blocks or a series' groups, never all its blocks.
    """
    totals = totals.withColumn("_g", F.floor(F.col(BLK) / BLOCKS_PER_GROUP))

    def before(part: Sequence[str], by: str) -> WindowSpec:
        order = F.col(by).desc() if reverse else F.col(by).asc()
        return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    within = totals.select(SID, BLK, "_g", *[_over(_fold(k), F.col(f"_t_{n}")).over(before([SID, "_g"], BLK)).alias(f"_c_{n}") for n, k in kinds.items()])
    groups = totals.groupBy(SID, "_g").agg(*[_total(_fold(k), F.col(f"_t_{n}"), reverse, BLK).alias(f"_t_{n}") for n, k in kinds.items()])
    ahead = groups.select(SID, "_g", *[_over(_fold(k), F.col(f"_t_{n}")).over(before([SID], "_g")).alias(f"_p_{n}") for n, k in kinds.items()])
    both = within.join(ahead, [SID, "_g"]).select(SID, BLK, *[_combine(_fold(k), F.col(f"_c_{n}"), F.col(f"_p_{n}")).alias(f"_c_{n}") for n, k in kinds.items()])
    return session.settle(both, "carries")


def _over(kind: str, c: Column) -> Column:
    if kind == "last":
        return F.last(c, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c)


def _fold(kind: str) -> str:
    return "sum" if kind == "count" else kind


def _total(kind: str, c: Column, reverse: bool, by: str = POS) -> Column:
    if kind != "last":
        return _over(kind, c)
    pick = F.min_by if reverse else F.max_by
    return pick(c, F.when(c.isNotNull(), F.col(by)))


def _lifted(peak: Column, name: str) -> Column:
    return _combine("sum", peak, F.col(f"_c__s_{name}"))


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "min":
        return F.least(local, carry)
    return F.coalesce(local + carry, local, carry)
