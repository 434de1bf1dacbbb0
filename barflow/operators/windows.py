"""Building blocks over ordered series: dedup, latest-N, fill, spine, split, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.series import Series, arrange, lookup, null_safe_join


def dedup(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], keep: str = "first") -> DataFrame:
    """One row per key: the first or last in `order`, which must end in a tie-break.

    Spark keeps one row per key in each task before it shuffles (window group
    limit), so a key with very many copies costs no more than any other.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    cols = [c.asc_nulls_first() if keep == "first" else c.desc_nulls_last() for c in cols]
    w = Window.partitionBy(*key).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).drop("_rn")


def latest_n(
    df: DataFrame, keys: Sequence[str], ts: str, n: int, ties: Sequence[str] = (), salts: int = 64
) -> DataFrame:
    """The latest n rows per key.

    Spark trims to n per key in each task before it shuffles. Many tasks would still
    send n rows of a hot key to one; the first round, over salted keys, leaves at most
    `salts` times n of them, whatever the size of the input.
    """
    order = [F.col(ts).desc(), *[F.col(t).desc() for t in ties]]

    def top(d: DataFrame, part: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        return d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")

    salt = F.pmod(F.xxhash64(ts, *ties), F.lit(salts))
    return top(top(df.withColumn("_salt", salt), [*keys, "_salt"]).drop("_salt"), keys)


def latest(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Latest non-NULL value of each column per key."""
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols]
    )


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    s = arrange(df, keys, order)
    return s.running(**{f"_f_{c}": ("last", F.col(c)) for c in cols}).frame().withColumns(
        {c: F.col(f"_f_{c}") for c in cols}
    ).drop(*[f"_f_{c}" for c in cols])


def distinct_times(*frames: DataFrame, ts: str = "ts") -> DataFrame:
    """Sorted-set union of all timestamps."""
    out = frames[0].select(ts)
    for f in frames[1:]:
        out = out.unionByName(f.select(ts))
    return out.distinct()


def spine(df: DataFrame, keys: Sequence[str], bucket: str, step: str) -> DataFrame:
    """Every bucket from each key's first to its last, `step` apart.

    `df` holds one row per existing bucket. Each row fills the gap up to the next
    one, so no task builds a whole key's calendar.
    """
    s = arrange(df.select(*keys, bucket), keys, [bucket])
    nxt = s.bounded(lambda d, w: d.withColumn("_next", F.lead(bucket, 1).over(w)), ahead=1).frame()
    every = F.expr(f"interval {step}")
    gap = F.when(
        F.col("_next").isNull(), F.array(F.col(bucket))
    ).otherwise(F.sequence(F.col(bucket), F.col("_next") - every, every))
    return nxt.select(*keys, F.explode(gap).alias(bucket))


def on_spine(df: DataFrame, keys: Sequence[str], bucket: str, step: str, fill: dict[str, float] | None = None) -> DataFrame:
    """Add the empty buckets; values are NULL there unless filled."""
    out = null_safe_join(spine(df, keys, bucket, step), df, [*keys, bucket])
    return out.fillna(fill) if fill else out


def split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    train: float = 0.70,
    val: float = 0.15,
    bound: Sequence[DataFrame] = (),
) -> DataFrame:
    """Chronological split: int(train*n) rows, then int(val*n), then the rest."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = arrange(df, keys, order, bound).position("_i").frame()
    cut1 = F.floor(F.col("_n").cast("double") * F.lit(float(train)))
    cut2 = cut1 + F.floor(F.col("_n").cast("double") * F.lit(float(val)))
    return (
        lookup(placed, counts, list(keys))
        .withColumn(
            "split",
            F.when(F.col("_i") < cut1, "train").when(F.col("_i") < cut2, "val").otherwise("test"),
        )
        .drop("_i", "_n")
    )


def sequences(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], length: int = 64
) -> DataFrame:
    """The last `length` feature vectors at each row; rows with fewer are dropped.

    Put the split among the keys so that no sequence crosses it.
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])

    def collect(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_vec", vec).withColumn(
            "sequence", F.collect_list("_vec").over(w.rowsBetween(-(length - 1), 0))
        ).drop("_vec")

    out = arrange(df, keys, order).bounded(collect, back=length - 1).frame()
    return out.filter(F.size("sequence") == length)


def every_nth(s: Series, flag: Column, n: int, name: str) -> Series:
    """True on the 1st, (n+1)th, ... row among the flagged ones."""
    counted = s.running(_nth=("count", F.when(flag, 1)))
    return counted.map(lambda d: d.withColumn(name, flag & ((F.col("_nth") - 1) % n == 0)).drop("_nth"))
