"""Exponentially weighted recurrences without a sequential pass.

y[0] = x[0], y[k] = a*x[k] + (1-a)*y[k-1] over the non-NULL x of a series, k
counting them. With d = 1-a, a stretch of rows adds z[j] = sum of a*x[i] * d**(j-i)
to what came before it, decayed by d**(j+1): a prefix sum, if the stretch is short
enough for d**-j to stay a double. Stretches then compose as affine maps (decay, add).

* A series that is one task per key is cut by k, so after a few stretches the decay is
  below the least double, and a fixed number of earlier ends, carried along the rows,
  gives the result to the last bit. The plan has windows only; it reads its input once.
* A series in blocks writes its rows with what their stretch adds, and one summary row
  for each stretch: all columns of a call go together. Summaries are scanned in two levels
  and joined back once. However many calls follow each other, each reads one table.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import session
from barflow.operators.series import BLK, POS, SID, Series

_RANGE = 600.0  # d**-stretch = exp(600), about 1e260
_NOTHING = 1500.0  # exp(-1500) times the largest double is below the least one
_SPREAD = 16.0  # most times that decay rates of one pass differ
_FANOUT = 1024  # summaries that one step of the scan folds


def _rate(alpha: float) -> float:
    return -math.log1p(-alpha) if alpha < 1.0 else math.inf


def _passes(values: dict[str, tuple[Column, float]]) -> list[list[str]]:
    """Names by decay rate, those near each other together."""
    groups: list[list[str]] = []
    for n in sorted(values, key=lambda n: _rate(values[n][1])):
        if groups and _rate(values[n][1]) <= _SPREAD * _rate(values[groups[-1][0]][1]):
            groups[-1].append(n)
        else:
            groups.append([n])
    return groups


def ewm(s: Series, values: dict[str, tuple[Column, float]], present: Column, seed_rows: int = 1, min_obs: int = 1) -> Series:
    """Add name -> smoothed value for name -> (column, alpha), 0 < alpha <= 1.

    All columns must be non-NULL exactly where `present` holds; elsewhere the
    result is NULL and the recurrence skips the row. With `seed_rows` = m > 1 the
    recurrence starts at y[m-1] = mean(x[0..m-1]) and earlier results are NULL, as
    are those with fewer than `min_obs` values so far. Factors far apart take a pass each.
    """
    out = s.map(lambda d: d.withColumns({f"_x_{n}": c.cast("double") for n, (c, _) in values.items()} | {"_here": present}))
    if not s.blocked:
        out = out.running(_k=("count", F.when(F.col("_here"), 1))).map(
            lambda d: d.withColumn("_k", F.when(F.col("_here"), F.col("_k") - 1))
        )
    for names in _passes(values):
        out = (_by_blocks if s.blocked else _by_key)(out, {n: values[n][1] for n in names}, seed_rows)
    shown = F.col("_here") & (F.col("_k") >= max(seed_rows - 1, min_obs - 1))
    df = out.df.withColumns({n: F.when(shown, F.col(n)) for n in values})
    return replace(s, df=df.drop("_k", "_here", *[f"_x_{n}" for n in values]))


def _stretch(alphas: dict[str, float]) -> int:
    fastest = max((r for a in alphas.values() if (r := _rate(a)) < math.inf), default=0.0)
    return max(1, math.floor(_RANGE / fastest)) if fastest else 1_000_000


def _pow(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent.cast("double"))


def _added(alphas: dict[str, float], over, j: Column) -> dict[str, Column]:
    """What a stretch itself adds to each of its rows, the jth with a value."""
    own = {}
    for n, alpha in alphas.items():
        x, d = F.col(f"_x_{n}"), 1.0 - alpha
        own[f"_z_{n}"] = x if d == 0.0 else F.sum(x * alpha * _pow(d, -j)).over(over) * _pow(d, j)
    return own


def _seed(n: str, alpha: float, seed_rows: int, k: Column) -> Column:
    """What the seed rows weigh in their mean beyond their weight in the recurrence."""
    return F.when(k < seed_rows, F.col(f"_x_{n}") * (1.0 / seed_rows - alpha * _pow(1.0 - alpha, seed_rows - 1 - k)))


def _whole(n: str, alpha: float, carry: Column, seed: Column, j: Column, k: Column, seed_rows: int) -> Column:
    """A stretch's own part, what came before it, and the seed's, each decayed; zeros are left out, as 0 times infinity is none."""
    d = 1.0 - alpha
    before = F.when(carry != 0, carry * _pow(d, j + 1)).otherwise(0.0)
    first = F.when(seed != 0, seed * _pow(d, F.greatest(k - (seed_rows - 1), F.lit(0)))).otherwise(0.0)
    return F.col(f"_z_{n}") + F.coalesce(before, F.lit(0.0)) + F.coalesce(first, F.lit(0.0))


def _by_key(s: Series, alphas: dict[str, float], seed_rows: int) -> Series:
    size, k = _stretch(alphas), F.col("_k")
    order = [F.col(c).asc_nulls_first() for c in s.order]
    stretch = Window.partitionBy(*s.keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*s.keys).orderBy(*order)
    so_far, before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, -1)
    j = k - F.col("_c") * size
    df = s.df.withColumn("_c", F.floor(k / size))
    df = df.withColumns(_added(alphas, stretch, j))
    df = df.withColumns({f"_s_{n}": F.sum(_seed(n, a, seed_rows, k)).over(so_far) for n, a in alphas.items()})
    last = k % size == size - 1
    carry = {n: F.lit(0.0) for n in alphas}
    ends = {n: F.col(f"_z_{n}") for n in alphas}
    far = max((math.ceil(_NOTHING / (r * size)) for a in alphas.values() if (r := _rate(a)) < math.inf), default=0)
    for i in range(far):  # the end i + 1 stretches before, carried along the rows
        df = df.withColumns({f"_e{i}_{n}": F.last(F.when(last, ends[n]), ignorenulls=True).over(before) for n in alphas})
        for n, alpha in alphas.items():
            ends[n] = F.col(f"_e{i}_{n}")
            if alpha < 1.0:
                carry[n] = carry[n] + F.coalesce(ends[n], F.lit(0.0)) * math.exp(-_rate(alpha) * size * i)
    df = df.withColumns({n: _whole(n, a, carry[n], F.col(f"_s_{n}"), j, k, seed_rows) for n, a in alphas.items()})
    extra = [f"_e{i}_{n}" for i in range(far) for n in alphas]
    return replace(s, df=df.drop("_c", *extra, *(f"_{c}_{n}" for c in "sz" for n in alphas)))


def _by_blocks(s: Series, alphas: dict[str, float], seed_rows: int) -> Series:
    size = min(_stretch(alphas), s.block_rows)
    unit = [SID, BLK, "_u"]  # stretches don't cross blocks, so blocks stay the partitioning
    over = Window.partitionBy(*unit).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = s.df.withColumn("_u", F.floor(F.col(POS) / size)).withColumn("_j", F.count(F.when(F.col("_here"), 1)).over(over) - 1)
    here = F.col("_here")
    df = df.withColumns({n: F.when(here, c) for n, c in _added(alphas, over, F.col("_j")).items()})
    local = session.settle(df.drop("_k"), "smoothed")
    names = list(alphas)
    first = F.struct(F.col("_j").alias("j"), F.array(*[F.col(f"_x_{n}") for n in names]).alias("x"))
    summary = local.groupBy(*unit).agg(
        F.count(F.when(here, 1)).alias("n"),
        F.array(*[F.coalesce(F.max_by(f"_z_{n}", F.when(here, F.col("_j"))), F.lit(0.0)) for n in names]).alias("z"),
        F.collect_list(F.when(here & (F.col("_j") < seed_rows), first)).alias("firsts"),
    )
    carried = _scan(summary, [alphas[n] for n in names], seed_rows)
    rows = local.join(carried, unit)
    k = F.col("_before") + F.col("_j")
    done = {n: _whole(n, alphas[n], F.col("_y")[i], F.col("_first")[i], F.col("_j"), k, seed_rows) for i, n in enumerate(names)}
    out = rows.withColumns(done | {"_k": F.when(here, k)})
    return replace(s, df=out.drop("_u", "_j", "_before", "_y", "_first", *(f"_z_{n}" for n in names)))


def _scan(summary: DataFrame, alphas: list[float], seed_rows: int) -> DataFrame:
    """For each stretch: how many values (_before) and what recurrence (_y) precede it, and its series' seed (_first).

    Stretches are folded in groups, groups along the series, and the groups' starts go down to their stretches. No step
    holds more than a group's summaries, or one summary for each group of a series.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array(*[F.lit(0.0)] * len(alphas)).alias("z"))

    def then(a: Column, b: Column) -> Column:
        z = [a["z"][i] * _pow(1.0 - alpha, b["n"]) + b["z"][i] for i, alpha in enumerate(alphas)]
        return F.struct((a["n"] + b["n"]).alias("n"), F.array(*z).alias("z"))

    def starts(parts: str, first: Column) -> Column:
        """What precedes each part: one entry more than there are parts."""
        return F.aggregate(parts, F.array(first), lambda acc, b: F.array_append(acc, then(F.element_at(acc, -1), b)))

    part = F.struct(F.col("_u").alias("u"), F.col(BLK).alias("blk"), "n", "z", "firsts")
    groups = summary.groupBy(SID, F.floor(F.col("_u") / _FANOUT).alias("_g")).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    groups = session.settle(groups, "stretches")
    whole = groups.select(SID, "_g", F.aggregate("_parts", start, then).alias("t"))
    along = whole.groupBy(SID).agg(F.array_sort(F.collect_list(F.struct(F.col("_g").alias("g"), F.col("t.n").alias("n"), F.col("t.z").alias("z")))).alias("_gs"))
    heads = along.select(SID, "_gs", starts("_gs", start).alias("_starts")).select(SID, F.explode(F.arrays_zip("_gs", "_starts")).alias("p"))
    heads = heads.filter(F.col("p._gs").isNotNull()).select(SID, F.col("p._gs.g").alias("_g"), F.col("p._starts").alias("_start"))
    below = groups.join(heads, [SID, "_g"]).select(SID, "_parts", starts("_parts", F.col("_start")).alias("_starts"))
    below = below.select(SID, F.explode(F.arrays_zip("_parts", "_starts")).alias("p")).filter(F.col("p._parts").isNotNull())
    parts = below.select(
        SID, F.col("p._parts.blk").alias(BLK), F.col("p._parts.u").alias("_u"), F.col("p._parts.firsts").alias("_firsts"),
        F.col("p._starts.n").alias("_before"), F.col("p._starts.z").alias("_y"),
    )
    parts = session.settle(parts, "stretches")
    # the first values of a series: those of stretches before which there are fewer than the seed takes
    early = parts.filter(F.col("_before") < seed_rows).select(SID, "_before", F.explode("_firsts").alias("f"))
    k = F.col("_before") + F.col("f.j")
    extra = [1.0 / seed_rows - alpha * _pow(1.0 - alpha, seed_rows - 1 - k) for alpha in alphas]
    sums = [F.sum(F.when(k < seed_rows, F.col("f.x")[i] * e)) for i, e in enumerate(extra)]
    seeds = early.groupBy(SID).agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in sums]).alias("_first"))
    return session.settle(parts.drop("_firsts").join(seeds, SID, "left"), "carries")


def compose(df: DataFrame, key: str, stretch: str, j: Column, x: str, z: str, alpha: float, name: str) -> DataFrame:
    """Add `name`, the recurrence along each key, to rows that hold it within stretches only.

    `stretch` numbers a key's stretches in order, `j` a stretch's rows with a value from 0, and `z` is the recurrence
    from zero within the stretch, NULL where `x` is. One summary row per stretch is scanned in two levels and joined back;
    `df` is read twice, so it should be a stored table.
    """
    here = F.col(z).isNotNull()
    # NULL is a key as well, and joins compare by equality
    sid = F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(key).cast("string")))
    rows = df.withColumns({SID: sid, "_u": F.col(stretch), "_j": j, f"_z_{name}": F.col(z)})
    first = F.struct(F.col("_j").alias("j"), F.array(x).alias("x"))
    summary = rows.groupBy(SID, "_u").agg(
        F.count(F.when(here, 1)).alias("n"),
        F.array(F.coalesce(F.max_by(z, F.when(here, F.col("_j"))), F.lit(0.0))).alias("z"),
        F.collect_list(F.when(here & (F.col("_j") == 0), first)).alias("firsts"),
    )
    carried = _scan(summary.withColumn(BLK, F.lit(0).cast("bigint")), [alpha], 1).drop(BLK)
    both = rows.join(carried, [SID, "_u"])
    k = F.col("_before") + F.col("_j")
    out = both.withColumn(name, F.when(here, _whole(name, alpha, F.col("_y")[0], F.col("_first")[0], F.col("_j"), k, 1)))
    return out.drop(SID, "_u", "_j", "_before", "_y", "_first", f"_z_{name}")


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder(n: int) -> float:
    return 1.0 / n
