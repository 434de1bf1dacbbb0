"""Imputation, scaling, ridge and sequence scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow import session
from barflow.functions.columns import finite
from barflow.operators.quantiles import quantiles
from barflow.operators.series import arrange, lookup, null_safe_join


def fit_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact medians, one row per key and one column per feature.

    A feature without any value has a NULL median; drop it with `present_features`.
    """
    q = quantiles(df, keys, cols, {"median": 0.5})
    return q.groupBy(*keys).pivot("column", list(cols)).agg(F.first("median"))


def impute(df: DataFrame, medians: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    m = medians.select(*keys, *[F.col(c).alias(f"_med_{c}") for c in cols])
    out = lookup(df, m, list(keys))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in cols}).drop(*[f"_med_{c}" for c in cols])


def present_features(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key, the features with at least one value."""
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(c) for c in cols])
    kept = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return counts.select(*keys, kept.alias("features"))


def fit_scaler(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation per key and feature; a zero deviation becomes 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"mean_{c}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"std_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std; NULL and non-finite results become 0."""
    s = scaler.select(
        *keys, *[F.col(f"mean_{c}").alias(f"_sm_{c}") for c in cols], *[F.col(f"std_{c}").alias(f"_ss_{c}") for c in cols]
    )
    out = lookup(df, s, list(keys))
    return out.withColumns(
        {
            c: F.coalesce(finite(F.try_divide(F.col(c) - F.col(f"_sm_{c}"), F.col(f"_ss_{c}"))), F.lit(0.0))
            for c in cols
        }
    ).drop(*[f"_{k}_{c}" for k in ("sm", "ss") for c in cols])


def fit_target_scaler(train: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Mean and deviation of the target, the latter at least 1e-8."""
    return train.groupBy(*keys).agg(
        F.avg(target).alias("mean"), F.greatest(F.stddev_pop(target), F.lit(1e-8)).alias("std")
    )


def scale_target(df: DataFrame, scaler: DataFrame, keys: Sequence[str], target: str, name: str = "target_scaled") -> DataFrame:
    s = scaler.select(*keys, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return lookup(df, s, list(keys)).withColumn(name, (F.col(target) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def fit_ridge(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Ridge with an unpenalised intercept: one row per key with coefficients.

    One grouped pass sums what the normal equations need, about p*p/2 numbers per
    key; only the solve of that p by p system runs in Python, one row at a time.
    Products are of values less their mean, which keeps the sums well conditioned.
    """
    session.ship(train.sparkSession)
    keys, cols = list(keys), [*features, target]
    rows = train.dropna(subset=cols)
    centre = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m_{c}") for c in cols])
    near = lookup(rows.select(*keys, *cols), centre.drop("n"), keys)
    dev = [F.col(c) - F.col(f"_m_{c}") for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols)) if i < len(features)]
    gram = near.groupBy(*keys).agg(*[F.sum(dev[i] * dev[j]).alias(f"_g_{i}_{j}") for i, j in pairs])
    stats = null_safe_join(centre, gram, keys).select(
        *keys,
        "n",
        F.array(*[F.col(f"_m_{c}") for c in cols]).alias("means"),
        F.array(*[F.col(f"_g_{i}_{j}") for i, j in pairs]).alias("sums"),
    )
    p = len(features)
    schema = T.StructType(
        [stats.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for means, sums in zip(batch["means"], batch["sums"]):
                g, v = np.zeros((p, p)), np.zeros(p)
                for (i, j), x in zip(pairs, sums):
                    if j == p:
                        v[i] = x
                    else:
                        g[i, j] = g[j, i] = x
                w = np.linalg.solve(g + alpha * np.eye(p), v)
                found.append((float(means[p] - np.dot(w, means[:p])), w.tolist()))
            out = batch[[*keys, "n"]].copy()
            out["intercept"] = [b for b, _ in found]
            out["coefficients"] = [w for _, w in found]
            yield out

    return stats.mapInPandas(solve, schema)


def moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str], centre: DataFrame | None = None) -> DataFrame:
    """Sufficient statistics of `cols`: per key `n`, `sums` (p) and `products` (p * p), both of values less their centre.

    `centre` has one row per key (of its own key columns, which `keys` must include) with a column for any of `cols`;
    a value near the mean will do and keeps the products well conditioned. Where it has none or a NULL, 0 is taken off. A value that is NULL or not finite counts as its centre, as after imputation. Tasks multiply whole Arrow
    batches and send one row per key; rows of several tables, days or runs with the same centre add up by `merge_moments`.
    """
    session.ship(df.sparkSession)
    keys, cols = list(keys), list(cols)
    near = df.select(*keys, *cols)
    if centre is not None:
        by = [c for c in centre.columns if c in keys]
        known = [c for c in cols if c in centre.columns]
        near = lookup(near, centre.select(*by, *[F.col(c).alias(f"_c_{c}") for c in known]), by)
        near = near.withColumns({c: finite(F.col(c)) - F.coalesce(F.col(f"_c_{c}"), F.lit(0.0)) for c in known})
    near = near.select(*keys, *[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in cols])
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [near.schema[k] for k in keys]
        + [T.StructField("n", T.LongType()), T.StructField("sums", numbers), T.StructField("products", numbers)]
    )

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), slice(None))]
            values, found = batch[cols].to_numpy(dtype=float), []
            for _, rows in groups:
                x = values[rows]
                first = batch[keys].iloc[rows[0]].tolist() if keys else []
                found.append([*first, len(x), x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist()])
            yield pd.DataFrame(found, columns=[*keys, "n", "sums", "products"])

    return merge_moments(near.mapInPandas(add_up, schema), keys)


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up rows of `moments` per key, number by number, so that tasks combine them before the shuffle."""
    keys = list(keys)
    cells = F.concat(F.array(F.col("n").cast("double")), "sums", "products")
    flat = parts.select(*keys, F.size("sums").alias("_p"), F.posexplode(cells).alias("_i", "_x"))
    total = flat.groupBy(*keys, "_p", "_i").agg(F.sum("_x").alias("_x"))
    whole = total.groupBy(*keys, "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_a"))
    p = F.col("_p")
    return whole.select(
        *keys,
        F.col("_a")[0].cast("long").alias("n"),
        F.slice("_a", F.lit(2), p).alias("sums"),
        F.slice("_a", p + 2, p * p).alias("products"),
    )


def ridge_of_moments(
    stats: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, centre: DataFrame | None = None, alpha: float = 1.0
) -> DataFrame:
    """Ridge on standardised features from `moments` of [*features, target]; no further pass over the rows.

    Scaling and centring are algebra on the sums: a feature's population deviation of 0 counts as 1, the intercept is not
    penalised. One row per key: `n`, `intercept`, `coefficients` for `predict_linear`, in the features' own units, and
    `means` and `deviations` as `fit_scaler` gives them. `centre` is what `moments` got.
    """
    session.ship(stats.sparkSession)
    keys, features, p = list(keys), list(features), len(features)
    if centre is not None:
        by = [c for c in centre.columns if c in keys]
        shift = F.array(*[F.coalesce(F.col(c).cast("double") if c in centre.columns else F.lit(None), F.lit(0.0)) for c in (*features, target)])
        stats = lookup(stats, centre.select(*by, shift.alias("_shift")), by)
    else:
        stats = stats.withColumn("_shift", F.array_repeat(F.lit(0.0), p + 1))
    stats = stats.withColumn("_shift", F.coalesce("_shift", F.array_repeat(F.lit(0.0), p + 1)))
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [stats.schema[k] for k in keys]
        + [T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType())]
        + [T.StructField(c, numbers) for c in ("coefficients", "means", "deviations")]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for n, sums, products, shift in zip(batch["n"], batch["sums"], batch["products"], batch["_shift"]):
                off = np.asarray(sums) / n
                spread = np.asarray(products).reshape(p + 1, p + 1) - n * np.outer(off, off)
                mean = off + np.asarray(shift)
                # what rounding leaves of a constant column is no deviation
                var = np.diag(spread)[:p] / n
                size = np.abs(np.diag(np.asarray(products).reshape(p + 1, p + 1))[:p]) / n
                sd = np.where(var <= 1e-14 * size, 1.0, np.sqrt(np.maximum(var, 0.0)))
                z = np.where(var <= 1e-14 * size, 0.0, 1.0) / sd
                gram = spread[:p, :p] * np.outer(z, z) + alpha * np.eye(p)
                w = np.linalg.solve(gram, spread[:p, p] * z) * z
                found.append((float(mean[p] - w @ mean[:p]), w.tolist(), mean[:p].tolist(), sd.tolist()))
            out = batch[[*keys, "n"]].copy()
            for i, c in enumerate(("intercept", "coefficients", "means", "deviations")):
                out[c] = [f[i] for f in found]
            yield out

    return stats.mapInPandas(solve, schema)


def predict_linear(df: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "prediction") -> DataFrame:
    out = lookup(df, model.select(*keys, F.col("intercept").alias("_b"), F.col("coefficients").alias("_w")), list(keys))
    total = F.col("_b")
    for i, c in enumerate(features):
        total = total + F.col("_w")[i] * F.col(c)
    return out.withColumn(name, total).drop("_b", "_w")


def score_sequences(
    df: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], sequence: str = "sequence", name: str = "prediction"
) -> DataFrame:
    """Score sequences (rows x steps x features) in batches with a pluggable model.

    `make_model()` runs once per task.
    """
    session.ship(df.sparkSession)
    rest = [c for c in df.columns if c != sequence]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            out = batch[rest].copy()
            x = np.stack([np.stack(s) for s in batch[sequence]]) if len(batch) else np.zeros((0, 0, 0))
            out[name] = np.asarray(model(x), dtype=float) if len(batch) else []
            yield out

    return df.mapInPandas(run, schema)


def score_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str],
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], length: int = 64, name: str = "prediction", block_rows: int = 65_536,
) -> DataFrame:
    """Score the last `length` rows at each row of a series with a pluggable model; rows with fewer before them are dropped.

    The model takes windows x steps x features, as in `score_sequences`, but a row goes to Python once and not once for
    each window it is part of: blocks of a series, with the rows before them that their first windows reach back to, are
    cut into overlapping views there, about a million numbers at a time. A hot key is many blocks. A missing feature is
    NaN for the model; `make_model()` runs once per block. Put the split among the keys so that no window crosses it.
    """
    session.ship(df.sparkSession)
    group = [f"_g{i}" for i in range(len(keys))]
    n = F.lit(block_rows)
    at = arrange(df, keys, order).position("_p").frame()
    own = F.floor(F.col("_p") / n)
    # a row is needed in its own block and in those that begin less than `length` rows after it
    spread = at.withColumn("_b", F.explode(F.sequence(own, F.floor((F.col("_p") + (length - 1)) / n))))
    spread = spread.withColumns(dict(zip(group, (F.struct(k) for k in keys))))  # NULL is a key
    # whole numbers pass as text: pandas makes them doubles where one is missing
    whole = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    spread = spread.withColumns({c: F.col(c).cast("string") for c in whole})
    schema = T.StructType([*(spread.schema[c] for c in df.columns), T.StructField(name, T.DoubleType())])
    columns, at_once = df.columns, max(1, 1_000_000 // (length * max(1, len(features))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_p", ignore_index=True)
        out = rows[columns].iloc[length - 1 :].copy()
        if not len(out):
            out[name] = pd.Series(dtype=float)
            return out
        x = rows[list(features)].astype(float).to_numpy()
        windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).swapaxes(1, 2)
        model = make_model()
        out[name] = np.concatenate([np.asarray(model(windows[i : i + at_once]), dtype=float) for i in range(0, len(windows), at_once)])
        return out  # rows of earlier blocks are length - 1 at most

    scored = spread.groupBy(*group, "_b").applyInPandas(run, schema)
    return scored.withColumns({c: F.col(c).cast(kind) for c, kind in whole.items()})


def linear_model(weights: Sequence[float], intercept: float = 0.0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Default model: a linear map of the last step."""
    def make():
        w = np.asarray(weights, dtype=float)
        return lambda x: x[:, -1, :] @ w + intercept

    return make
