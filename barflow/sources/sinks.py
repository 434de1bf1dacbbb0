"""Idempotent sinks on partitioned Parquet.

Tables that grow are partitioned by asset and month (`with_month`): a batch then
reads and rewrites only the partitions it touches, however large an asset is.
NULL is a key and a partition like any other: it equals itself. Writes that depend on what
is stored go through a commit log (`commits`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow import session
from barflow.operators.windows import dedup
from barflow.sources import commits as CM
from barflow.sources.readers import month_of
from barflow.sources.schemas import RUN_LOG, conform


# Parts that the stored keys of a table without partitions are kept in.
KEY_BUCKETS = 64


@dataclass(frozen=True)
class Written:
    attempted: int
    saved: int


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("month", month_of(ts))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None before its first write. Its schema is kept with it; only foreign tables have footers read."""
    if not CM.holds_files(spark, path):
        return None
    try:
        known = CM.schema(spark, path)
        reader = spark.read.schema(known) if known else spark.read.option("mergeSchema", "true")
        return reader.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write(df: DataFrame, path: str, parts: Sequence[str], mode: str) -> None:
    CM.remember(df.sparkSession, path, df.schema)
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*parts) if parts else w).parquet(path)


def _apply(spark: SparkSession, path: str, claim: dict, again: bool) -> None:
    """Put a claimed write into the table; `again` after a writer died, when any part of it may be there already."""
    rows = spark.read.schema(T.StructType.fromJson(claim["schema"])).parquet(claim["staged"]) if claim.get("staged") else None
    parts, key = claim["parts"], claim.get("key")
    if claim["mode"] == "append":
        if again and (old := stored(spark, path)) is not None:
            rows = session.settle(missing_keys(rows, old, key), "again")
        _write(rows, path, parts, "append")
        if claim.get("index"):
            if again:
                CM.delete(spark, _index(path))
                _indexed(stored(spark, path), key, path)
            else:
                _indexed(rows, key, path)
        return
    CM.delete(spark, _index(path))  # the next insert by key makes it anew
    if rows is not None and (parts or not claim.get("whole")):
        _write(rows, path, parts, "overwrite")
    elif rows is not None:
        _swap(spark, rows, path)
    if claim.get("folders"):
        for row in spark.read.parquet(claim["folders"]).toLocalIterator():
            CM.delete(spark, row["folder"])


def _swap(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replace the files of a table without partitions; what lies in its own folder stays."""
    fs, place = CM._place(spark, path)
    old = [str(x.getPath()) for x in fs.listStatus(place) if not x.getPath().getName().startswith(("_", "."))] if fs.exists(place) else []
    if rows.isEmpty():
        rows = rows.coalesce(1)
    _write(rows, path, (), "append")
    for file in old:
        CM.delete(spark, file)


def _commit(spark: SparkSession, path: str, base: int, mode: str, rows: DataFrame | None, parts: Sequence[str], **more) -> None:
    claim = {"mode": mode, "parts": list(parts)} | more
    if rows is not None:
        claim |= {"staged": CM.staged(rows, path), "schema": json.loads(rows.schema.json())}
    CM.commit(spark, path, base, claim, _apply)


def _retried(write: Callable[[int], None], spark: SparkSession, path: str, times: int = 20) -> None:
    """Do a write that reads the table, again where another writer was faster."""
    for k in range(times):
        try:
            return write(CM.begin(spark, path, _apply))
        except CM.Conflict:
            if k == times - 1:
                raise


def _index(path: str) -> str:
    return f"{path}/{CM.FOLDER}/keys"


def _bucket(key: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket")


def _indexed(rows: DataFrame, key: Sequence[str], path: str) -> None:
    rows.select(*key, _bucket(key)).write.mode("append").partitionBy("_bucket").parquet(_index(path))


def _known_keys(spark: SparkSession, path: str, old: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored keys in the buckets that a batch's keys fall into; a table without an index gets one."""
    if not CM.exists(spark, _index(path)):
        _indexed(old, key, path)
    hit = [r[0] for r in batch.select(_bucket(key)).distinct().collect()]  # at most KEY_BUCKETS
    kinds = T.StructType([*(old.schema[c] for c in key), T.StructField("_bucket", T.IntegerType())])
    return spark.read.schema(kinds).parquet(_index(path)).filter(F.col("_bucket").isin(hit)).drop("_bucket")


def _keyed(df: DataFrame, other: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    names = {c: f"_k_{c}" for c in key}
    other = other.select(*[F.col(c).alias(n) for c, n in names.items()])
    return df.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())), how)


def missing_keys(df: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return _keyed(df, known, key, "left_anti")


def matching_keys(df: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    return _keyed(df, wanted, key, "left_semi")


def _touched(table: DataFrame, batch: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of the partitions a batch falls into.

    The range of the batch's values in each partition column becomes a literal, so what
    lies outside is not even listed for the scan; the join picks the partitions inside.
    """
    if not parts:
        return table
    spans = [f(F.col(p)).alias(f"{n}_{p}") for p in parts for n, f in (("low", F.min), ("high", F.max))]
    nulls = [F.coalesce(F.bool_or(F.col(p).isNull()), F.lit(False)).alias(f"null_{p}") for p in parts]
    seen = batch.agg(*spans, *nulls).first()
    for p in parts:
        inside = F.lit(False) if seen[f"low_{p}"] is None else F.col(p).between(seen[f"low_{p}"], seen[f"high_{p}"])
        table = table.filter(inside | F.col(p).isNull() if seen[f"null_{p}"] else inside)
    return matching_keys(table, batch.select(*parts).distinct(), parts)


def insert_if_absent(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str], parts: Sequence[str] = ()) -> Written:
    """Append rows whose key is new; within the batch the first in `order` stays.

    With `parts` the key must determine the partition, so only those are looked at. Without, stored keys are kept
    apart in buckets by hash, and only the buckets of the batch's keys are read, never the table.
    """
    spark = df.sparkSession
    tried = Observation()
    batch = session.settle(df.observe(tried, F.count(F.lit(1)).alias("n")), "batch")
    saved = 0

    def write(base: int) -> None:
        nonlocal saved
        fresh = dedup(batch, key, order)
        old = stored(spark, path)
        if old is not None:
            known = _touched(old, batch, parts) if parts else _known_keys(spark, path, old, batch, key)
            fresh = missing_keys(fresh, known, key)
        new = Observation()
        fresh = session.settle(fresh.observe(new, F.count(F.lit(1)).alias("n")), "fresh")
        saved = new.get["n"]
        if saved:
            _commit(spark, path, base, "append", fresh, parts, key=list(key), index=not parts)

    _retried(write, spark, path)
    return Written(tried.get["n"], saved)


def upsert(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str], parts: Sequence[str] = ()) -> Written:
    """Insert or replace by key; within the batch the last in `order` wins.

    Touched partitions are built aside and then swapped in by a commit, so the table is never
    read and overwritten in one job, and two writers don't undo each other.
    """
    spark = df.sparkSession
    tried, saved = Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    batch = session.settle(dedup(df.observe(tried, one), key, order, keep="last").observe(saved, one), "batch")

    def write(base: int) -> None:
        old = stored(spark, path)
        merged = batch
        if old is not None:
            merged = missing_keys(_touched(old, batch, parts), batch, key).unionByName(batch, allowMissingColumns=True)
        _commit(spark, path, base, "overwrite", merged, parts, whole=not parts)

    _retried(write, spark, path)
    return Written(tried.get["n"], saved.get["n"])


def replace_slice(df: DataFrame, path: str, slices: Sequence[str] = ("asset", "prediction_horizon", "target_mode")) -> None:
    """Replace whole slices (the partitions present in `df`); others stay as they are."""
    CM.delete(df.sparkSession, _index(path))
    _write(df, path, slices, "overwrite")


def delete_where(spark: SparkSession, path: str, predicate: Column, parts: Sequence[str] = ()) -> int:
    """Delete matching rows, rewriting only partitions that hold some; returns their number.

    What stays of those is staged, folders that lose all rows are listed in a table, and both are one commit.
    """
    gone = 0

    def write(base: int) -> None:
        nonlocal gone
        table = stored(spark, path)
        if table is None:
            return
        hit = F.coalesce(predicate, F.lit(False))
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        marked = table.withColumn("_hit", hit).withColumn("_folder", folder)
        counts = marked.groupBy("_folder").agg(F.count_if("_hit").alias("gone"), F.count_if(~F.col("_hit")).alias("left"))
        stats = session.settle(counts.filter("gone > 0"), "folders")
        gone = stats.agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
        if not gone:
            return
        partial = stats.filter("left > 0").select("_folder")
        if not parts:
            _commit(spark, path, base, "overwrite", table.filter(~hit), parts, whole=True)
            return
        kept = marked.join(partial, "_folder", "left_semi").filter(~F.col("_hit")).drop("_hit", "_folder")
        empty = CM.staged(stats.filter("left = 0").select(F.col("_folder").alias("folder")), path)
        _commit(spark, path, base, "overwrite", kept, parts, folders=empty)

    _retried(write, spark, path)
    return gone


def ends_with(col: str, suffix: str) -> Column:
    """LIKE '%suffix' with the suffix taken literally."""
    return F.col(col).endswith(suffix)


def append(df: DataFrame, path: str) -> None:
    CM.remember(df.sparkSession, path, df.schema)
    CM.delete(df.sparkSession, _index(path))
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, decimals: int = 8) -> None:
    """CSV with fixed decimals; NULLs are empty."""
    cols = [
        F.format_string(f"%.{decimals}f", F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("double", "float")
        else F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if f.dataType.typeName() == "timestamp"
        else F.col(f.name)
        for f in df.schema.fields
    ]
    nulls = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [F.when(F.col(f.name).isNotNull(), c).alias(f.name) if f.name in nulls else c for f, c in zip(df.schema.fields, cols)]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def log_run(
    df: DataFrame, path: str, source: str, status: str = "ok", error: str | None = None, attempted: DataFrame | None = None
) -> None:
    """Append one log row per asset with the numbers of rows tried (`attempted`, else `df`) and saved (`df`)."""
    tried = (df if attempted is None else attempted).select("asset", F.lit(1).alias("_tried"), F.lit(0).alias("_saved"))
    saved = df.select("asset", F.lit(0).alias("_tried"), F.lit(1).alias("_saved"))
    rows = tried.unionByName(saved).groupBy("asset").agg(F.sum("_tried").alias("rows_attempted"), F.sum("_saved").alias("rows_saved"))
    rows = rows.select(
        F.lit(source).alias("source"), "asset", F.lit(status).alias("status"), "rows_attempted", "rows_saved",
        F.lit(error).alias("error"), F.current_timestamp().alias("run_at"),
    )
    append(conform(rows, RUN_LOG), path)
