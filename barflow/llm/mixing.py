"""Mixing sources to target weights: hash-random order, distributed prefix sums, and a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

WEIGHTS = (3.0, 1.0, 2.0)
ROWS_PER_RANGE = 8192


def budgets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Target of each source: `share` of all sizes by weight, none above `epochs` times its source's size.

    The excess of capped sources goes to the others by weight. Capped are those with the least cap per unit of weight, so
    one pass over the sources in that order finds the level at which the rest stand: no iteration. `totals` has one row per
    source: source, source_size. One small row per source passes through one task.
    """
    count = len(weights)
    ranked = totals.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % count + 1).cast("int"))
    every, order = W.partitionBy(), W.orderBy("_per", "_n")
    level = (
        ranked.withColumn("_w", weight)
        .withColumn("_cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("_per", F.col("_cap") / F.col("_w"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("_level", (F.lit(share) * F.sum("source_size").over(every) - F.col("_before")) / F.col("_rest"))
    )
    # the first source in this order whose cap lies above the level is not capped, nor is any after it
    found = F.min(F.when(F.col("_per") > F.col("_level"), F.struct("_per", "_n", "_level"))).over(every)["_level"]
    return (
        level.withColumn("_at", found)
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))))
        .select("source", "source_size", "rows", "target")
    )


def shuffled(doc_id: Column, seed: int) -> Column:
    """Hash-random key; the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def share_of(key: Column) -> Column:
    """The key as a number from 0 to 1."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    whole: bool = False,
    seed: int = 0,
    carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken; with `carry` also `doc`, the row itself.

    Within a source rows come in the order of a hash-random key. The key's range is cut into equal parts of about
    ROWS_PER_RANGE rows, so a source with a third of all rows is sorted by many tasks; sums of the parts give each part
    what lies before it. Whole epochs take every row; the last epoch takes rows up to the exact budget. The row at the
    cut gives the first part of its words, or with `whole` all of them if at least half lie within the budget.

    Null text has size 0 and takes 0; a null source is a source; rows with equal ids are told apart by size, and rows
    equal in both are interchangeable. An empty table gives no rows. No Python runs.
    """
    size = T.word_count(T.filled("text"))
    keyed = docs.select(
        F.col("doc_id"),
        F.col("source"),
        size.alias("size"),
        shuffled(F.col("doc_id"), seed).alias("key"),
        *([T.packed(docs)] if carry else []),
    )
    narrow = session.settle(keyed.drop("doc"), "mix")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    target = session.settle(budgets(totals, weights, share, epochs), "budgets").select(
        F.col("source").alias("_source"), "source_size", "target", F.ceil(F.col("rows") / ROWS_PER_RANGE).alias("_parts")
    )

    def parted(rows: DataFrame) -> DataFrame:
        return rows.join(target, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
            "_part", F.least(F.floor(share_of(F.col("key")) * F.col("_parts")), F.col("_parts") - 1)
        )

    sums = parted(narrow).groupBy("_source", "_part").agg(F.sum("size").alias("_sum"))
    before = sums.select(
        F.col("_source").alias("_s"),
        F.col("_part").alias("_p"),
        F.coalesce(
            F.sum("_sum").over(W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_carry"),
    )
    within = W.partitionBy("_source", "_part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = parted(keyed if carry else narrow).withColumn("_within", F.sum("size").over(within) - F.col("size"))
    placed = rows.join(before, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    cut = F.floor(F.col("target") + 0.5)
    full = F.when(F.col("source_size") > 0, F.floor(cut / F.col("source_size"))).otherwise(0)
    room = cut - full * F.col("source_size") - F.col("_carry") - F.col("_within")
    last = F.greatest(F.lit(0), F.least(room, F.col("size")))
    if whole:
        last = F.when((2 * last >= F.col("size")) & (F.col("size") > 0), F.col("size")).otherwise(0)
    taken = (full * F.col("size") + last).cast("long").alias("taken")
    return placed.select("doc_id", "size", "source_size", "target", taken, *(["doc"] if carry else []))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 0) -> DataFrame:
    """The mixture as rows of `docs`: each as often as it is taken. A row without words stays once, as it costs nothing."""
    rows = plan(docs, weights, share, epochs, whole=True, seed=seed, carry=True)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return T.unpacked(rows.select("doc", F.explode(F.array_repeat(F.lit(0), times))), docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source),
l AS (
  SELECT *, (2 * source_size) / w AS per,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (
           ORDER BY 2 * source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(w) OVER (ORDER BY 2 * source_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
b AS (
  SELECT *, least((2 * source_size)::DOUBLE,
                  coalesce((SELECT arg_min(level, per) FROM l WHERE per > level) * w, (2 * source_size)::DOUBLE)) AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, floor(b.target + 0.5)::BIGINT AS cut,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (cut // source_size) * size
          + greatest(0, least(size, cut - (cut // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM r
"""
