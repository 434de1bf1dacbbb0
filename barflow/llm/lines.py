"""Line dedup: levelled sorted runs of line hashes; each batch merges with them, adds its own, and full levels are compacted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Fixed values of the contract: documents a line must be found in, characters that don't count at a line's ends.
LEAST = 10
BLANKS = " \t\n\x0b\x0c\r"
# Runs of a level that are merged into one of the next.
FAN = 4
# Batches a whole table is dealt to, and rows of a file that go to one batch together.
BATCHES, ROWS_TOGETHER = 8, 1024


def _cut(text: Column) -> Column:
    return F.split(text, "\n", -1)


def entries(text: Column) -> Column:
    """Array of (a, b, pos, first) of the lines with a key: a 128-bit hash of the key, the line's number, and whether the text
    has the key for the first time. Sorted by hash, so equal keys are neighbours and no line is compared with all others."""
    keys = F.transform(_cut(T.ascii_lower(text)), lambda x: F.btrim(x, F.lit(BLANKS)))
    one = F.lit(1)
    hashed = F.transform(
        keys, lambda k, i: F.when(k != "", F.struct(F.xxhash64(k).alias("a"), F.xxhash64(one, k).alias("b"), i.alias("pos")))
    )
    in_order = F.array_sort(F.filter(hashed, lambda e: e.isNotNull()))

    def fresh(all_: Column, e: Column, i: Column) -> Column:
        last = F.get(all_, i - 1)
        return (i == 0) | (last["a"] != e["a"]) | (last["b"] != e["b"])

    return F.transform(
        F.array(in_order), lambda s: F.transform(s, lambda e, i: F.struct(e["a"], e["b"], e["pos"], fresh(s, e, i).alias("first")))
    )[0]


class Runs:
    """How many documents each line hash was found in, as sorted runs of (a, b, n) by level.

    A run is a table in the shared folder, written once, sorted by hash in each of its files. A batch is counted, merge-anti-joined
    with what the runs already know to be frequent, and becomes a run of level 0; FAN runs of a level are summed into
    one of the next. So a line is rewritten once for each level, and a batch never waits for the whole history to be sorted.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fan: int = FAN):
        self.spark, self.least, self.fan = spark, least, fan
        self.levels: list[list[DataFrame]] = [[]]

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        none = self.spark.createDataFrame([], "a bigint, b bigint, n bigint")
        return reduce(DataFrame.unionByName, runs) if runs else none

    def _write(self, counts: DataFrame) -> DataFrame:
        return session.settle(counts.sortWithinPartitions("a", "b"), "lines")

    def add(self, batch: DataFrame) -> None:
        """`batch` has a row (a, b) for each document and line hash in it."""
        counts = batch.groupBy("a", "b").agg(F.count("*").alias("n"))
        known = [run.filter(F.col("n") >= self.least).select("a", "b") for run in self._runs()]
        if known:
            counts = counts.join(self._union(known).hint("merge"), ["a", "b"], "left_anti")
        self.levels[0].append(self._write(counts))
        for k, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            merged = self._union(level).groupBy("a", "b").agg(F.sum("n").alias("n"))
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(merged))

    def frequent(self) -> DataFrame:
        """(a, b) of the lines found in at least `least` documents of all batches."""
        total = self._union(self._runs()).groupBy("a", "b").agg(F.sum("n").alias("n"))
        return session.settle(total.filter(F.col("n") >= self.least).select("a", "b"), "frequent")


def cleaned(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """doc (the row), n_lines, n_dropped, kept (the text that is left); one row per row of `docs`.

    A text is cut at every newline; a line's key is the line without blanks at both ends and with A-Z lower-cased. Lines with a key
    found in `least` rows or more go from every text, and what is left is joined again. Keys are compared by 128 bits of
    hash. Null text counts as empty, and an empty text is one line with an empty key; such lines always stay. Each row is a
    document, repeated rows and null ids too. Texts with very many lines are sorted by hash, never compared pair by pair; a
    line in very many texts is counted in each task before it is shuffled, and Spark may split its rows in the join that
    marks them, as both sides are plain exchanges. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = T.located(docs, "lines").withColumn("file", F.xxhash64("at.file")).withColumn("row", F.col("at.row"))
    text = T.filled(F.col("doc.text"))
    batch = F.pmod(F.xxhash64("file", F.floor(F.col("row") / ROWS_TOGETHER)), F.lit(batches)).alias("batch")
    path = session.scratch(spark, "entries")
    rows.select("file", "row", batch, entries(text).alias("e")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("file bigint, row bigint, e array<struct<a:bigint,b:bigint,pos:int,first:boolean>>, batch int").parquet(path)
    runs = Runs(spark, least)
    for k in range(batches):
        own = lines.filter(F.col("batch") == k).select(F.explode(F.filter("e", lambda e: e["first"])).alias("e"))
        runs.add(own.select("e.a", "e.b"))

    spread = lines.select("file", "row", F.explode("e").alias("e")).select("file", "row", "e.a", "e.b", "e.pos")
    marked = spread.join(runs.frequent().hint("merge"), ["a", "b"], "left_semi")
    gone = marked.groupBy("file", "row").agg(F.collect_list("pos").alias("gone"))
    left = F.transform(
        F.array(_cut(text)),
        lambda cut: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("gone")), lambda i: F.get(cut, i)), "\n"
        ),
    )[0]
    return rows.select("doc", "file", "row").join(gone.hint("merge"), ["file", "row"], "left").select(
        "doc",
        F.size(_cut(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), text).otherwise(left).alias("kept"),
    )


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of `docs` with what is left of their texts; a text all of whose lines go is empty. See cleaned."""
    rows = cleaned(docs, least)
    return rows.select(*((F.col("kept") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
