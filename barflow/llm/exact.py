"""Exact dedup: a keyed state on disk that never expires, fed as a stream; hits are checked byte by byte."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import session
from barflow.llm import text as T

# Copies of one text that are compared with it in one group of the join.
COPIES_PER_GROUP = 4096
STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # many stores of little each: don't set disk aside for them
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _on_disk(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def normalised(text: str | Column = "text") -> Column:
    """What must be equal: the text with A-Z lower-cased, null as empty."""
    return T.ascii_lower(T.filled(text))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def remember(stream: DataFrame, checkpoint: str) -> None:
    """Take what a stream of (digest, seen) holds into the state kept at `checkpoint`.

    The state has one entry per digest: the largest `seen`, which is the identifier and the place of the content, and how
    many rows had it. It lies in RocksDB on the executors' disks, is saved at `checkpoint` with every batch, and has no
    watermark, so nothing expires: later calls with the same checkpoint go on with all that was seen.
    """
    with _on_disk(stream.sparkSession):
        (
            stream.groupBy("digest")
            .agg(F.max("seen").alias("seen"), F.count("*").alias("n"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, seen, n of every entry of the state."""
    state = spark.read.format("statestore").load(checkpoint)
    fields = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[fields[0]].alias("seen"),
        F.col("value")[fields[1]].alias("n"),
    )


def classes(docs: DataFrame, digest=sha256) -> DataFrame:
    """For each row: doc, digest, keep_id, group_size, kept.

    Of rows with equal text (A-Z lower-cased, null as empty) the one with the largest doc_id stays; among equal ids the
    last place in the files decides, and a null id is less than any other. Only rows whose digest the state has seen more
    than once are fetched again and compared in full with the text that stays; rows that differ in spite of an equal digest
    form groups of their own. A text with very many copies is compared in groups of COPIES_PER_GROUP, each with a copy of
    the one text that stays, and rows get their answers by place, so no digest gathers its rows. Texts of any length are hashed and compared as a whole. Both sides of these joins grow with the input, so they are merge joins at every size. An empty
    table gives no rows. No Python runs.
    """
    spark = docs.sparkSession
    rows = T.located(docs, "dedup").withColumn("digest", digest(normalised(F.col("doc.text"))))
    seen = F.struct(F.col("doc.doc_id").alias("id"), F.col("at"))
    feed, checkpoint = session.scratch(spark, "digests"), session.scratch(spark, "seen")
    rows.select("digest", seen.alias("seen")).write.parquet(feed)
    ids = spark.read.parquet(feed)
    if ids.isEmpty():  # a stream without rows starts no batch, and leaves no state to read
        heads = ids.withColumn("n", F.lit(0).cast("long"))
    else:
        remember(spark.readStream.schema(ids.schema).parquet(feed), checkpoint)
        heads = remembered(spark, checkpoint)
    heads = session.settle(heads.filter("n > 1").withColumnRenamed("seen", "head"), "heads")

    groups = F.ceil(F.col("n") / COPIES_PER_GROUP).cast("int")
    hits = session.settle(
        rows.join(heads.hint("merge"), "digest").select(
            "digest",
            seen.alias("seen"),
            "head",
            "n",
            normalised(F.col("doc.text")).alias("body"),
            F.pmod(F.xxhash64("at"), groups).cast("int").alias("group"),
        ),
        "hits",
    )
    first = hits.filter(F.col("seen").eqNullSafe(F.col("head"))).select(
        "digest", F.col("body").alias("first"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("group")
    )
    # no row here unless two texts share a digest: then each text is a group of its own
    odd = session.settle(
        hits.join(first.hint("merge"), ["digest", "group"]).filter("body != first").select("digest", "seen", "body"), "unequal"
    )
    own = odd.groupBy("digest", "body").agg(F.max("seen").alias("own"), F.count("*").alias("own_n"))
    owners = session.settle(odd.join(own, ["digest", "body"]).select("digest", "seen", "own", "own_n"), "owners")
    lost = session.settle(odd.groupBy("digest").agg(F.count("*").alias("lost")), "lost")
    # of the copies only ids and places go on; both sides of each join are plain exchanges, so Spark may split a digest
    keep = F.coalesce("own", "head")
    found = hits.select("digest", "seen", "head", "n").join(lost, "digest", "left").join(owners, ["digest", "seen"], "left").select(
        F.col("seen.at.file").alias("file"), F.col("seen.at.row").alias("row"), keep["id"].alias("found_id"),
        F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("found_n"), keep.eqNullSafe(F.col("seen")).alias("found_kept"),
    )
    found = session.settle(found, "copies")
    placed = rows.withColumns({"file": F.col("at.file"), "row": F.col("at.row")})
    alone = F.col("found_n").isNull()
    return placed.join(found.hint("merge"), ["file", "row"], "left").select(
        "doc",
        "digest",
        F.when(alone, F.col("doc.doc_id")).otherwise(F.col("found_id")).alias("keep_id"),
        F.coalesce("found_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("found_kept", F.lit(True)).alias("kept"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay."""
    return T.unpacked(classes(docs).filter("kept"), docs.columns)


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
