"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Results must not depend on the
# cluster's default zone, and latest-N reads go past the 1000-row default up to
# which Spark keeps only N rows per task before the shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Series whose estimated size is at most this may be sorted by one task per key.
SINGLE_TASK_BYTES = ("barflow.series.singleTaskBytes", 256 * 1024 * 1024)
# Rows per block for longer series.
BLOCK_ROWS = ("barflow.series.blockRows", 65_536)

_local_scratch: str | None = None
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """Scratch tables are of no use to any other process."""
    for spark, path in _made:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the JVM may be gone already
            return


def build(
    app: str = "barflow", master: str | None = None, partitions: int | None = None, memory: str | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def setting(spark: SparkSession, option: tuple[str, int]) -> int:
    name, default = option
    return int(spark.conf.get(name, str(default)))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir.

    Only a local session may go without that setting; on a cluster a
    machine-local folder would be lost with its machine.
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_scratch is None:
            holder = tempfile.TemporaryDirectory(prefix="barflow-", ignore_cleanup_errors=True)
            atexit.register(holder.cleanup)
            _local_scratch = holder.name
        root = _local_scratch
    path = f"{root.rstrip('/')}/barflow/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers; needed by batch Python operators only."""
    context = spark.sparkContext
    if getattr(context, "_barflow_shipped", False):
        return
    folder = tempfile.TemporaryDirectory(prefix="barflow-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(f"{folder.name}/barflow", "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._barflow_shipped = True




def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back: computed once, and of known size."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Summed size of the tables a plan reads; unlike its estimate, joins do not inflate it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def fits_one_task(*frames: DataFrame) -> bool:
    """Whether what the frames read is small enough for one task per key.

    Files are counted four times, as they are compressed. Spark's own estimate of a
    result is not asked: it takes a join for the product of its sides, and a filter or
    an aggregate for whatever its statistics happen to say.
    """
    limit = setting(frames[0].sparkSession, SINGLE_TASK_BYTES)
    return 4 * sum(input_bytes(f) for f in frames) <= limit
