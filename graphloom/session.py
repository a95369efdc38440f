"""Session helpers: shared scratch tables, size-checked broadcast, row positions."""

import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BATCH_BYTES = 1 << 22  # of an Arrow batch that a Python worker gets; rows of long texts make 25 MB and more at Spark's 10,000 rows
FILE_FACTOR = 64  # a hash table of rows with repeated names takes more than this many times their compressed files
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)  # Spark serves the file to the executors
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.graphloom.localDir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.graphloom.localDir", path)
    return path.rstrip("/")


def plan_by_memory(spark: SparkSession) -> None:
    """Let the planner judge tables by about the memory that their rows take, not by their small files, so that no table of many
    rows passes through the driver as a broadcast. A factor that the session sets itself stays; real sizes of shuffles are not touched."""
    name = "spark.sql.sources.fileCompressionFactor"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(FILE_FACTOR))


def batch_by_bytes(spark: SparkSession) -> None:
    """Cut the Arrow batches given to Python by size, too, so that a worker's memory does not follow the length of the texts; a limit
    that the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Remove the shuffle files of each write inside when it ends; otherwise they stay until the driver happens to collect garbage, so
    that a query of many steps keeps those of all its steps. Results handed out keep the session's own setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fixed_now():
    """The time of the call as a literal, so a table evaluated twice keeps its time stamps."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def at_least(value, low: int, name: str) -> int:
    """The number a caller asked for, as it is; nonsense is refused instead of being replaced."""
    if value is None or int(value) < low:
        raise ValueError(f"{name} must be {low} or more, not {value!r}")
    return int(value)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str = "t", counted: bool = False):
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and gives the planner true file
    sizes. With ``counted`` the row count comes from the same job.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    seen = Observation()
    with shuffles_removed(spark):
        (df.observe(seen, F.count(F.lit(1)).alias("n")) if counted else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return (out, int(seen.get["n"])) if counted else out


def discard(*frames: DataFrame) -> None:
    """Remove the tables that ``materialize`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a check finds at most ``max_rows`` rows; else leave it to the planner."""
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def with_position(df: DataFrame, *order, name: str = "pos", keep=None) -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``, without one big sort task; ``keep`` names the columns left.

    Rows are range-partitioned, sorted and numbered inside their range, and written once, so the ranges stay fixed; a range is
    then shifted by the sizes of the ranges before it. Rows move once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the low 33 bits count the rows of a partition
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(*(keep or df.columns), F.spark_partition_id().alias("_range"), inside.alias("_rn")), "pos")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: at most shuffle.partitions rows
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return ranged.join(F.broadcast(shift), "_range").withColumn(name, (F.col("_rn") + F.col("_shift")).cast("long")).drop("_rn", "_range", "_shift")


def running(df: DataFrame, key, order: str, last=(), sums=(), bucket: int = 65536) -> DataFrame:
    """Per ``key``, values before each row: last non-null of the ``last`` columns and totals of the
    ``sums`` columns, as ``prev_<column>``.

    ``order`` is a BIGINT column, unique within a key. Long keys are cut into buckets of that order, so
    no task sees more than one bucket of a key, and buckets are carried over by their summaries.
    """
    keys = [key] if isinstance(key, str) else list(key)
    b = df.withColumn("_b", F.floor(F.col(order) / bucket))
    before = lambda w, o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy(*keys, "_b"), order)
    carry = before(Window.partitionBy(*keys), "_b")
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in last]
    aggs += [F.sum(c).alias(f"_s_{c}") for c in sums]
    heads = b.groupBy(*keys, "_b").agg(*aggs).select(
        *keys, "_b",
        *[F.last(f"_l_{c}", True).over(carry).alias(f"_l_{c}") for c in last],
        *[F.sum(f"_s_{c}").over(carry).alias(f"_s_{c}") for c in sums],
    )
    out = b.select(
        "*",
        *[F.last(c, True).over(inside).alias(f"_in_{c}") for c in last],
        *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums],
    ).join(heads, [*keys, "_b"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        *df.columns,
        *[F.coalesce(f"_in_{c}", f"_l_{c}").alias(f"prev_{c}") for c in last],
        *[(zero(f"_in_{c}") + zero(f"_s_{c}")).alias(f"prev_{c}") for c in sums],
    )
