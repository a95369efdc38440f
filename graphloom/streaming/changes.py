"""Streams over the operation log and over files of change batches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema as S
from graphloom.operators.changes import apply_ops
from graphloom.sources.versions import VersionStore

TRIGGER = {"processingTime": "3 seconds"}


def watch_changes(spark: SparkSession, log_dir: str, max_files: int | None = None) -> DataFrame:
    """New operation-log rows as files arrive in a directory."""
    reader = spark.readStream.schema(S.OP_LOGS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(log_dir)


def stream_op_counts(logs: DataFrame) -> DataFrame:
    """Running counts by kind and source; in update mode a trigger yields the counts that moved."""
    return logs.groupBy("op_type", "source").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def change_signature(logs: DataFrame) -> DataFrame:
    """One row: number of log rows and highest id; in update mode a trigger yields it only if it moved."""
    return logs.agg(F.count(F.lit(1)).alias("logs"), F.max("id").alias("version"))


def keep_moved(moved: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that writes the rows of an aggregate that moved in a trigger to the table at ``path``, under the trigger's number.

    The values live in the state store of ``checkpoint``, so a restart goes on from them; a trigger that is run again
    replaces what it wrote. ``latest`` reads the table.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    return (moved.writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER)).start())


def latest(spark: SparkSession, path: str, moved: DataFrame, keys=()) -> DataFrame:
    """Newest row per ``keys`` of a table that ``keep_moved`` wrote for ``moved``; empty before its first trigger."""
    rows = _read(spark, path, T.StructType([*moved.schema.fields, T.StructField("trigger", T.LongType())]))
    values = [c for c in moved.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "trigger").alias("x"))
    return newest.where("x IS NOT NULL").select(*keys, "x.*").select(*moved.columns)


def emit_changes(logs: DataFrame, on_change, checkpoint: str, trigger: dict | None = None):
    """Start a query that calls ``on_change(batch_id, logs, version)`` when the signature moves; again for a trigger that is run again."""
    def each(batch: DataFrame, batch_id: int) -> None:
        for row in batch.where("logs > 0").collect():  # the one signature row, if it moved
            on_change(batch_id, row["logs"], row["version"])

    return (change_signature(logs).writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER)).start())


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the store, empty before its first row."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def stream_apply_ops(spark: SparkSession, ops_dir: str, store: VersionStore, checkpoint: str, trigger: dict | None = None, source: str = "OpenCode",
                     max_files: int | None = None):
    """Apply files of operations as they arrive, one new version per accepted batch key.

    A batch that states its number of operations (batch_size) waits until all have arrived, however many files
    they come in; without it, a batch is what one trigger brings. Batches start from the store's current
    version, a restored one included. The title of a version names its batch, so a batch that is delivered
    again is seen to be done. A refused batch leaves the current version as it is; refusals are kept in the store
    folder, also those of a key that comes with more operations than it stated.
    """
    schema = T.StructType([*S.OPS.fields, T.StructField("batch_key", S.STR), T.StructField("batch_size", T.LongType())])
    refusal = T.StructType([T.StructField("batch_key", S.STR), T.StructField("error", S.STR)])
    refused = f"{store.root}/refused"

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.root}/arrived/trigger={batch_id}")
        here = spark.read.schema(schema).parquet(f"{store.root}/arrived/trigger={batch_id}")
        arrived = spark.read.schema(schema).parquet(f"{store.root}/arrived").select(*schema.fieldNames()).distinct()
        rows = arrived.join(here.select("batch_key").distinct(), "batch_key", "left_semi")
        sizes = rows.groupBy("batch_key").agg(F.count(F.lit(1)).alias("n"), F.max("batch_size").alias("size"))
        for r in sizes.where("size IS NULL OR n >= size").orderBy("batch_key").collect():  # one per request of this trigger
            key, title = r["batch_key"], f"batch {r['batch_key']}"
            known = not _read(spark, refused, refusal).where(F.col("batch_key") == key).isEmpty()
            if r["size"] is not None and r["n"] > r["size"] and not known:
                error = "more operations than stated"
            elif known or store.titled(title):
                continue
            else:
                ops = (here if r["size"] is None else rows).where(F.col("batch_key") == key).drop("batch_key", "batch_size")
                done = apply_ops(store.current(), ops, source)
                error = done.error
                if not error:
                    store.savepoint(done.graph, title, source, always=True)
            if error:
                spark.createDataFrame([(key, error)], refusal).write.mode("append").parquet(refused)

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (reader.parquet(ops_dir).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER)).start())
