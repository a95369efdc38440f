"""Savepoints: every version is a directory of tables, and an append-only log of rows says which is current.

A version is written in full before its log row, so a failed write leaves the former version current.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema as S
from graphloom.graph import Graph, load_graph, make_graph, save_graph
from graphloom.session import materialize

KEEP = 10
GAP_SECONDS = 600
RANGE_IDS = 10_000
_LOG = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("title", T.StringType()), T.StructField("source", T.StringType()), T.StructField("log_from", T.LongType()),
    T.StructField("log_to", T.LongType()), T.StructField("print", T.StringType()), T.StructField("is_backup", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])


def fingerprint(g: Graph) -> str:
    """Order-free print of all tables but the log: counts and two hash sums per table."""
    out = []
    for name, df in g.tables().items():
        if name == "op_logs":
            continue
        cols = [F.col(f) for f in S.TABLES[name].fieldNames()]
        h = F.xxhash64(*cols)
        r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), *cols))).first()
        out.append(f"{name}:{r[0]}:{r[1]}:{r[2]}")
    return ";".join(out)


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only in ``a`` (change -1 per copy) or only in ``b`` (+1), from one shuffle."""
    cols = a.columns
    both = a.withColumn("change", F.lit(-1)).unionByName(b.select(*cols).withColumn("change", F.lit(1)))
    return both.groupBy(*cols).agg(F.sum("change").alias("change")).where("change <> 0")


def parse_history(messages: DataFrame, column: str = "message") -> DataFrame:
    """Title, source and log range out of imported messages ``title｜来源:source｜日志ID:from-to``."""
    # fixed value: message pattern
    pattern = r"^(.*)｜来源:(.*)｜日志ID:(\d+)-(\d+)$"
    hit = F.col(column).rlike(pattern)
    part = lambda i: F.regexp_extract(column, pattern, i)
    return messages.select(
        "*", F.when(hit, part(1)).otherwise(F.col(column)).alias("title"), F.when(hit, part(2)).otherwise("").alias("source"),
        F.when(hit, part(3).try_cast("long")).alias("log_from"), F.when(hit, part(4).try_cast("long")).alias("log_to"))


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(f"{self.root}/log")

    def _append(self, **row) -> None:
        self.spark.createDataFrame([tuple(row.get(n) for n in _LOG.fieldNames())], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _last(self, kind: str | None = None):
        rows = self._rows()
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        found = rows.orderBy(F.desc("seq")).limit(1).collect()
        return found[0] if found else None

    def savepoint(self, g: Graph, title: str = "", source: str = "系统", now: datetime | None = None, always: bool = False) -> dict:
        """Write a new version unless the data equals the last one; ``always`` writes it all the same, so that the log
        rows of a batch without net effect are kept."""
        last, top = self._last(), self._last("savepoint")
        mark = fingerprint(g)
        if last is not None and last["print"] == mark and not always:
            return {"committed": False, "message": "当前数据与最近保存点一致，无差异需要提交"}
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        version = (top["version"] if top else 0) + 1
        to = g.op_logs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        start = min((last["log_to"] if last else 0) + 1, to)
        title = (title or "").strip() or f"保存点 {now:%Y/%m/%d %H:%M:%S}"
        old = self._rows().where("is_backup").agg(F.max("created_at")).first()[0]
        backup = old is None or (now - old).total_seconds() >= GAP_SECONDS
        save_graph(g, f"{self.root}/v{version}")
        self._append(seq=(last["seq"] if last else 0) + 1, kind="savepoint", version=version, title=title, source=source,
                     log_from=start, log_to=to, print=mark, is_backup=backup, created_at=now)
        return {"committed": True, "version": version, "log_range": [start, to],
                "message": f"{title}｜来源:{source}｜日志ID:{start}-{to}"}

    def history(self, limit: int | None = None) -> DataFrame:
        """Savepoints, newest first; all unless a limit is given."""
        rows = self._rows().where("kind = 'savepoint'").orderBy(F.desc("version"))
        rows = rows if limit is None else rows.limit(limit)
        return rows.select(*S.SAVEPOINTS.fieldNames())

    def retained(self, keep: int = KEEP) -> DataFrame:
        """Rolling copies: savepoints at least ten minutes after the copy before them, newest first."""
        return self._rows().where("is_backup").orderBy(F.desc("version")).limit(keep).select(*S.SAVEPOINTS.fieldNames())

    def titled(self, title: str) -> bool:
        """Whether some savepoint has this title."""
        return not self._rows().where((F.col("kind") == "savepoint") & (F.col("title") == title)).isEmpty()

    def current(self) -> Graph:
        """The graph that the last savepoint or restore left; empty if there is neither."""
        last = self._last()
        if last is None:
            return make_graph(self.spark)
        return load_graph(self.spark, f"{self.root}/{'v' if last['kind'] == 'savepoint' else 'r'}{last['version' if last['kind'] == 'savepoint' else 'seq']}")

    def at(self, version: int) -> Graph:
        if self._rows().where((F.col("kind") == "savepoint") & (F.col("version") == version)).isEmpty():
            raise ValueError(f"保存点 {version} 不存在")
        return load_graph(self.spark, f"{self.root}/v{version}")

    def restore(self, g: Graph, version: int):
        """(graph at ``version`` with a RESTORE log row, version of the automatic savepoint or None)."""
        from graphloom.operators.aggregates import graph_counts

        target = self.at(version)
        made = self.savepoint(g, f"回滚前自动备份 {datetime.now(timezone.utc):%Y/%m/%d %H:%M:%S}", "系统")
        row = self._rows().where((F.col("kind") == "savepoint") & (F.col("version") == version)).first()
        seq = self._last()["seq"] + 1
        snap = F.to_json(F.struct(
            F.lit("版本回溯").alias("action"), F.lit(str(version)).alias("restored_to"),
            F.lit(str(made["version"]) if made["committed"] else None).alias("backup_savepoint"),
            F.struct("entities", "relations", "logs").alias("counts")))
        top = target.op_logs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("one", F.lit(1))
        log = graph_counts(target).withColumn("one", F.lit(1)).join(top, "one").select(
            (F.col("top") + 1).alias("id"), F.lit("RESTORE").alias("op_type"), snap.alias("snapshot"),
            F.current_timestamp().alias("created_at"), F.lit("系统").alias("source"))
        restored = target.with_tables(op_logs=target.op_logs.unionByName(log))
        save_graph(restored, f"{self.root}/r{seq}")  # what later batches build on
        self._append(seq=seq, kind="restore", version=version, title=row["title"], source="系统", log_from=row["log_from"],
                     log_to=row["log_to"], print=row["print"], is_backup=False, created_at=datetime.now(timezone.utc).replace(tzinfo=None))
        return load_graph(self.spark, f"{self.root}/r{seq}"), made.get("version")

    def log_range_members(self, op_logs: DataFrame) -> DataFrame:
        """(version, log id): log rows bound to each savepoint.

        A range spells out its buckets of ids, and log rows meet it on their bucket.
        """
        bucket = lambda c: F.floor(F.col(c) / RANGE_IDS)
        spans = self.history().select("version", "log_from", "log_to", F.explode(F.sequence(bucket("log_from"), bucket("log_to"))).alias("_b"))
        rows = op_logs.select("id", bucket("id").alias("_b"))
        return rows.join(spans, "_b").where("log_from <= id AND id <= log_to").select("version", "id")


def keep_spaced(rows: DataFrame, time_col: str, seconds: int) -> DataFrame:
    """Distinct times of a history to keep: the oldest, then always the first that is at least ``seconds`` after the one kept before.

    Every time points to its successor, which lies in the next slice of ``seconds`` or else opens the first slice behind it that
    holds any. Pointers are doubled until they leave the history, and the chain from the oldest is marked by them from the
    longest to the shortest, so its length costs its logarithm in rounds. Null times are left out; no rows give none.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    gap = seconds * 1_000_000
    times = materialize(rows.select(micros.alias("t")).where("t is not null").distinct().withColumn("slice", F.floor(F.col("t") / gap)), "times")
    # the first time at or after t + gap within its slice: a running minimum from behind, slice by slice
    asked = times.select((F.col("slice") + 1).alias("slice"), (F.col("t") + gap).alias("at"), F.col("t").alias("asks"))
    both = asked.union(times.select("slice", F.col("t").alias("at"), F.lit(None).cast("long")))
    behind = Window.partitionBy("slice").orderBy(F.desc("at"), F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("to", F.min(F.when(F.col("asks").isNull(), F.col("at"))).over(behind)).where("asks is not null")
    # one row a slice: the start of the next slice that holds any time
    opens = times.groupBy("slice").agg(F.min("t").alias("open"))
    later = both.select("slice").distinct().join(opens, "slice", "left").withColumn(
        "next_open", F.min("open").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)))
    links = inside.join(later, "slice").select(F.col("asks").alias("t"), F.coalesce("to", "next_open").alias("to")).where("to is not null")
    jumps = [materialize(links, "jumps")]
    while not jumps[-1].isEmpty():
        again = jumps[-1].select(F.col("t").alias("to"), F.col("to").alias("far"))
        jumps.append(materialize(jumps[-1].join(again, "to").select("t", F.col("far").alias("to")), "jumps"))
    kept = materialize(times.agg(F.min("t").alias("t")).where("t is not null"), "kept")
    for jump in reversed(jumps):
        kept = materialize(kept.union(kept.join(jump, "t").select(F.col("to").alias("t"))).distinct(), "kept")
    return kept.select(F.timestamp_micros("t").alias(time_col))
