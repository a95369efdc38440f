"""Level-wise expansion over an edge table, shared by ego and path operators."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.session import new_path, shuffles_removed

HUB_ROWS = 1_000_000
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class Adjacency:
    """Edges (src, salt, dst, rel_id) bucketed by (src, salt); a hub's edges spread over several salts."""

    rows: DataFrame
    hubs: DataFrame | None

    def expand(self, frontier: DataFrame, node: str = "node") -> DataFrame:
        """Frontier rows joined to the edges that leave ``node``."""
        if self.hubs is None:
            f = frontier.withColumn("_salt", F.lit(0))
        else:
            f = frontier.join(self.hubs, F.col(node) == F.col("hub"), "left").drop("hub").withColumn(
                "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
        return f.join(self.rows, (F.col(node) == F.col("src")) & (F.col("_salt") == F.col("salt"))).drop("src", "salt", "_salt")


def build_adjacency(edges: DataFrame, hub_rows: int = HUB_ROWS, merge: bool = False, bucket_rows: int = BUCKET_ROWS) -> Adjacency:
    """Bucketed adjacency of (src, dst, rel_id) edges, written once to the shared folder.

    Loops join against it every round; with the buckets only the frontier has to move. There are as many buckets as keep about
    ``bucket_rows`` edges each, so that a task's share does not grow with the graph. With ``merge`` edges between the same nodes
    become one with the smallest relation id, inside the buckets: edges are shuffled once.
    """
    spark = edges.sparkSession
    per_node = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    path = new_path(spark, "hubs")
    seen = Observation()
    with shuffles_removed(spark):
        per_node.observe(seen, F.sum("n").alias("rows")).where(F.col("n") > hub_rows).select(
            F.col("src").alias("hub"), F.ceil(F.col("n") / hub_rows).cast("int").alias("salts")).write.parquet(path)
    hubs = spark.read.schema("hub long, salts int").parquet(path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(seen.get["rows"] or 0) // bucket_rows))
    if hubs.isEmpty():
        hubs = None
        salted = edges.withColumn("salt", F.lit(0))
    else:
        spread = F.xxhash64("dst" if merge else "rel_id")  # edges to merge share a salt
        salted = edges.join(hubs, F.col("src") == F.col("hub"), "left").withColumn(
            "salt", F.pmod(spread, F.coalesce("salts", F.lit(1))).cast("int")).drop("hub", "salts")
    path = new_path(spark, "adjacency")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = salted.select("src", "salt", "dst", "rel_id").repartition(n, "src", "salt")
    if merge:
        rows = rows.groupBy("src", "salt", "dst").agg(F.min("rel_id").alias("rel_id"))
    with shuffles_removed(spark):
        rows.write.option("path", path).bucketBy(n, "src", "salt").saveAsTable(f"graphloom_{name}")
    return Adjacency(spark.table(f"graphloom_{name}"), hubs)


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_level(seeds: DataFrame, keys) -> DataFrame:
    from graphloom.session import materialize

    none = F.lit(None).cast("long")
    return materialize(seeds.select(*keys, "node").distinct().withColumn("next_rel", none).withColumn("next_node", none), "level")


def next_level(adj: Adjacency, levels: list[DataFrame], keys, front: DataFrame) -> tuple[DataFrame, int]:
    """The level behind ``front`` (rows of the last level still worth expanding), and its number of rows."""
    from graphloom.session import materialize

    step = adj.expand(front.select(*keys, "node")).groupBy(*keys, F.col("dst").alias("_to")).agg(
        F.min("rel_id").alias("next_rel"), F.min_by("node", "rel_id").alias("next_node")
    ).withColumnRenamed("_to", "node")
    old = union([lv.select(*keys, "node") for lv in levels[-2:]])
    step = step.join(old, [*keys, "node"], "left_anti").select(*keys, "node", "next_rel", "next_node")
    return materialize(step, "level", counted=True)


def levels_from(adj: Adjacency, seeds: DataFrame, keys, max_depth=None, keep=None) -> list[DataFrame]:
    """Breadth-first levels per key: tables (keys, node, next_rel, next_node), one per depth.

    ``next_rel`` is the smallest relation id that leads one level back, and ``next_node`` its end, so
    following them from a node spells the smallest relation-id sequence among the shortest paths.
    Edges lead both ways, so the last two levels tell new nodes from old ones.
    ``keep(levels)`` may return the keys still worth expanding, or None to stop.
    """
    levels = [first_level(seeds, keys)]
    while max_depth is None or len(levels) <= max_depth:
        front = levels[-1].select(*keys, "node")
        if keep is not None:
            live = keep(levels)
            if live is None:
                break
            front = front.join(live, keys, "left_semi")
        step, rows = next_level(adj, levels, keys, front)
        if rows == 0:
            break
        levels.append(step)
    return levels


def with_level(levels) -> DataFrame:
    return union([lv.withColumn("level", F.lit(i)) for i, lv in enumerate(levels)])
