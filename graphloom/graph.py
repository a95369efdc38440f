"""The graph value: a bundle of DataFrames, never collected."""

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.session import plan_by_memory, shuffles_removed


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    relations: DataFrame
    aliases: DataFrame
    op_logs: DataFrame
    vectors: DataFrame
    entity_images: DataFrame
    relation_images: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_tables(self, **tables: DataFrame) -> "Graph":
        return replace(self, **tables)


def make_graph(spark: SparkSession, **tables: DataFrame) -> Graph:
    """Graph from the given tables; tables not given are empty."""
    full = {n: tables.get(n, spark.createDataFrame([], s)) for n, s in S.TABLES.items()}
    return Graph(**full)


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Read the tables of one graph version with explicit schemas."""
    plan_by_memory(spark)
    return Graph(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in S.TABLES.items()})


def save_graph(g: Graph, path: str) -> None:
    """Write all tables under one directory."""
    for name, df in g.tables().items():
        with shuffles_removed(df.sparkSession):
            df.select(*S.TABLES[name].fieldNames()).write.parquet(f"{path}/{name}")


def undirected_edges(relations: DataFrame) -> DataFrame:
    """Both directions of every edge as (src, dst, rel_id, dir); a self loop appears once."""
    fwd = relations.select(
        F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("id").alias("rel_id")
    )
    back = relations.where(F.col("source_id") != F.col("target_id")).select(
        F.col("target_id").alias("src"), F.col("source_id").alias("dst"), F.col("id").alias("rel_id")
    )
    return fwd.unionAll(back)


def neighbor_pairs(relations: DataFrame) -> DataFrame:
    """Distinct undirected neighbor pairs (src, dst), both directions."""
    return undirected_edges(relations).select("src", "dst").distinct()
