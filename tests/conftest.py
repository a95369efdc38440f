import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[2]").appName("tests").config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make(spark):
    """Graph from names and (source, name, target) triples; ids follow the order given."""
    from graphloom.graph import make_graph
    from graphloom import schema as S

    def build(names, edges, aliases=(), logs=()):
        ids = {n: i + 1 for i, n in enumerate(names)}
        ents = [(ids[n], n, "抽象实体", "{}", None, "手工") for n in names]
        rels = [(i + 1, ids[a], ids[b], r, "互动", "确证", "", None, "手工") for i, (a, r, b) in enumerate(edges)]
        als = [(i + 1, ids[n], a, None) for i, (n, a) in enumerate(aliases)]
        return make_graph(
            spark, entities=spark.createDataFrame(ents, S.ENTITIES), relations=spark.createDataFrame(rels, S.RELATIONS),
            aliases=spark.createDataFrame(als, S.ALIASES), op_logs=spark.createDataFrame(list(logs), S.OP_LOGS))

    return build
