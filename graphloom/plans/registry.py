"""Registry of the queries offered to the driver, and the graph store they share."""

from graphloom.graph import Graph, load_graph, save_graph
from graphloom.session import new_path, plan_by_memory
from graphloom.sources import derived

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_STORES: dict[tuple[str, str], Graph] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def store(spark, sf_dir: str) -> Graph:
    """The graph derived from the tables of ``sf_dir``, written once per application and read back."""
    plan_by_memory(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = new_path(spark, "store")
        save_graph(derived.graph(spark, sf_dir), path)
        _STORES[key] = load_graph(spark, path)
    return _STORES[key]
