"""Knowledge-graph analytics on Spark tables."""

from graphloom.graph import Graph, load_graph, save_graph

__all__ = ["Graph", "load_graph", "save_graph"]
