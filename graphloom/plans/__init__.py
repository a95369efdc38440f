"""Registered queries and their SQL equivalents."""

import importlib

MODULES = ["basic", "graphs", "search", "writes", "documents"]


def _load():
    from graphloom.plans import registry

    for m in MODULES:
        importlib.import_module(f"graphloom.plans.{m}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
