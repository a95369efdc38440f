"""Undo of the newest change, from the snapshot in its log row."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schema as S
from graphloom.functions.text import iso_time
from graphloom.graph import Graph
from graphloom.operators.changes import high_water
from graphloom.session import fixed_now

SKIPPED = ["UNDO", "ADD_RELATION_IMAGE"]


def undo_candidate(op_logs: DataFrame, look_back: int | None = None) -> DataFrame:
    """The newest log row that is neither an UNDO nor already undone; at most one row. ``look_back`` sees only so many rows."""
    newest = op_logs if look_back is None else op_logs.orderBy(F.desc("id")).limit(look_back)
    undone = newest.where("op_type = 'UNDO'").select(
        F.from_json("snapshot", "struct<undone_log:bigint>")["undone_log"].alias("id")).where("id IS NOT NULL")
    return newest.where(~F.col("op_type").isin(SKIPPED)).join(undone, "id", "left_anti").orderBy(F.desc("id")).limit(1)


def undo_last(g: Graph, source: str = "手工", marks: dict | None = None):
    """(new graph, outcome): apply the inverse of the candidate and log one UNDO row.

    The outcome says what became of it: ``op_type``, ``id`` of the row concerned, ``outcome`` (undone, gone: a later
    change removed the row, back: it exists again) and ``n_relations``, the relations removed along with an added entity, or
    lost for good with a deleted one. ValueError names what stands in the way.
    """
    row = undo_candidate(g.op_logs).collect()
    if not row:
        raise ValueError("nothing_to_undo")
    last = row[0]
    if last["op_type"] == "RESTORE":
        raise ValueError("restored_before")
    marks = dict(marks or high_water(g))
    verb, kind = last["op_type"].split("_", 1)
    g, done = _VERBS[verb](g, kind, json.loads(last["snapshot"]))
    done = {"op_type": last["op_type"], "n_relations": 0, **done}
    snap = json.dumps({"undone_log": last["id"], **done}, ensure_ascii=False)
    log = g.spark.createDataFrame([(marks["op_logs"] + 1, "UNDO", snap, source)], "id long, op_type string, snapshot string, source string")
    log = log.withColumn("created_at", fixed_now()).select(*S.OP_LOGS.fieldNames())
    return g.with_tables(op_logs=g.op_logs.select(*S.OP_LOGS.fieldNames()).unionByName(log)), done


#: Table, snapshot key and columns of each kind of row; and the values of relations logged before these columns came.
_KINDS = {"ENTITY": ("entities", "entity", S.ENTITIES), "RELATION": ("relations", "relation", S.RELATIONS), "ALIAS": ("aliases", "alias", S.ALIASES)}
_LATER = {"confidence": S.DEFAULT_CONFIDENCE, "source_ref": ""}


def _has(df: DataFrame, id_: int) -> bool:
    return not df.where(F.col("id") == id_).isEmpty()


def _ends_there(g: Graph, row: dict) -> None:
    for end in ("source_id", "target_id"):
        if not _has(g.entities, row[end]):
            raise ValueError(f"{end}_missing")


def _put(g: Graph, kind: str, row: dict) -> Graph:
    """Replace or add one row taken from a snapshot, with all its columns."""
    table, _, schema = _KINDS[kind]
    if kind == "RELATION":
        row = {**row, **{c: row.get(c) or v for c, v in _LATER.items()}}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "created_at" else f.dataType) for f in schema.fields])
    new = g.spark.createDataFrame([tuple(row.get(n) for n in schema.fieldNames())], text).withColumn("created_at", F.to_timestamp("created_at"))
    old = getattr(g, table).where(F.col("id") != row["id"]).select(*schema.fieldNames())
    return g.with_tables(**{table: old.unionByName(new)})


def _take_out(g: Graph, kind: str, snapshot: dict):
    """Inverse of an addition. An entity takes along what refers to it."""
    table, key, _ = _KINDS[kind]
    id_ = snapshot[key]["id"]
    there = getattr(g, table)
    if not _has(there, id_):
        return g, {"id": id_, "outcome": "gone"}
    n = 0
    if kind == "ENTITY":
        ends = (F.col("source_id") == id_) | (F.col("target_id") == id_)
        n = g.relations.where(ends).count()
        own = F.col("entity_id") != id_
        g = g.with_tables(relations=g.relations.where(~ends), aliases=g.aliases.where(own), entity_images=g.entity_images.where(own))
    return g.with_tables(**{table: there.where(F.col("id") != id_)}), {"id": id_, "outcome": "undone", "n_relations": n}


def _set_back(g: Graph, kind: str, snapshot: dict):
    """Inverse of an update: the row as it was before. An entity keeps its source and time, a relation needs both its ends."""
    table, _, schema = _KINDS[kind]
    before = snapshot["before"]
    rows = getattr(g, table)
    if not _has(rows, before["id"]):
        raise ValueError(f"{kind.lower()}_missing")
    done = {"id": before["id"], "outcome": "undone"}
    if kind == "RELATION":
        _ends_there(g, before)
    if kind != "ENTITY":
        return _put(g, kind, before), done
    hit = F.col("id") == before["id"]
    cols = [F.when(hit, F.lit(before[c])).otherwise(F.col(c)).alias(c) if c in ("name", "category", "attributes") else F.col(c) for c in schema.fieldNames()]
    return g.with_tables(entities=rows.select(*cols)), done


def _bring_back(g: Graph, kind: str, snapshot: dict):
    """Inverse of a deletion. A relation needs both its ends; relations lost with an entity stay lost."""
    table, key, _ = _KINDS[kind]
    row = snapshot[key]
    if _has(getattr(g, table), row["id"]):
        return g, {"id": row["id"], "outcome": "back"}
    if kind == "RELATION":
        _ends_there(g, row)
    lost = snapshot.get("cascaded_relations") or 0
    return _put(g, kind, row), {"id": row["id"], "outcome": "undone", "n_relations": lost}


_VERBS = {"ADD": _take_out, "UPDATE": _set_back, "DELETE": _bring_back}


def undo_log_rows(op_logs: DataFrame) -> DataFrame:
    """UNDO rows with the log id they undid."""
    return op_logs.where("op_type = 'UNDO'").select(
        "id", F.from_json("snapshot", "struct<undone_log:bigint>")["undone_log"].alias("undone_log"), iso_time("created_at").alias("at"))
