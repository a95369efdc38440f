"""Undo of the last n changes as one job, with the result that n single undos have.

The steps are not replayed one by one. Every entity, relation and alias gets its own history of inverse operations, ordered by
step; what a step meets is the last value before it. An entity that goes takes along the relations and aliases that refer to it
at that step, so the life of these is cut into segments between their own operations, and a segment ends early at the first
step at which one of its ends goes.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.graph import Graph
from graphloom.operators.changes import high_water
from graphloom.operators.frontier import union
from graphloom.operators.undo import SKIPPED
from graphloom.session import at_least, broadcast_bounded, discard, fixed_now, materialize, running, with_position

_ROW = ("struct<id:bigint,name:string,category:string,attributes:string,created_at:string,source:string,source_id:bigint,target_id:bigint,"
        "confidence:string,source_ref:string,entity_id:bigint,alias:string>")
_SNAPSHOT = f"struct<entity:{_ROW},relation:{_ROW},alias:{_ROW},before:{_ROW},cascaded_relations:bigint>"
_KINDS = {"entities": "ENTITY", "relations": "RELATION", "aliases": "ALIAS"}
_ENDS = {"relations": ["source_id", "target_id"], "aliases": ["entity_id"]}
_NEVER = 2**62


def undo_steps(op_logs: DataFrame, n: int | None = None) -> DataFrame:
    """(step, log_id, op_type, kind, verb, id, row, lost): the changes that n undos in turn concern, newest first from step 1; all
    without ``n``. ``row`` is the row the snapshot tells: added, deleted, or as it was before an update."""
    undone = op_logs.where("op_type = 'UNDO'").select(F.from_json("snapshot", "struct<undone_log:bigint>")["undone_log"].alias("id"))
    left = op_logs.where(~F.col("op_type").isin(SKIPPED)).join(undone.where("id is not null"), "id", "left_anti")
    steps = with_position(left.select(F.col("id").alias("log_id"), "op_type", "snapshot"), F.desc("log_id"), name="step")
    if n is not None:
        steps = steps.where(F.col("step") < at_least(n, 1, "n"))
    s, verb, kind = F.from_json("snapshot", _SNAPSHOT), F.substring_index("op_type", "_", 1), F.substring_index("op_type", "_", -1)
    row = F.when(verb == "UPDATE", s["before"]).when(kind == "ENTITY", s["entity"]).when(kind == "RELATION", s["relation"]).otherwise(s["alias"])
    steps = steps.select((F.col("step") + 1).alias("step"), "log_id", "op_type", kind.alias("kind"), verb.alias("verb"), row.alias("row"),
                         F.coalesce(s["cascaded_relations"], F.lit(0)).alias("lost"))
    return steps.withColumn("id", F.col("row.id"))


def _table_rows(rows: DataFrame, table: str, value: str = "row") -> DataFrame:
    """Rows of a snapshot in the columns of their table; relations logged before confidences came get the usual one."""
    later = {"confidence": S.DEFAULT_CONFIDENCE, "source_ref": ""}
    cols = []
    for f in S.TABLES[table].fieldNames():
        c = F.col(f"{value}.{f}")
        if f == "created_at":
            c = F.try_to_timestamp(c)
        elif table == "relations" and f in later:
            c = F.when(c.isNull() | (c == ""), later[f]).otherwise(c)
        cols.append(c.alias(f))
    return rows.select(*[c for c in rows.columns if c not in S.TABLES[table].fieldNames() and c != value], F.struct(*cols).alias("row"))


def _entity_states(g: Graph, steps: DataFrame) -> DataFrame:
    """(step, slot, eid, alive): whether an entity is there when a step looks at it: slot 0 is the step's own entity, 1 and 2 are the
    ends of its relation."""
    own = steps.where("kind = 'ENTITY'").select(
        "step", F.lit(0).alias("slot"), F.col("id").alias("eid"), F.when(F.col("verb") == "ADD", 0).when(F.col("verb") == "DELETE", 1).alias("sets"))
    ends = steps.where("kind = 'RELATION' and verb <> 'ADD'").select("step", F.explode(F.array(
        *[F.struct(F.lit(i + 1).alias("slot"), F.col(f"row.{c}").alias("eid")) for i, c in enumerate(_ENDS["relations"])])).alias("e"))
    asks = own.union(ends.select("step", "e.slot", "e.eid", F.lit(None).cast("int"))).withColumn("_o", F.col("step") * 3 + F.col("slot"))
    there = g.entities.select(F.col("id").alias("eid"), F.lit(1).alias("_there"))
    before = running(asks, "eid", "_o", last=["sets"]).join(there, "eid", "left")
    missing = asks.where("eid is null").select("step", "slot", "eid", F.lit(False).alias("alive"))
    return before.select("step", "slot", "eid", (F.coalesce("prev_sets", "_there", F.lit(0)) == 1).alias("alive")).union(missing)


def _first_death(rows: DataFrame, ends: list[str], deaths: DataFrame, keys: list[str], within: bool) -> DataFrame:
    """(keys, killed): the first step at which an end goes, between ``step`` and ``next`` if ``within``."""
    small = broadcast_bounded(deaths)
    hits = [rows.join(small, F.col(c) == F.col("eid")) for c in ends]
    hits = [h.where("death > step and death < next") if within else h for h in hits]
    return union([h.select(*keys, "death") for h in hits]).groupBy(*keys).agg(F.min("death").alias("killed"))


def _dependents(g: Graph, table: str, steps: DataFrame, deaths: DataFrame):
    """(points, meets) of the relations or aliases that steps name.

    Points are (id, step, alive, killed, row): their states, from step 0 as stored, each up to the next point unless killed before.
    Meets are (step, alive): what each step finds. A deletion undone while the row exists again leaves it as it is, and is no point;
    which ones these are can depend on earlier ones of the same row, so they are settled in rounds: one, unless a log deletes
    a row twice.
    """
    own = steps.where(F.col("kind") == _KINDS[table])
    ids = own.select("id").where("id is not null").distinct()
    stored = getattr(g, table).join(broadcast_bounded(ids), "id", "left_semi")
    fields = S.TABLES[table].fieldNames()
    first = stored.select("id", F.lit(0).cast("long").alias("step"), F.lit(True).alias("alive"), F.struct(*fields).alias("row"))
    told = _table_rows(own.where("id is not null").select("step", F.col("id").alias("_id"), "verb", "row"), table)
    changes = told.select(F.col("_id").alias("id"), "step", (F.col("verb") != "ADD").alias("alive"), "row")
    every = materialize(first.union(changes), "points")
    again, n_again = None, 0
    while True:
        real = every if again is None else every.join(again, ["id", "step"], "left_anti")
        follow = running(real.withColumn("_back", -F.col("step")), "id", "_back", last=["step"])
        spans = follow.withColumn("next", F.coalesce("prev_step", F.lit(_NEVER))).drop("_back", "prev_step")
        lives = spans.where("alive").select("id", "step", "next", *[F.col(f"row.{c}").alias(c) for c in _ENDS[table]])
        killed = _first_death(lives, _ENDS[table], deaths, ["id", "step"], True)
        points = materialize(spans.join(killed, ["id", "step"], "left").withColumn("killed", F.coalesce("killed", F.lit(_NEVER))).drop("next"), "points")
        state = points.select("id", "step", F.when(F.col("alive"), F.col("killed")).otherwise(0).alias("until"))
        asks = every.where("step > 0").join(points.select("id", "step"), ["id", "step"], "left_anti")
        seen = running(state.union(asks.select("id", "step", F.lit(None).cast("long"))), "id", "step", last=["until"]).where("step > 0")
        meets = materialize(seen.select("id", "step", (F.coalesce("prev_until", F.lit(0)) > F.col("step")).alias("alive")), "meets")
        verbs = own.select("id", "step", "verb")
        back, n_back = materialize(meets.where("alive").join(verbs.where("verb = 'DELETE'"), ["id", "step"], "left_semi").select("id", "step"), "back", counted=True)
        same = n_back == n_again and (n_back == 0 or back.join(again, ["id", "step"], "left_anti").isEmpty())
        if same:
            return points, meets.select("step", "alive")
        again, n_again = back, n_back
        discard(points, meets)


def _outcomes(steps: DataFrame, states: DataFrame, meets: DataFrame) -> DataFrame:
    """Steps with ``outcome`` and ``stands``: whether the outcome stands in the way of this and all further steps."""
    end = lambda slot, name: states.where(F.col("slot") == slot).select("step", F.col("alive").alias(name))
    seen = states.where("slot = 0").select("step", "alive").union(meets)
    s = steps.join(seen, "step", "left").join(end(1, "_source"), "step", "left").join(end(2, "_target"), "step", "left")
    verb, kind, alive = F.col("verb"), F.col("kind"), F.col("alive")
    known = verb.isin("ADD", "UPDATE", "DELETE") & kind.isin(*_KINDS.values()) & (F.col("op_type") == F.concat_ws("_", verb, kind))
    ends = F.when(~F.col("_source"), "source_id_missing").when(~F.col("_target"), "target_id_missing")
    block = (
        F.when(F.col("op_type") == "RESTORE", "restored_before").when(~known, "unknown_operation").when(F.col("id").isNull(), "snapshot_unreadable")
        .when((verb == "UPDATE") & ~alive, F.concat(F.lower(kind), F.lit("_missing")))
        .when((kind == "RELATION") & ((verb == "UPDATE") | ((verb == "DELETE") & ~alive)), ends))
    calm = F.when((verb == "ADD") & ~alive, "gone").when((verb == "DELETE") & alive, "back").otherwise("undone")
    return s.select(*steps.columns, F.coalesce(block, calm).alias("outcome"), block.isNotNull().alias("stands"))


def _replace(table: DataFrame, touched: DataFrame, rows: DataFrame) -> DataFrame:
    """The table without the ids of ``touched``, and with ``rows`` instead."""
    return table.join(broadcast_bounded(touched), "id", "left_anti").select(*rows.columns).unionByName(rows)


def _new_entities(g: Graph, done: DataFrame) -> DataFrame:
    """Entities after the steps done: the last row brought back or stored, with name, category and attributes of the last update after it."""
    fields = S.ENTITIES.fieldNames()
    own = done.where("kind = 'ENTITY'").select("id", "step", "verb", "outcome", "row")
    put = (F.col("verb") == "DELETE") & (F.col("outcome") == "undone")
    sets = F.when(F.col("verb") == "ADD", 0).when(F.col("verb") == "DELETE", 1)
    at = lambda test: F.when(test, F.col("step"))
    last = own.groupBy("id").agg(
        F.max_by(sets, at(sets.isNotNull())).alias("_sets"), F.max_by("row", at(put)).alias("_put"), F.max(at(put)).alias("_put_at"),
        F.max_by("row", at(F.col("verb") == "UPDATE")).alias("_patch"), F.max(at(F.col("verb") == "UPDATE")).alias("_patch_at"))
    last = materialize(last, "entity_changes")
    stored = g.entities.join(broadcast_bounded(last.select("id")), "id", "left_semi").select("id", F.struct(*fields).alias("_old"))
    both = last.join(stored, "id", "left").where("coalesce(_sets, 1) = 1")
    patched = F.col("_patch_at") > F.coalesce("_put_at", F.lit(0))

    def value(f):
        new = F.col(f"_put.{f}")
        new = F.try_to_timestamp(new) if f == "created_at" else new
        base = F.when(F.col("_put_at").isNotNull(), new).otherwise(F.col(f"_old.{f}"))
        return (F.when(patched, F.col(f"_patch.{f}")).otherwise(base) if f in ("name", "category", "attributes") else base).alias(f)

    rows = both.select("id", *[value(f) for f in fields if f != "id"]).select(*fields)
    return _replace(g.entities, last.select("id"), rows)


def undo_many(g: Graph, n: int | None = None, source: str = "手工", marks: dict | None = None):
    """(new graph, outcomes): undo the last ``n`` changes, or all, and log one UNDO row a step.

    Outcomes has one row a step: ``step`` from 1, ``log_id``, ``op_type``, ``id`` of the row concerned, ``outcome`` and ``n_relations``, as
    ``undo_last`` gives them. A step that cannot be undone ends the walk: it is the last row, its outcome tells what stands in
    the way (restored_before, unknown_operation, snapshot_unreadable, entity_missing, relation_missing, alias_missing,
    source_id_missing, target_id_missing), it is not logged, and the graph is the one before it. Fewer changes than ``n``
    are all undone; a log without any gives no rows.
    """
    steps = materialize(undo_steps(g.op_logs, n), "undo_steps")
    states = materialize(_entity_states(g, steps), "undo_states")
    deaths = materialize(states.where("slot = 0 and alive").join(steps.where("kind = 'ENTITY' and verb = 'ADD'"), "step", "left_semi").select(
        "eid", F.col("step").alias("death")), "undo_deaths")
    parts = {t: _dependents(g, t, steps, deaths) for t in _ENDS}
    judged = materialize(_outcomes(steps, states, union([m for _, m in parts.values()])), "undo_outcomes")
    stop = judged.where("stands").agg(F.min("step")).first()[0] or _NEVER
    done = judged.where(F.col("step") < stop)
    deaths = deaths.where(F.col("death") < stop)

    tables, falls = {}, {}
    for t, (points, _) in parts.items():
        fields, points = S.TABLES[t].fieldNames(), points.where(F.col("step") < stop)
        touched = steps.where((F.col("kind") == _KINDS[t]) & F.col("id").isNotNull()).select("id").distinct()
        others = getattr(g, t).join(broadcast_bounded(touched), "id", "left_anti")
        fallen = materialize(_first_death(others, _ENDS[t], deaths, ["id"], False), "undo_fallen")
        final = points.groupBy("id").agg(F.max_by(F.struct("alive", "killed", "row"), "step").alias("_last"))
        rows = final.where(F.col("_last.alive") & (F.col("_last.killed") >= stop)).select("_last.row.*").select(*fields)
        tables[t] = others.join(broadcast_bounded(fallen.select("id")), "id", "left_anti").select(*fields).unionByName(rows)
        falls[t] = fallen.select(F.col("killed").alias("step")).union(points.where(F.col("alive") & (F.col("killed") < stop)).select(F.col("killed").alias("step")))
    took = falls["relations"].groupBy("step").agg(F.count(F.lit(1)).alias("_took"))
    n_relations = (F.when(F.col("stands") | (F.col("outcome") != "undone"), 0).when(F.col("verb") == "ADD", F.coalesce("_took", F.lit(0)))
                   .when((F.col("verb") == "DELETE") & (F.col("kind") != "ALIAS"), F.col("lost")).otherwise(0))
    shown = judged.where(F.col("step") <= stop).join(took, "step", "left").select(
        "step", "log_id", "op_type", "id", "outcome", n_relations.cast("long").alias("n_relations"), "stands")
    shown = materialize(shown, "undo_shown")

    mark = dict(marks or high_water(g))["op_logs"]
    snap = F.to_json(F.struct(F.col("log_id").alias("undone_log"), "op_type", "n_relations", "id", "outcome"))
    logs = shown.where("not stands").select((F.lit(mark) + F.col("step")).alias("id"), F.lit("UNDO").alias("op_type"), snap.alias("snapshot"),
                                            fixed_now().alias("created_at"), F.lit(source).alias("source"))
    own = F.col("entity_id") == F.col("eid")
    out = g.with_tables(
        entities=_new_entities(g, done), **tables, op_logs=g.op_logs.select(*S.OP_LOGS.fieldNames()).unionByName(logs),
        entity_images=g.entity_images.join(broadcast_bounded(deaths.select("eid").distinct()), own, "left_anti"))
    return out, shown.drop("stands")
