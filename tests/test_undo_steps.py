"""Undo of n steps in one job against a walk over plain rows, one step at a time."""

import json
import random

import pytest

from graphloom import schema as S
from graphloom.graph import make_graph
from graphloom.operators import changes as C
from graphloom.operators import undo as U
from graphloom.operators.undo_steps import undo_many


def walk(ents, rels, als, logs, n):
    """Plain single steps: rows as dictionaries by id."""
    ents, rels, als = ({k: dict(v) for k, v in t.items()} for t in (ents, rels, als))
    undone = {json.loads(s)["undone_log"] for _, t, s in logs if t == "UNDO"}
    left = sorted((x for x in logs if x[1] not in ("UNDO", "ADD_RELATION_IMAGE") and x[0] not in undone), reverse=True)[:n]
    out = []
    for step, (log, op, text) in enumerate(left, 1):
        snap, took, what = json.loads(text), 0, "undone"
        verb, _, kind = op.partition("_")
        if op == "RESTORE":
            out.append((step, log, op, None, "restored_before", 0))
            break
        table = {"ENTITY": ents, "RELATION": rels, "ALIAS": als}[kind]
        row = snap["before"] if verb == "UPDATE" else snap[kind.lower()]
        i, there = row["id"], row["id"] in table
        ends = kind == "RELATION" and [e for e in ("source_id", "target_id") if row[e] not in ents]
        if verb == "UPDATE" and not there:
            what = kind.lower() + "_missing"
        elif verb != "ADD" and not (verb == "DELETE" and there) and ends:
            what = ends[0] + "_missing"
        if what != "undone":
            out.append((step, log, op, i, what, 0))
            break
        if verb == "ADD" and not there:
            what = "gone"
        elif verb == "DELETE" and there:
            what = "back"
        elif verb == "ADD":
            del table[i]
            if kind == "ENTITY":
                fallen = [k for k, r in rels.items() if i in (r["source_id"], r["target_id"])]
                took = len(fallen)
                for k in fallen:
                    del rels[k]
                for k in [k for k, a in als.items() if a["entity_id"] == i]:
                    del als[k]
        elif verb == "UPDATE" and kind == "ENTITY":
            table[i].update({c: row[c] for c in ("name", "category", "attributes")})
        else:
            table[i] = dict(row)
            took = snap.get("cascaded_relations", 0)
        out.append((step, log, op, i, what, took))
    return ents, rels, als, out


def rows_of(spark, ents, rels, als, logs):
    stamp = lambda t, schema: spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in t.values()], schema)
    return make_graph(spark, entities=stamp(ents, S.ENTITIES), relations=stamp(rels, S.RELATIONS), aliases=stamp(als, S.ALIASES),
                      op_logs=spark.createDataFrame([(i, t, s, None, "x") for i, t, s in logs], S.OP_LOGS))


def ent(i, r):
    return {"id": i, "name": f"n{r.random():.6f}", "category": r.choice(S.ENTITY_CATEGORIES), "attributes": "{}", "source": "手工"}


def rel(i, r, ends):
    return {"id": i, "source_id": r.choice(ends), "target_id": r.choice(ends), "name": f"r{r.random():.6f}", "category": "互动",
            "confidence": r.choice(S.CONFIDENCES), "source_ref": f"p{i}", "source": "手工"}


@pytest.mark.parametrize("seed", [1, 4, 5])
def test_many_steps_as_one_job(spark, seed):
    r = random.Random(seed)
    ids = list(range(1, 9))
    safe = ids if seed % 2 else ids[:3]  # entities that logs add, change and delete; with fewer of them a walk goes farther
    ents = {i: ent(i, r) for i in ids if i != 8}
    rels = {i: rel(i, r, ids[:7]) for i in range(1, 15)}
    als = {i: {"id": i, "entity_id": r.choice(ids[:7]), "alias": f"a{i}"} for i in range(1, 8)}
    logs = []
    for k in range(1, 61):
        draw = r.random()
        if draw < 0.15:
            e = ent(r.choice(safe), r)
            logs.append((k, "ADD_ENTITY", json.dumps({"entity": e})))
        elif draw < 0.3:
            e = ent(r.choice(safe), r)
            logs.append((k, "DELETE_ENTITY", json.dumps({"entity": e, "cascaded_relations": k})))
        elif draw < 0.4:
            logs.append((k, "UPDATE_ENTITY", json.dumps({"before": ent(r.choice(ids[3:7]), r), "after": {}})))
        elif draw < 0.65:
            x = rel(r.randint(1, 10), r, ids[3:7] + ids[:1] * (seed % 3))
            logs.append((k, "DELETE_RELATION", json.dumps({"relation": x})))
        elif draw < 0.75:
            logs.append((k, "ADD_RELATION", json.dumps({"relation": rel(r.randint(1, 18), r, ids)})))
        elif draw < 0.8:
            logs.append((k, "UPDATE_RELATION", json.dumps({"before": rel(r.randint(11, 14), r, ids[3:7]), "after": {}})))
        elif draw < 0.9:
            logs.append((k, r.choice(["ADD_ALIAS", "DELETE_ALIAS"]), json.dumps({"alias": {"id": r.randint(1, 9), "entity_id": r.choice(ids), "alias": f"b{k}"}})))
        else:
            logs.append((k, "UNDO", json.dumps({"undone_log": r.randint(1, k)})))
    if seed == 4:
        logs[20] = (21, "RESTORE", "{}")
    n = None if seed < 5 else 17
    want_e, want_r, want_a, want = walk(ents, rels, als, logs, n)
    g, shown = undo_many(rows_of(spark, ents, rels, als, logs), n)
    assert sorted(tuple(x) for x in shown.collect()) == want
    pick = lambda t, cols: sorted(tuple(x.get(c) for c in cols) for x in t.values())
    for got, plain, cols in ((g.entities, want_e, ["id", "name", "category", "attributes", "source"]),
                             (g.relations, want_r, ["id", "source_id", "target_id", "name", "category", "confidence", "source_ref", "source"]),
                             (g.aliases, want_a, ["id", "entity_id", "alias"])):
        assert sorted(tuple(x) for x in got.select(*cols).collect()) == pick(plain, cols)
    logged = [json.loads(x.snapshot)["undone_log"] for x in g.op_logs.where("id > 60").orderBy("id").collect()]
    assert logged == [x[1] for x in want if not x[4].endswith(("missing", "before"))]


def test_a_row_deleted_twice_and_a_death_between(spark):
    """The second deletion brings back nothing while the row lives, and its own row once an end's death took the first one."""
    e = {i: {"id": i, "name": f"e{i}", "category": "抽象实体", "attributes": "{}", "source": "x"} for i in (1, 2, 3, 4)}
    x = lambda a, b, name: {"id": 5, "source_id": a, "target_id": b, "name": name, "category": "互动", "confidence": "确证", "source_ref": "", "source": "x"}
    cut = lambda k, row: (k, "DELETE_RELATION", json.dumps({"relation": row}))
    logs = [cut(1, x(3, 4, "d")), (2, "ADD_ENTITY", json.dumps({"entity": e[2]})), cut(3, x(3, 4, "c")), cut(4, x(3, 4, "b")), cut(5, x(1, 2, "a"))]
    want_e, want_r, _, want = walk(e, {}, {}, logs, None)
    g, shown = undo_many(rows_of(spark, e, {}, {}, logs))
    assert sorted(tuple(y) for y in shown.collect()) == want and [y[4] for y in want] == ["undone", "back", "back", "undone", "undone"]
    assert [(y.id, y.name) for y in g.relations.collect()] == [(5, "d")] == [(y["id"], y["name"]) for y in want_r.values()]


def test_single_steps_and_one_job_agree(spark, make):
    g = make(["A", "B"], [])
    for s in ({"op": "add_entity", "name": "C", "category": "抽象实体"},
              {"op": "add_relation", "source_id": 1, "target_id": 3, "name": "r", "category": "互动", "confidence": "存疑", "evidence_ref": "p1"},
              {"op": "update_entity", "id": 1, "name": "A9"}, {"op": "delete_entity", "id": 3}):
        full = {c: s.get(c) for c in S.OPS.fieldNames()} | {"op_idx": 1}
        g = C.apply_ops(g, spark.createDataFrame([full], S.OPS)).graph
    single = g
    for _ in range(3):
        single, _ = U.undo_last(single)
    many, shown = undo_many(g, 3)
    for t in ("entities", "relations", "aliases"):
        assert sorted(map(str, getattr(single, t).collect())) == sorted(map(str, getattr(many, t).collect()))
    rest, more = undo_many(many)
    assert [x.outcome for x in shown.collect()] == ["undone"] * 3 and more.count() == 2
    assert {x.name for x in rest.entities.collect()} == {"A", "B"} and undo_many(rest)[1].count() == 0
    with pytest.raises(ValueError):
        undo_many(g, 0)
