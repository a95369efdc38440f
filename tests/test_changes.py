import json
import os
import time

import pytest

from graphloom import schema as S
from graphloom.graph import save_graph
from graphloom.operators import changes as C
from graphloom.operators import search as Q
from graphloom.operators import undo as U
from graphloom.sources import export as X
from graphloom.sources.versions import VersionStore
from graphloom.streaming import changes as ST


def ops(spark, *rows):
    data = [tuple({"op_idx": i + 1, **r}.get(n) for n in S.OPS.fieldNames()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, S.OPS)


def names(df):
    return {r.name for r in df.select("name").collect()}


def test_batch_sees_its_own_earlier_rows(spark, make):
    g = make(["A", "B"], [("A", "r", "B")], aliases=[("B", "bee")])
    r = C.apply_ops(g, ops(
        spark,
        {"op": "add_entity", "name": " New ", "category": "抽象实体", "ref": "n", "aliases": ["nu", "bee", "New", " "]},
        {"op": "add_relation", "source_key_ref": "n", "target_name": "bee", "name": "r", "category": "互动"},
        {"op": "update_entity", "id": 3, "name": "Newer"},
        {"op": "add_relation", "source_name": "nu", "target_id": 1, "name": "s", "category": "互动", "confidence": ""},
        {"op": "update_entity", "id": 1, "attributes": '{"k":1}'},
        {"op": "update_entity", "id": 1, "name": "A2"},
        {"op": "delete_entity", "id": 2},
    ))
    assert r.error is None
    ents = {e.id: (e.name, e.attributes) for e in r.graph.entities.collect()}
    assert ents == {1: ("A2", '{"k":1}'), 3: ("Newer", "{}")}
    assert {(x.source_id, x.target_id, x.name, x.confidence) for x in r.graph.relations.collect()} == {(3, 1, "s", "确证")}
    assert {(a.entity_id, a.alias) for a in r.graph.aliases.collect()} == {(3, "nu")}
    kinds = [(x.id, x.op_type) for x in r.graph.op_logs.orderBy("id").collect()]
    assert kinds == list(enumerate(["ADD_ENTITY", "ADD_ALIAS", "ADD_RELATION", "UPDATE_ENTITY", "ADD_RELATION", "UPDATE_ENTITY", "UPDATE_ENTITY",
                                    "DELETE_RELATION", "DELETE_RELATION", "DELETE_ENTITY"], 1))
    last = json.loads(r.graph.op_logs.where("id = 10").first().snapshot)
    assert last["cascaded_relations"] == 2 and last["entity"]["name"] == "B"
    up = json.loads(r.graph.op_logs.where("id = 7").first().snapshot)
    assert up["before"]["attributes"] == '{"k":1}' and up["after"]["name"] == "A2"
    assert {(a.op_idx, a.aliases_added) for a in r.applied.where("op = 'add_entity'").collect()} == {(1, 4)}
    report = C.apply_report(r.applied).first()
    assert (report.entities_added, report.relations_added, report.others) == (1, 2, 4)


@pytest.mark.parametrize("bad,text", [
    ({"op": "add_relation", "source_id": 1, "target_id": 1, "name": "r", "category": "互动"}, "起点与终点不能为同一实体"),
    ({"op": "add_relation", "source_key_ref": "zz", "target_id": 1, "name": "r", "category": "互动"}, "ref占位符\"zz\""),
    ({"op": "add_relation", "source_name": "twin", "target_id": 1, "name": "r", "category": "互动"}, "存在2个候选"),
    ({"op": "add_relation", "source_name": "nobody", "target_id": 1, "name": "r", "category": "互动"}, "不存在（本批或库中均未找到）"),
    ({"op": "update_entity", "id": 3, "name": "x"}, "实体id=3 不存在"),
    ({"op": "delete_entity", "id": 3}, "实体id=3 不存在"),
    ({"op": "delete_relation", "id": 2}, "关系id=2 不存在"),
    ({"op": "add_entity", "name": "x", "category": "抽象实体", "attributes": '{"a":[1]}'}, "禁止嵌套对象或数组"),
    ({"op": "drop"}, "未知操作类型"),
])
def test_first_bad_operation_rejects_all(spark, make, bad, text):
    g = make(["A", "B", "C", "twin", "twin"], [("A", "r", "B"), ("C", "r", "A")])
    r = C.apply_ops(g, ops(spark, {"op": "delete_entity", "id": 3}, bad, {"op": "delete_entity", "id": 99}))
    assert r.error.startswith(f"第2条操作({bad['op']})失败") and text in r.error
    assert r.graph.entities.count() == 5 and r.graph.op_logs.count() == 0


def test_relation_versions_follow_updates(spark, make):
    g = make(["A", "B", "C"], [("A", "r", "B")])
    r = C.apply_ops(g, ops(spark, {"op": "update_relation", "id": 1, "target_id": 3}, {"op": "delete_entity", "id": 2},
                           {"op": "update_relation", "id": 1, "name": "s"}, {"op": "delete_entity", "id": 3}))
    assert r.error is None and r.graph.relations.count() == 0
    assert {(a.op_idx, a.cascaded_relations) for a in r.applied.where("op = 'delete_entity'").collect()} == {(2, 0), (4, 1)}
    late = C.apply_ops(g, ops(spark, {"op": "delete_entity", "id": 2}, {"op": "update_relation", "id": 1, "name": "s"}))
    assert "关系id=1 不存在" in late.error


def test_alias_goes_to_the_next_claim_when_its_owner_is_deleted(spark, make):
    g = make(["A"], [])
    add = lambda n: {"op": "add_entity", "name": n, "category": "抽象实体", "aliases": ["x"]}
    r = C.apply_ops(g, ops(spark, add("B"), add("C"), {"op": "delete_entity", "id": 2}, add("D")))
    assert {(a.entity_id, a.alias) for a in r.graph.aliases.collect()} == {(4, "x")}


def test_undo_walks_back_step_by_step(spark, make):
    g = make(["A", "B"], [])
    steps = [
        {"op": "add_entity", "name": "C", "category": "抽象实体"},
        {"op": "add_relation", "source_id": 1, "target_id": 3, "name": "r", "category": "互动", "confidence": "存疑", "evidence_ref": "p1"},
        {"op": "update_entity", "id": 1, "name": "A9"},
        {"op": "delete_entity", "id": 3},
    ]
    for s in steps:
        g = C.apply_ops(g, ops(spark, s)).graph
    assert [x.op_type for x in g.op_logs.orderBy("id").collect()] == ["ADD_ENTITY", "ADD_RELATION", "UPDATE_ENTITY", "DELETE_RELATION", "DELETE_ENTITY"]
    g, done = U.undo_last(g)
    assert names(g.entities) == {"A9", "B", "C"} and done == {"op_type": "DELETE_ENTITY", "id": 3, "outcome": "undone", "n_relations": 1} and g.relations.count() == 0
    g, _ = U.undo_last(g)
    back = g.relations.first()
    assert (back.confidence, back.source_ref) == ("存疑", "p1")
    g, _ = U.undo_last(g)
    assert names(g.entities) == {"A", "B", "C"}
    g, _ = U.undo_last(g)
    g, _ = U.undo_last(g)
    assert names(g.entities) == {"A", "B"} and g.relations.count() == 0
    with pytest.raises(ValueError):
        U.undo_last(g)


def test_aliases_statuses(spark, make):
    g = make(["A", "B"], [], aliases=[("B", "bee")])
    req = spark.createDataFrame([(1, 1, "B"), (2, 1, "bee"), (3, 1, "A"), (4, 1, " "), (5, 9, "x"), (6, 2, "bee"), (7, 1, "new"), (8, 2, "new")],
                                "req_idx long, entity_id long, alias string")
    assert [r.status for r in C.add_aliases(g, req).orderBy("req_idx").collect()] == [409, 409, 400, 400, 404, 200, 201, 409]


def test_vectors(spark, make):
    g = make(["A", "B"], [])
    new = spark.createDataFrame([(1, "a", [1.0, 0.0], 1), (2, "b", [0.0, 1.0], 2), (2, "b2", [1.0, 1.0], 3), (7, "z", [1.0, 0.0], 1)],
                                "entity_id long, text string, vector array<float>, t long").selectExpr("entity_id", "text", "vector", "timestamp_seconds(t) AS updated_at")
    g = g.with_tables(vectors=Q.upsert_vectors(g.vectors, new))
    assert {(r.entity_id, r.text) for r in g.vectors.collect()} == {(1, "a"), (2, "b2"), (7, "z")}
    assert [r.entity_id for r in Q.orphan_vectors(g).collect()] == [7]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>")
    assert {(r.id, round(r.score, 4)) for r in Q.vector_topk(q, g.vectors, 5, 0.1).collect()} == {(1, 1.0), (2, 0.7071), (7, 1.0)}


def test_many_terms_use_the_automaton(spark, make):
    names_ = [f"name{i}x" for i in range(100)]
    g = make(names_, [])
    q = spark.createDataFrame([(i, n) for i, n in enumerate(names_)] + [(500, "AME5")], "qid long, text string")
    got = {(r.qid, r.id, r.score) for r in Q.keyword_search(g, q).collect()}
    assert {(i, i + 1, 10) for i in range(100)} <= got
    assert {r[1] for r in got if r[0] == 500} == {6} | {51 + i for i in range(10)}


def test_versions_and_restore(spark, make, tmp_path):
    g = make(["A"], [])
    vs = VersionStore(spark, str(tmp_path / "v"))
    assert vs.savepoint(g, "one")["committed"] and not vs.savepoint(g, "again")["committed"]
    after = C.apply_ops(g, ops(spark, {"op": "add_entity", "name": "B", "category": "抽象实体"})).graph
    assert vs.savepoint(after, "two")["log_range"] == [1, 1]
    back, _ = vs.restore(after, 1)
    assert names(back.entities) == {"A"} and back.op_logs.first().op_type == "RESTORE"
    assert [r.title for r in vs.history().collect()] == ["two", "one"]
    assert [r.title for r in vs.retained().collect()] == ["one"]
    with pytest.raises(ValueError):
        vs.restore(after, 77)


def test_import_contract_and_upgrade(spark, make):
    g = make(["A", "B"], [("A", "r", "B")])
    t = {"entities": g.entities, "relations": g.relations, "op_logs": g.op_logs}
    assert "缺少必需的数据表" in X.check_import({"entities": g.entities})
    assert "target_id" in X.check_import({**t, "relations": g.relations.drop("target_id")})
    old = X.upgrade_legacy({"relations": g.relations.drop("confidence", "source_ref")})
    row = X.upgrade_legacy(old)["relations"].first()
    assert (row.confidence, row.source_ref) == ("确证", "")


def test_stream_applies_batches_once(spark, make, tmp_path):
    vs = VersionStore(spark, str(tmp_path / "store"))
    vs.savepoint(make(["A", "B"], []), "start")
    good = {"op": "add_entity", "name": "C", "category": "抽象实体"}
    for key, rows in (("k1", [good]), ("k2", [{"op": "delete_entity", "id": 99}])):
        ops(spark, *rows).selectExpr("*", f"'{key}' AS batch_key").write.mode("append").parquet(str(tmp_path / "ops"))
    for i in range(2):
        ST.stream_apply_ops(spark, str(tmp_path / "ops"), vs, str(tmp_path / f"cp{i}"), {"availableNow": True}).awaitTermination()
    assert sorted(r.title for r in vs.history().collect()) == ["batch k1", "start"]
    assert names(vs.at(2).entities) == {"A", "B", "C"}
    assert {r.batch_key for r in spark.read.parquet(str(tmp_path / "store/refused")).collect()} == {"k2"}


def _recorded(monkeypatch):
    """Tables written by batches, by tag and path."""
    from graphloom import session

    written = []

    def note(keep):
        def write(df, tag="t", **kw):
            out = keep(df, tag, **kw)
            written.append((tag, out[0] if isinstance(out, tuple) else out))
            return out
        return write

    monkeypatch.setattr(C, "materialize", note(C.materialize))
    monkeypatch.setattr(session, "materialize", note(session.materialize))
    return written


def test_a_batch_removes_the_tables_that_only_its_steps_read(spark, make, monkeypatch):
    written = _recorded(monkeypatch)
    g = make(["A", "B"], [("A", "r", "B")], aliases=[("B", "bee")])
    r = C.apply_ops(g, ops(
        spark,
        {"op": "add_entity", "name": "New", "category": "抽象实体", "ref": "n", "aliases": ["nu"]},
        {"op": "add_relation", "source_key_ref": "n", "target_name": "B", "name": "r", "category": "互动"},
        {"op": "delete_entity", "id": 1},
    ))
    left = {tag for tag, t in written if os.path.exists(t.scratch_path)}
    assert not left & {"uses", "tries", "free_tries", "won", "taken", "life", "new_relations"}
    assert {(a.entity_id, a.alias) for a in r.graph.aliases.collect()} == {(2, "bee"), (3, "nu")}
    assert {(x.op, x.cascaded_relations) for x in r.applied.collect()} == {("add_entity", None), ("add_relation", None), ("delete_entity", 1)}


def test_a_saved_graph_leaves_no_shuffles(spark, make, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    g = make(["A", "B"], [("A", "r", "B")])
    before = shuffles()
    save_graph(g.with_tables(entities=g.entities.distinct(), relations=g.relations.distinct()), str(tmp_path / "g"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before


def test_reset_writes_its_log_rows_once(spark, make, monkeypatch):
    written = _recorded(monkeypatch)
    n = [f"n{i}" for i in range(30)]
    g = make(n, [(a, "r", b) for a, b in zip(n, n[1:])])
    r = C.reset_graph(g, confirm=True)
    rows = [(tag, t.columns) for tag, t in written if "snapshot" in t.columns]
    assert rows == [("pos", ["op_type", "snapshot", "_range", "_rn"])]
    logs = r.graph.op_logs.orderBy("id").collect()
    assert [x.id for x in logs] == list(range(1, 60)) and r.high_water["op_logs"] == 59
    assert [x.op_type for x in logs[:4]] == ["DELETE_RELATION", "DELETE_ENTITY", "DELETE_RELATION", "DELETE_ENTITY"]
    assert '"reason":"级联删除(实体id=1)"' in logs[0].snapshot and '"cascaded_relations":1' in logs[1].snapshot
