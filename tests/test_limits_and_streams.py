"""Arguments mean what they say; versions and streamed batches keep what they are given."""

import os
import random
import subprocess
import sys

import pytest

from graphloom import schema as S
from graphloom.operators import aggregates as A
from graphloom.operators import match as M
from graphloom.operators import recommend as R
from graphloom.operators import search as Q
from graphloom.operators import traverse as T
from graphloom.operators import undo as U
from graphloom.sources import export as X
from graphloom.sources.versions import VersionStore
from graphloom.streaming import changes as ST


def names(df):
    return {r.name for r in df.select("name").collect()}


def test_one_alias_list_per_entity(spark, make):
    g = make(["A", "B"], [])
    many = spark.range(65_530, 65_545).selectExpr("id", "CAST(1 AS BIGINT) AS entity_id", "concat('a', id) AS alias", "CAST(NULL AS TIMESTAMP) AS created_at")
    g = g.with_tables(aliases=many)
    assert A.alias_map(g.aliases).count() == 1
    page = A.list_entities(g, limit=1).collect()
    assert len(page) == 1 and page[0].aliases == [f"a{i}" for i in range(65_530, 65_545)]
    details = A.entity_details(g, spark.createDataFrame([(1,), (2,)], "id long")).collect()
    assert sorted(len(r.aliases) for r in details) == [0, 15]
    assert A.alias_rows(g.aliases).count() == 15


def test_limits_are_honoured(spark, make):
    n = 620
    g = make([f"e{i}" for i in range(n)], [(f"e{i}", "r", f"e{(i + 1) % n}") for i in range(n)])
    assert A.list_entities(g, limit=600).count() == 600
    assert M.match_edges(g, ["互动"], limit=610).count() == 610
    assert M.match_edges_ci(g, "r", limit=60).count() == 60
    assert M.match_edges_count(g, ["互动"], limit=615).first()["count"] == 615
    e, r, totals = A.graph_payload(g, 2100, 5100)
    assert e.count() == n and r.count() == n and not totals.first().truncated
    assert R.recommend(g, min_common=1, limit=130).count() == 130
    q = spark.createDataFrame([(1, "e1")], "qid long, text string")
    assert Q.keyword_topk(g, q, 60).count() == 60
    assert Q.mentions(spark.createDataFrame([(1, " ".join(f"e{i}" for i in range(100, 130)))], "qid long, text string"), g.entities).count() >= 30
    for call in (lambda: M.match_edges(g, limit=0), lambda: A.list_entities(g, limit=-1), lambda: Q.keyword_topk(g, q, 0), lambda: R.recommend(g, limit=0)):
        with pytest.raises(ValueError):
            call()


def test_paths_beyond_former_limits(spark, make):
    chain = [f"c{i}" for i in range(9)]
    g = make(chain + [f"m{i}" for i in range(14)] + ["s", "t"], [(a, "r", b) for a, b in zip(chain, chain[1:])] + [x for i in range(14) for x in (("s", "r", f"m{i}"), (f"m{i}", "r", "t"))])
    ids = {r.name: r.id for r in g.entities.collect()}
    pairs = spark.createDataFrame([(ids["c0"], ids["c8"]), (ids["s"], ids["t"])], "source_id long, target_id long")
    rows = T.all_paths(g, pairs, max_hops=8, limit=14).collect()
    assert sum(r.source_id == ids["s"] for r in rows) == 14 and [r.hops for r in rows if r.source_id == ids["c0"]] == [8]


def test_hub_pairs_are_kept_unless_asked(spark, make):
    leaves = [f"x{i}" for i in range(8)]
    g = make(["h", "k", *leaves], [(h, "r", x) for h in ("h", "k") for x in leaves])
    hubs = lambda **kw: {(r.source_id, r.target_id) for r in R.recommend(g, min_common=5, **kw).collect()}
    assert (1, 2) in hubs() and (1, 2) not in hubs(hub_degree=7)


def test_undo_sees_the_whole_log(spark, make):
    logs = [(1, "ADD_ENTITY", "{}", None, "x")] + [(i, "UNDO", '{"undone_log": %d}' % (i - 1000), None, "x") for i in range(2, 150)]
    g = make(["A"], [], logs=logs)
    assert U.undo_candidate(g.op_logs).first().id == 1
    assert U.undo_candidate(g.op_logs, look_back=100).count() == 0


def test_graph_stats(spark, make):
    g = make(["A", "B"], [("A", "r", "B")])
    row = A.graph_stats(g).first()
    assert (row.entities, row.relations, row.version, row.inferred_relations, row.indexed_vectors) == (2, 1, 0, 0, 0)
    # three relations are stored, none of them guessed; the rules find A-位于->C, B-挚友->A and C-学生为->A
    g = make(["A", "B", "C"], [("A", "位于", "B"), ("B", "位于", "C"), ("A", "挚友", "B"), ("A", "师从", "C")])
    row = A.graph_stats(g).first()
    assert (row.entities, row.relations, row.inferred_relations) == (3, 4, 3)


@pytest.mark.parametrize("many", [3, 300])
def test_terms_by_gram_index(spark, many):
    """Few and many terms take one path: every length, repeated letters, characters of all sizes, long texts, nulls."""
    random.seed(many)
    letters = "ab漢é🎉 "
    texts = [(i, "".join(random.choices(letters, k=random.randint(0, 60)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "ab" * 900 + "漢字漢字漢字漢字漢字end" + "é" * 700), (102, "ab"), (103, "abab" * 5)]
    long = texts[82][1]
    terms = {"a", "漢", long[195:215], long[1790:1830], "never there", "zzz", "ab" * 8, "x" * 40, ""} if many == 3 else set()
    terms |= {"".join(random.choices(letters, k=random.randint(1, 6))) for _ in range(many)}
    terms |= {t[i:i + random.randint(1, 20)] for _, t in texts[:40] if t for i in [random.randrange(len(t))]}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, t string, gram string").repartition(3)
    asked = spark.createDataFrame([*((t,) for t in terms for _ in (0, 1)), (None,)], "term string")
    got = sorted((r.id, r.t, r.term) for r in Q.contained_terms(df, "t", asked).collect())
    assert got == sorted((i, t, x) for i, t in texts if t for x in terms if x and x in t)
    assert Q.contained_terms(df, "t", asked.where("false")).count() == 0
    assert Q.contained_terms(df.where("false"), "t", asked).count() == 0


def test_refused_documents_are_listed(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_text("x" * 100)
    (tmp_path / "c.pdf").write_text("no")
    got = {r.filename: (r.status, r.text) for r in X.read_documents(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a.md": ("ok", "hello"), "b.txt": ("size", None), "c.pdf": ("type", None)}
    assert {r.status for r in X.read_documents(spark, str(tmp_path)).collect()} == {"ok", "type"}


def batch(spark, key, rows, size=None):
    data = [(*[{"op_idx": i, **r}.get(n) for n in S.OPS.fieldNames()], key, size) for i, r in rows]
    import pyspark.sql.types as ty
    schema = ty.StructType([*S.OPS.fields, ty.StructField("batch_key", ty.StringType()), ty.StructField("batch_size", ty.LongType())])
    return spark.createDataFrame(data, schema).coalesce(1)


def add(name):
    return {"op": "add_entity", "name": name, "category": "抽象实体"}


def test_streamed_batches(spark, make, tmp_path):
    folder, store = str(tmp_path / "ops"), VersionStore(spark, str(tmp_path / "store"))
    run = lambda **kw: ST.stream_apply_ops(spark, folder, store, str(tmp_path / "cp"), {"availableNow": True}, **kw).awaitTermination()
    send = lambda *a: batch(spark, *a).write.mode("append").parquet(folder)
    # an empty store; a batch in two files; one without net effect
    send("k1", [(1, add("a"))], 2)
    run()
    assert store.history().count() == 0
    send("k1", [(2, add("b"))], 2)
    run(max_files=1)
    assert names(store.current().entities) == {"a", "b"}
    send("nil", [(1, {**add("n"), "ref": "n"}), (2, {"op": "delete_entity", "id": 3})], 2)
    run()
    assert names(store.current().entities) == {"a", "b"} and store.titled("batch nil")
    assert [r.op_type for r in store.current().op_logs.orderBy("id").collect()] == ["ADD_ENTITY"] * 3 + ["DELETE_ENTITY"]
    # a restored version is what the next batch builds on
    send("k2", [(1, add("c"))], 1)
    run()
    assert names(store.current().entities) == {"a", "b", "c"}
    store.restore(store.current(), 1)
    send("k3", [(1, add("d"))], 1)
    run()
    assert names(store.current().entities) == {"a", "b", "d"}
    assert "RESTORE" in {r.op_type for r in store.current().op_logs.collect()}
    # delivered again, or with more than stated
    send("k3", [(1, add("d"))], 1)
    send("k2", [(2, add("e"))], 1)
    run()
    assert names(store.current().entities) == {"a", "b", "d"}
    assert {r.batch_key for r in spark.read.parquet(f"{store.root}/refused").collect()} == {"k2"}
    bound = {(r.version, r.id) for r in store.log_range_members(store.current().op_logs).collect()}
    spans = {(r.version, i) for r in store.history().collect() for i in range(r.log_from, r.log_to + 1)}
    assert bound == {(v, i) for v, i in spans if i in {r.id for r in store.current().op_logs.collect()}}


def test_queries_with_python_functions_run_from_any_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from graphloom.operators import search as Q
q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>")
v = spark.createDataFrame([(5, "t", [1.0, 0.1], None)], "entity_id long, text string, vector array<float>, updated_at timestamp")
print("rows", Q.semantic_search(q, v, 3).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-2000:]


def test_retained_times_at_any_spacing(spark):
    """Greedy choice by pointers against a plain loop: ties, gaps of many slices, exact distances, nulls, nothing at all."""
    from datetime import datetime, timedelta

    from graphloom.sources.versions import keep_spaced

    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    seconds = [0, 600, 600, 1200, 1799, 1800, 90_000] + [rng.randrange(200_000) for _ in range(300)] + [500_000 + i for i in range(700)]
    times = [start + timedelta(seconds=s) for s in seconds]
    rng.shuffle(times)
    want = []
    for t in sorted(times):
        if not want or t - want[-1] >= timedelta(seconds=600):
            want.append(t)
    df = spark.createDataFrame([(t, 1) for t in times] + [(None, 1)], "ts timestamp, slice int").repartition(3)
    assert sorted(r.ts for r in keep_spaced(df, "ts", 600).collect()) == want
    assert keep_spaced(df.where("ts is null"), "ts", 600).count() == 0


def test_running_values_survive_a_restart(spark, tmp_path):
    """Only moved rows are written, a new start goes on from the stored values, an empty stream gives no row."""
    folder, out, cp = (str(tmp_path / n) for n in ("logs", "out", "cp"))
    row = lambda i, op: (i, op, "{}", None, "手工")
    send = lambda rows: spark.createDataFrame(rows, S.OP_LOGS).coalesce(1).write.mode("append").parquet(folder)
    moved = lambda: ST.stream_op_counts(ST.watch_changes(spark, folder))
    keys = ["op_type", "source"]

    def run():
        ST.keep_moved(moved(), out, cp, {"availableNow": True}).awaitTermination()
        return {r.op_type: (r.n, r.last_id) for r in ST.latest(spark, out, moved(), keys).collect()}

    spark.createDataFrame([], S.OP_LOGS).write.parquet(folder)
    assert ST.latest(spark, out, moved(), keys).count() == 0
    send([row(1, "ADD_ENTITY"), row(2, "UNDO")])
    assert run() == {"ADD_ENTITY": (1, 1), "UNDO": (1, 2)}
    send([row(3, "UNDO")])
    assert run() == {"ADD_ENTITY": (1, 1), "UNDO": (2, 3)}
    assert spark.read.parquet(out).where("op_type = 'ADD_ENTITY'").count() == 1  # not written again
    assert run()["UNDO"] == (2, 3)
    seen = []
    ST.emit_changes(ST.watch_changes(spark, folder), lambda b, n, v: seen.append((n, v)), str(tmp_path / "cp2"), {"availableNow": True}).awaitTermination()
    assert seen == [(3, 3)]
