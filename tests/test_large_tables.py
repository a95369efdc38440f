"""Forms that stay bounded on larger tables."""

import os
import random
import time

import numpy as np
from pyspark.sql import functions as F

from graphloom.graph import load_graph, make_graph, save_graph, undirected_edges
from graphloom.operators import match as M
from graphloom.operators import overlap as O
from graphloom.operators import recommend as R
from graphloom.operators import search as Q
from graphloom.operators.frontier import build_adjacency
from graphloom.plans import all_queries
from graphloom.session import materialize

SF = "/root/testdata/sf0.001"


def test_answer_prompts_alone_do_not_compute_the_rest(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("not asked for")

    for name in ("co_neighbors", "bridges"):
        monkeypatch.setattr(R, name, refuse)
    rows = all_queries()["customer_context"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count() and all("【关系】Customer" in r.prompt for r in rows)


def test_tables_of_many_rows_in_small_files_are_not_broadcast(spark, tmp_path):
    """400,000 entities of one name take some 3 MB of files, and far more as a broadcast table."""
    rows = spark.range(400_000).selectExpr("id", "'n' AS name", "'c' AS category", "'{}' AS attributes", "cast(null AS timestamp) AS created_at", "'s' AS source")
    save_graph(make_graph(spark, entities=rows), str(tmp_path / "g"))
    g = load_graph(spark, str(tmp_path / "g"))
    keys = g.entities.selectExpr("cast(id AS string) AS key")
    plan = M.key_candidates(g, keys, "http")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_buckets_of_an_adjacency_follow_its_edges(spark, make):
    g = make(["a", "b", "c"], [("a", "r", "b"), ("b", "q", "a"), ("a", "s", "c"), ("b", "t", "c")])
    adj = build_adjacency(undirected_edges(g.relations), 2, merge=True, bucket_rows=2)
    assert sorted(map(tuple, adj.rows.select("src", "dst", "rel_id").collect())) == [(1, 2, 1), (1, 3, 3), (2, 1, 1), (2, 3, 4), (3, 1, 3), (3, 2, 4)]
    ids = spark.createDataFrame([(1,), (3,)], "node long")
    assert sorted((r.node, r.dst) for r in adj.expand(ids).collect()) == [(1, 2), (1, 3), (3, 1), (3, 2)]
    assert "out of 4" in adj.rows.groupBy("src", "salt").count()._jdf.queryExecution().executedPlan().toString()  # 8 edges, 2 a bucket


def test_targets_meet_few_entities_of_equal_long_neighbors(spark, make, monkeypatch):
    """60 nodes of two hubs, some with neighbors of their own: every pair was spelled out, now the first of each kind stand for all."""
    leaves = [f"n{i}" for i in range(60)]
    edges = [(n, "r", f"h{i % 2}") for i, n in enumerate(leaves)] + [(n, "r", "h2") for n in leaves[::3]]
    edges += [(leaves[i], "r", f"own{i % 7}") for i in range(0, 60, 5)]
    g = make([*leaves, "h0", "h1", "h2", *[f"own{i}" for i in range(7)]], edges)
    name = {r.name: r.id for r in g.entities.collect()}
    nb = {i: set() for i in name.values()}
    for a, _, b in edges:
        nb[name[a]].add(name[b])
        nb[name[b]].add(name[a])
    written = {}
    keep = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, tag="t", **kw: written.setdefault(tag, keep(df, tag, **kw)))
    got = {}
    for r in R.similar_by_structure(g, g.entities.select("id"), k=3, light_members=4).collect():
        got.setdefault(r.target, []).append((r["rank"], r.id, r.score))
    for t in nb:
        want = sorted((-len(nb[t] & nb[o]) / len(nb[t] | nb[o]), o) for o in nb if o != t and (nb[t] & nb[o] or o in nb[t]))[:3]
        assert sorted(got.get(t, [])) == [(i + 1, o, round(-s, 4)) for i, (s, o) in enumerate(want)]
    assert written["stand"].count() < written["met_long"].count() / 2


def test_batches_of_long_texts_are_cut_by_bytes(spark):
    from graphloom.llm.common import map_batches
    from graphloom.session import BATCH_BYTES

    docs = spark.range(2000, numPartitions=1).select(F.expr("repeat('word and ', 2000)").alias("text"))
    sizes = map_batches(docs, lambda: lambda batches: ([[b.nbytes], [b.num_rows]] for b in batches), "bytes bigint, n bigint").collect()
    assert sum(r["n"] for r in sizes) == 2000
    assert max(r["bytes"] for r in sizes) <= 2 * BATCH_BYTES


def test_centers_walk_together(spark, make, monkeypatch):
    from graphloom import session
    from graphloom.operators import traverse

    rows, write = [], session.materialize

    def seen(df, tag="t", counted=False):
        out, n = write(df, tag, True)
        rows.append(n if tag == "level" else 0)
        return (out, n) if counted else out

    monkeypatch.setattr(session, "materialize", seen)  # frontier takes it from there
    monkeypatch.setattr(traverse, "materialize", seen)
    names = ["hub", *[f"leaf{i}" for i in range(100)]]
    g = make(names, [("hub", "r", n) for n in names[1:]])
    got = {(r.center, r.id): r.level for r in traverse.ego_levels(g, g.entities.select("id")).collect()}
    level = lambda a, b: 0 if a == b else 1 if 1 in (a, b) else 2
    assert got == {(a, b): level(a, b) for a in range(1, 102) for b in range(1, 102)}
    assert sum(rows) <= 2 * 3 * 101  # packs of centers, levels, nodes


def test_paths_do_not_search_far_from_targets_that_few_partial_paths_near(spark, make, monkeypatch):
    from graphloom.operators import frontier, traverse

    grown, grow = [], frontier.next_level

    def seen(*args):
        level, n = grow(*args)
        grown.append(n)
        return level, n

    monkeypatch.setattr(frontier, "next_level", seen)
    monkeypatch.setattr(traverse, "next_level", seen)
    edges = [("S", "r", "T"), ("S", "r", "N"), ("N", "r", "a"), ("a", "r", "p0"), ("c0", "r", "p0")]
    edges += [(f"c{i}", "in", "T") for i in range(5)] + [(f"c{i}", "r", f"p{i}.{k}") for i in range(5) for k in range(40)]
    names = sorted({n for a, _, b in edges for n in (a, b)})
    g = make(names, edges)
    at = {n: i + 1 for i, n in enumerate(names)}
    pair = spark.createDataFrame([(at["S"], at["T"])], "source_id long, target_id long")
    five = [[names[i - 1] for i in r.nodes] for r in traverse.all_paths(g, pair, 5).orderBy("rank").collect()]
    assert five == [["S", "T"]]  # behind the edge to the target no other edge of S counts
    back = spark.createDataFrame([(at["N"], at["T"])], "source_id long, target_id long")
    grown.clear()
    found = [[names[i - 1] for i in r.nodes] for r in traverse.all_paths(g, back, 5).orderBy("rank").collect()]
    assert found == [["N", "S", "T"], ["N", "a", "p0", "c0", "T"]]
    assert sum(grown) < 50  # the 200 ends of c0 to c4 are no use


def test_positions_move_rows_once(spark):
    from graphloom.session import with_position

    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("part"))
    out = with_position(rows, F.desc("part"), "k")
    got = [(r.part, r.k) for r in out.orderBy("pos").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 1000
    assert [r.pos for r in out.orderBy("pos").collect()] == list(range(1000))
    assert with_position(rows.limit(0), "k").count() == 0
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "row_number" not in plan  # the written rows are not dealt again to be numbered


def test_answers_are_read_once_whatever_filters_them(spark):
    from graphloom.operators import ingest as I

    texts = ['{"a":1}', 'x ```json {"a":[1,],} ``` y', "no object", "{bad", None, '{"a":1} {"b":2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parsed = I.parse_model_json(rows)
    assert [r.json for r in parsed.orderBy("doc_id").collect()] == ['{"a":1}', '{"a":[1]}', None, None, None, None]
    for test in ("json IS NOT NULL", "json IS NULL"):
        plan = parsed.where(test)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("rlike") <= 2  # one in the filter, one in the output


def _most_joined(df):
    """Rows of the largest join of a plan that has run."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        n = p.metrics().get("numOutputRows")
        if "Join" in name and n.isDefined():
            most = max(most, n.get().value())
    return most


def test_common_names_of_hubs_are_looked_up_from_the_other_end(spark, make):
    leaves, others = [f"l{i:03}" for i in range(400)], [f"o{i}" for i in range(5)]
    edges = [("h", "r", n) for n in leaves] + [(o, "r", leaves[10 * i + j]) for i, o in enumerate(others) for j in (1, 0)]
    g = make(["h", *leaves, *others], edges)
    out = R.recommend_for(g, g.entities.where("name = 'h'").select("id"))
    rows = out.collect()
    assert [(r.target_name, r.common_names) for r in sorted(rows, key=lambda r: r["rank"])] == [
        (o, [f"l{10 * i:03}", f"l{10 * i + 1:03}"]) for i, o in enumerate(others)]  # by the relations of the hub, not of the other end
    assert _most_joined(out) < 400


def test_only_rows_near_the_limit_are_ranked(spark, make, monkeypatch):
    written, keep = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, tag="t", **kw: written.setdefault(tag, keep(df, tag, **kw)))
    mids = [f"m{i}" for i in range(4)]
    edges = [("c", "r", m) for m in mids] + [(f"o{i:02}", "r", m) for i in range(40) for m in mids[: 1 + i % 4]]
    g = make(["c", *mids, *[f"o{i:02}" for i in range(40)]], edges)
    rows = R.recommend_for(g, g.entities.where("name = 'c'").select("id"), limit=12).orderBy("rank").collect()
    assert [r.target_name for r in rows] == [f"o{i:02}" for i in range(3, 40, 4)] + ["o02", "o06"]
    assert written["pairs"].count() == 40 and written["recs"].count() == 12
    low = written["low"].first()["low"]
    assert written["pairs"].where(F.floor(F.col("score") * 100) >= low).count() == 20


def test_pairs_of_short_features_are_added_up_in_their_task(spark, make, monkeypatch):
    import math
    import random
    from graphloom.operators import overlap

    def refuse(*args, **kwargs):
        raise AssertionError("pairs are shuffled to be added up")

    monkeypatch.setattr(overlap, "_scored", refuse)
    monkeypatch.setattr(overlap, "TASK_PAIRS", 50)
    monkeypatch.setattr(overlap, "FIRST_PART", 2)
    rnd = random.Random(5)
    names = [f"n{i}" for i in range(45)]
    edges = sorted({(a, "r", b) for a, b in (rnd.sample(names, 2) for _ in range(220))})
    g = make(names, edges)
    name = {r.name: r.id for r in g.entities.collect()}
    nb = {i: set() for i in name.values()}
    for a, _, b in edges:
        nb[name[a]].add(name[b])
        nb[name[b]].add(name[a])
    for hub in (None, 9):
        want = []
        for a in nb:
            for b in nb:
                common = nb[a] & nb[b]
                if a < b and b not in nb[a] and len(common) > 1 and (hub is None or min(len(nb[a]), len(nb[b])) <= hub):
                    want.append((-round(sum(1 / math.log(len(nb[m]) + 1) for m in common), 4), -len(common), a, b))
        want = sorted(want)[:20]
        got = R.recommend(g, limit=20, hub_degree=hub).orderBy("rank").collect()
        assert [(-r.score, -r.common_count, r.source_id, r.target_id) for r in got] == want


def test_pairs_of_one_group_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Long features, too, are added up where the starts of a block meet each member list once; blocks, steps and pieces of lists cut small."""
    rng = random.Random(4)
    has = {n: {rng.choice((rng.randrange(3), rng.randrange(3, 40))) for _ in range(5)} for n in range(80)}
    weight = {f: 1 / (2 + f) for f in range(40)}
    big = {n: n % 9 == 0 for n in has}
    rows = [(0, n, f, weight[f], big[n]) for n, fs in has.items() for f in fs]
    feats = spark.createDataFrame(rows, "grp int, node long, feat long, w double, big boolean")
    direct = spark.createDataFrame([(0, 1, 2), (0, 3, 5)], "grp int, a long, b long")

    def refuse(*args, **kwargs):
        raise AssertionError("pairs are spelled out for a shuffle")

    monkeypatch.setattr(O, "_pairs", refuse)
    for name, value in (("BLOCK_PAIRS", 200), ("TASK_PAIRS", 50), ("SALT_ROWS", 7)):
        monkeypatch.setattr(O, name, value, raising=False)
    for light in (256, 8):
        got = O.top_pairs(feats, 12, 2, direct, light, one_group=True).orderBy("rank").collect()
        want = []
        for a in has:
            for b in has:
                both = has[a] & has[b]
                if a < b and not (big[a] and big[b]) and (a, b) not in ((1, 2), (3, 5)) and len(both) >= 2:
                    want.append((-round(sum(weight[f] for f in both), 4), -len(both), a, b))
        assert [(-r.score, -r.common_count, r.a, r.b) for r in got] == sorted(want)[:12]


def test_vectors_meet_large_query_packs_and_keep_the_smallest_ids_of_ties(spark, monkeypatch):
    """Vectors move once per query pack, several packs of them long, and copies of one vector give the smallest ids."""
    rng = random.Random(6)
    vectors = [(i, [1.0, 0.0, 0.5] if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    vectors += [(60, [0.0, 0.0, 0.0]), (61, [float("nan"), 1.0, 0.0]), (62, [1.0, 0.0]), (63, [1.0, 0.0, 0.5, 9.0])]
    v = spark.createDataFrame(vectors, "entity_id long, vector array<double>")
    q = v.where("entity_id < 60").selectExpr("entity_id AS qid", "vector")
    monkeypatch.setattr(Q, "PACK_ROWS", 16)
    monkeypatch.setattr(Q, "QUERY_ROWS", 40, raising=False)
    packs = []
    keep = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, tag="t", **kw: packs.append(keep(df, tag, **kw)) or packs[-1])
    got = {}
    for r in Q.vector_topk(q, v, 4, 0.1, skip_self=True).collect():
        got.setdefault(r.qid, []).append((-round(r.score, 6), r.id))
    assert packs[0].count() == 2  # 60 queries, 40 a pack

    def unit(x):
        x = np.array((x + [0.0] * 3)[:3])
        size = np.sqrt((x * x).sum())
        return x / size if size > 0 else x

    units = {i: unit(x) for i, x in vectors}
    for i, _ in vectors[:60]:
        want = sorted((-round(float(units[i] @ units[j]), 6), j) for j in units if j != i and units[i] @ units[j] > 0.1)[:4]
        assert sorted(got.get(i, [])) == want


def test_judge_prompts_keep_pairs_of_hubs(spark, make, monkeypatch):
    """Two nations with 301 common neighbors each are the best pair of one another; neither their size nor that of others drops them."""
    from graphloom.plans import search as P

    names = ["n1", "n2", *[f"c{i}" for i in range(301)], "x"]
    g = make(names, [(n, "r", f"c{i}") for n in ("n1", "n2") for i in range(301)] + [("x", "r", "c0")])
    monkeypatch.setattr(P, "store", lambda *a: g)
    monkeypatch.setattr(P, "ids_of", lambda *a: spark.createDataFrame([(1,), (2,)], "id long"))
    got = {(r["center"], r["rank"]): r["prompt"] for r in P.judge_prompt_texts(spark, "").collect()}
    assert got[1, 1].startswith("J\nA: n1（抽象实体）\nB: n2（抽象实体）\ncommon: c0、c1、c2、c3、c4、c5")
    assert got[2, 1] == got[1, 1] and got[1, 2].startswith("J\nA: n1（抽象实体）\nB: x（抽象实体）\ncommon: c0") and len(got) == 4


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _settled(read, most):
    """The value once it is at most ``most``, or after ten seconds: files go in the background."""
    for _ in range(50):
        if read() <= most:
            break
        time.sleep(0.2)
    return read()


def test_shuffles_of_written_tables_are_removed(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, own = _shuffle_files(spark), spark.conf.get(name, None)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert len(out.collect()) == 7 and spark.conf.get(name, None) == own
    assert _settled(lambda: _shuffle_files(spark), before) <= before


def test_pairs_are_added_up_in_rounds(spark, monkeypatch):
    """Member lists are dealt to a few ranges of starts at a time; what a step no longer needs is gone at the end."""
    rng = random.Random(9)
    has = {n: {rng.choice((rng.randrange(3), rng.randrange(3, 40))) for _ in range(5)} for n in range(80)}
    feats = spark.createDataFrame([(0, n, f, 1 / (2 + f), n % 9 == 0) for n, fs in has.items() for f in fs], "grp int, node long, feat long, w double, big boolean")
    for name, value in (("BLOCK_PAIRS", 200), ("ROUND_MEMBERS", 150), ("ROUND_TIMES", 0)):
        monkeypatch.setattr(O, name, value)
    written, rounds, write, cut = [], [], O.materialize, O._rounds
    monkeypatch.setattr(O, "materialize", lambda df, tag="t", **kw: written.append(write(df, tag, **kw)) or written[-1])
    monkeypatch.setattr(O, "_rounds", lambda *a: rounds.append(cut(*a)) or rounds[-1])
    want = []
    for a in has:
        for b in has:
            if a < b and not (a % 9 == 0 and b % 9 == 0) and len(has[a] & has[b]) >= 2:
                want.append((-round(sum(1 / (2 + f) for f in has[a] & has[b]), 4), -len(has[a] & has[b]), a, b))
    for light in (256, 8):
        got = O.top_pairs(feats, 12, 2, None, light, one_group=True).orderBy("rank").collect()
        assert [(-r.score, -r.common_count, r.a, r.b) for r in got] == sorted(want)[:12]
    assert max(map(len, rounds)) > 2 and all(a[1] < b[0] for r in rounds for a, b in zip(r, r[1:]))
    left = [t.scratch_path.rsplit("/", 1)[1].split("-")[0] for t in written if os.path.exists(t.scratch_path)]
    assert set(left) <= {"best", "block_pairs"}


def _neighbor_graph(make):
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(60)]
    edges = sorted({(n, "r", m) for n in names for m in [f"h{rng.randrange(4)}", *rng.sample(names, 2)] if m != n})
    g = make([*names, *[f"h{i}" for i in range(4)]], edges)
    name = {r.name: r.id for r in g.entities.collect()}
    nb = {i: set() for i in name.values()}
    for a, _, b in edges:
        nb[name[a]].add(name[b])
        nb[name[b]].add(name[a])
    best = lambda t, k: sorted((-len(nb[t] & nb[o]) / len(nb[t] | nb[o]), o) for o in nb if o != t and (nb[t] & nb[o] or o in nb[t]))[:k]
    return g, {t: [(i + 1, o, round(-s, 4)) for i, (s, o) in enumerate(best(t, 4))] for t in nb}


def _cut_small(monkeypatch):
    """Small blocks, rounds and steps; the tags of the tables that the operator writes."""
    from graphloom.operators import nearest

    for name, value in (("BLOCK_PAIRS", 150), ("TASK_PAIRS", 40), ("SALT_ROWS", 7), ("ROUND_MEMBERS", 60), ("ROUND_TIMES", 0)):
        monkeypatch.setattr(O, name, value)
    tags = []
    for module in (R, nearest):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag="t", keep=keep, **kw: tags.append(tag) or keep(df, tag, **kw))
    return tags


def test_candidates_by_structure_are_ranked_where_they_are_counted(spark, make, monkeypatch):
    g, want = _neighbor_graph(make)
    tags = _cut_small(monkeypatch)
    got = {}
    for r in R.similar_by_structure(g, g.entities.select("id"), k=4, light_members=6).collect():
        got.setdefault(r.target, []).append((r["rank"], r.id, r.score))
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v}
    assert not {"met", "near_top"} & set(tags) and sum(t.startswith("nearest") for t in tags) > 4


def test_similar_entities_do_not_spell_out_long_neighbors(spark, make, monkeypatch):
    g, want = _neighbor_graph(make)
    tags = _cut_small(monkeypatch)
    monkeypatch.setattr(R, "LIGHT_MEMBERS", 6)
    monkeypatch.setattr(R.similar_by_structure, "__defaults__", (4, 6, R.HUB_ROWS))
    got = {}
    for r in Q.similar_entities(g, g.entities.where("id % 3 = 0").select("id"), 4).collect():
        got.setdefault(r.target, []).append((r["rank"], r.id, r.score))
    assert {t: sorted(v) for t, v in got.items()} == {t: v for t, v in want.items() if v and t % 3 == 0}
    assert not {"met", "near_top"} & set(tags)
