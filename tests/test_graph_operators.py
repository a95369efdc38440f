import itertools
import math
import random
from collections import defaultdict

import pytest

from graphloom.operators import infer as I
from graphloom.operators import match as M
from graphloom.operators import recommend as R
from graphloom.operators import traverse as T


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def pairs(spark, values):
    return spark.createDataFrame(list(values), "source_id long, target_id long")


def test_ego_levels(spark, make):
    g = make("ABCD", [("B", "r", "A"), ("B", "r", "C"), ("D", "r", "C")])
    one = {(r.id, r.level) for r in T.ego_levels(g, ids(spark, 2), 1).collect()}
    assert one == {(2, 0), (1, 1), (3, 1)}
    nodes, rel = T.ego(g, ids(spark, 2))
    assert {(r.name, r.level) for r in nodes.collect()} == {("B", 0), ("A", 1), ("C", 1), ("D", 2)}
    assert rel.count() == 3
    assert [r.id for r in T.unknown_centers(g, ids(spark, 2, 99)).collect()] == [99]


def test_inference_rules(spark, make):
    g = make("ABC", [("A", "位于", "B"), ("B", "位于", "C"), ("A", "挚友", "B"), ("A", "师从", "C")])
    got = {(r.source, r.name, r.target): list(r.via) for r in I.infer_all(g).collect()}
    assert got == {("A", "位于", "C"): [1, 2], ("B", "挚友", "A"): [3], ("C", "学生为", "A"): [4]}
    ont = I.normalize_ontology({"transitive": [" a ", "", 3], "inverse": [["p"], ["p", " "], [" p ", "q"]]})
    assert ont.transitive == ("a",) and ont.inverse == (("p", "q"),) and ont.symmetric == ()


def test_shortest_path_cases(spark, make):
    g = make("ABCDX", [("B", "r", "A"), ("B", "r", "C"), ("D", "r", "C")])
    rows = {(r.source_id, r.target_id): r for r in T.shortest_paths(g, pairs(spark, [(4, 1), (1, 3), (1, 5), (2, 2)])).collect()}
    assert list(rows[4, 1].path) == [3, 2, 1] and rows[4, 1].hops == 3 and list(rows[4, 1].nodes) == [4, 3, 2, 1]
    assert rows[1, 3].hops == 2 and not rows[1, 5].found and rows[2, 2].hops == 0
    assert not T.shortest_paths(g, pairs(spark, [(4, 1)]), max_hops=2).first().found


def graph_of(rng, n, m):
    edges = []
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            edges.append((str(a), "位于", str(b)))
    return [str(i) for i in range(n)], edges


def adjacency(edges):
    adj = defaultdict(list)
    for i, (a, _, b) in enumerate(edges):
        a, b = int(a) + 1, int(b) + 1
        adj[a].append((i + 1, b))
        adj[b].append((i + 1, a))
    return adj


def bfs_path(adj, s, t, limit):
    prev, frontier = {s: None}, [s]
    for _ in range(limit):
        nxt = []
        for u in frontier:
            for rel, v in adj[u]:
                if v in prev:
                    continue
                prev[v] = (u, rel)
                if v == t:
                    out = []
                    while prev[v]:
                        v, rel = prev[v]
                        out.append(rel)
                    return out[::-1]
                nxt.append(v)
        frontier = nxt
    return None


def enumerate_paths(adj, s, t, hops, limit):
    out, frontier = [], [([s], [])]
    for _ in range(hops):
        if len(out) >= limit:
            break
        nxt = []
        for nodes, rels in frontier:
            for rel, v in adj[nodes[-1]]:
                if v in nodes:
                    continue
                if v == t:
                    out.append(rels + [rel])
                    break
                nxt.append((nodes + [v], rels + [rel]))
        frontier = nxt
    return sorted(out, key=len)[:limit]


@pytest.mark.parametrize("seed,hub", [(1, 10**6), (2, 3)])
def test_paths_match_a_plain_model(spark, make, seed, hub):
    rng = random.Random(seed)
    names, edges = graph_of(rng, 9, 16)
    g, adj = make(names, edges), adjacency(edges)
    want = list(itertools.permutations(range(1, 10), 2))
    short = {(r.source_id, r.target_id): r for r in T.shortest_paths(g, pairs(spark, want), 4, hub_rows=hub).collect()}
    for s, t in want:
        assert (list(short[s, t].path) if short[s, t].found else None) == bfs_path(adj, s, t, 4)
    some = want[:30]
    got = defaultdict(list)
    for r in T.all_paths(g, pairs(spark, some), 4, 5, hub_rows=hub).orderBy("rank").collect():
        got[r.source_id, r.target_id].append(list(r.path))
    for s, t in some:
        assert got[s, t] == enumerate_paths(adj, s, t, 4, 5), (s, t)


@pytest.mark.parametrize("seed,hub", [(3, 10**6), (4, 2)])
def test_shortest_paths_from_both_ends(spark, make, seed, hub):
    """Parallel links, several shortest ways and far ends: the smallest relation-id sequence, with fewer rows than one search."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    edges = [(names[i], "r", names[i + 1]) for i in range(11)]  # a line of its own
    edges += [(names[rng.randrange(12, 60)], "r", names[rng.randrange(12, 60)]) for _ in range(110)]
    rng.shuffle(edges)
    edges += edges[:15]
    g = make(names, edges)
    ids = {n: i + 1 for i, n in enumerate(names)}
    links = defaultdict(list)
    for i, (a, _, b) in enumerate(edges):
        if a != b:
            links[ids[a]].append((i + 1, ids[b]))
            links[ids[b]].append((i + 1, ids[a]))

    def best(s, t, limit):
        paths = {s: []}
        seen = {s}
        for _ in range(limit):
            new = {}
            for v, p in paths.items():
                for rel, w in links[v]:
                    if w not in seen and (w not in new or p + [rel] < new[w]):
                        new[w] = p + [rel]
            if t in new:
                return new[t]
            seen |= set(new)
            paths = new
        return None

    want = [(1, 12), (12, 1), (1, 30), (5, 5), (3, 9)] + [(rng.randrange(13, 61), rng.randrange(13, 61)) for _ in range(25)]
    got = {(r.source_id, r.target_id): r for r in T.shortest_paths(g, pairs(spark, want), 12, hub_rows=hub).collect()}
    for s, t in want:
        path = [] if s == t else best(s, t, 12)
        assert (list(got[s, t].path) if got[s, t].found else None) == path, (s, t)
        if path:
            at = s
            for rel, node in zip(path, list(got[s, t].nodes)[1:]):
                assert (rel, node) in links[at]
                at = node
            assert at == t and got[s, t].hops == len(path)
    from graphloom.graph import undirected_edges
    from graphloom.operators.frontier import build_adjacency, levels_from

    seen: list = []
    far = max(((s, t) for s, t in want if s > 12 and t > 12 and s != t), key=lambda p: len(best(*p, 12) or []))
    hops = len(best(*far, 12))
    T.shortest_paths(g, pairs(spark, [far]), 12, rows_seen=seen)
    one = levels_from(build_adjacency(undirected_edges(g.relations)), pairs(spark, [far]).selectExpr("target_id AS key", "target_id AS node"), ["key"], hops)
    assert hops >= 3 and sum(seen) < sum(lv.count() for lv in one[1:])


@pytest.mark.parametrize("nodes, links", [(10, 14), (14, 60), (24, 30)])
def test_transitive_closure_matches_a_plain_model(spark, make, nodes, links):
    rng = random.Random(5)
    names, edges = graph_of(rng, nodes, links)
    g = make(names, edges)
    out = defaultdict(list)
    for i, (a, _, b) in enumerate(edges):
        out[int(a) + 1].append((i + 1, int(b) + 1))
    want, explicit = {}, {(int(a) + 1, int(b) + 1) for a, _, b in edges}
    for s in list(out):
        reached, queue = {}, [(b, [r]) for r, b in out[s]]
        while queue:
            v, path = queue.pop(0)
            if v in reached or v == s:
                continue
            reached[v] = path
            queue += [(b, path + [r]) for r, b in out[v] if b not in reached]
        want.update({(s, v): p for v, p in reached.items() if (s, v) not in explicit})
    for hub in (10**6, 2):
        got = {(r.source_id, r.target_id): list(r.via) for r in I.infer_transitive(g, hub_rows=hub).collect()}
        assert got == want


@pytest.mark.parametrize("waste", [4.0, 0.0])
def test_closure_rounds_and_chains(spark, make, monkeypatch, waste):
    """A long chain with a second, equally long way in it closes in few rounds; a bound of nothing goes step by step to the same result."""
    n = 100 if waste else 12
    reach, kept = I._reach, []
    monkeypatch.setattr(I, "WASTE", waste)
    monkeypatch.setattr(I, "_reach", lambda *a: kept.append(reach(*a)) or kept[-1])
    edges = [(str(i), "属于", str(i + 1)) for i in range(n)] + [("4", "属于", "x"), ("x", "属于", "6"), ("3", "属于", "3")]
    g = make([*map(str, range(n + 1)), "x"], edges)
    got = {(r.source_id, r.target_id): list(r.via) for r in I.infer_transitive(g).collect()}
    want = {(i + 1, j + 1): list(range(i + 1, j + 1)) for i in range(n) for j in range(i + 2, n + 1)}
    x, into, out = n + 2, n + 1, n + 2
    want |= {(i + 1, x): [*range(i + 1, 5), into] for i in range(4)} | {(x, j + 1): [out, *range(7, j + 1)] for j in range(7, n + 1)}
    assert got == want
    assert len(kept) <= 8 if waste else kept == [1] * n  # the last round finds nothing


def brute_pairs(names, edges, cap=300):
    nb = defaultdict(set)
    for a, _, b in edges:
        nb[int(a) + 1].add(int(b) + 1)
        nb[int(b) + 1].add(int(a) + 1)
    out = []
    for a, b in itertools.combinations(sorted(nb), 2):
        common = nb[a] & nb[b]
        if b in nb[a] or not common or min(len(nb[a]), len(nb[b])) > cap:
            continue
        out.append((round(sum(1 / math.log(len(nb[c]) + 1) for c in common), 4), len(common), a, b))
    return nb, sorted(out, key=lambda x: (-x[0], -x[1], x[2], x[3]))


@pytest.mark.parametrize("light", [256, 2])
def test_recommend_is_exact_with_long_middles(spark, make, light):
    rng = random.Random(9)
    names = [str(i) for i in range(40)]
    edges = [(str(rng.randrange(3)), "r", str(rng.randrange(3, 40))) for _ in range(60)]
    edges += [(str(rng.randrange(3, 40)), "r", str(rng.randrange(3, 40))) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[2]]
    _, want = brute_pairs(names, edges)
    for minimum in (1, 2):
        rows = R.recommend(make(names, edges), min_common=minimum, limit=15, light_members=light).orderBy("rank").collect()
        got = [(r.source_id, r.target_id, r.common_count) for r in rows]
        assert got == [(a, b, n) for s, n, a, b in want if n >= minimum][:15]


def test_recommend_star_of_twins(spark, make):
    """Every leaf shares both hubs: the answer is the pairs of smallest ids."""
    names = ["h1", "h2"] + [f"l{i}" for i in range(60)]
    edges = [(h, "r", f"l{i}") for h in ("h1", "h2") for i in range(60)]
    rows = R.recommend(make(names, edges), limit=5, light_members=8).orderBy("rank").collect()
    assert [(r.source_id, r.target_id) for r in rows] == [(1, 2), (3, 4), (3, 5), (3, 6), (3, 7)]


def test_recommend_center_and_names(spark, make):
    g = make("ABCDE", [("A", "r", "B"), ("B", "r", "C"), ("C", "r", "D"), ("B", "r", "D"), ("A", "r", "E"), ("E", "r", "C")])
    top = R.recommend(g, min_common=2).orderBy("rank").collect()
    assert {(r.source_name, r.target_name) for r in top} == {("A", "C"), ("B", "E")}
    assert set(top[0].common_names) in ({"B", "E"}, {"A", "C"})
    rows = R.recommend_for(g, ids(spark, 4)).collect()
    assert {(r.source_name, r.target_name) for r in rows} == {("A", "D"), ("D", "E")}


@pytest.mark.parametrize("light", [256, 2])
def test_similar_by_structure_matches_brute_force(spark, make, light):
    rng = random.Random(3)
    names, edges = graph_of(rng, 25, 60)
    nb, _ = brute_pairs(names, edges)
    g = make(names, edges)
    rows = R.similar_by_structure(g, g.entities.select("id"), k=4, light_members=light).orderBy("target", "rank").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.target].append((r.id, r.score))
    for t in nb:
        want = sorted(((-len(nb[t] & nb[o]) / len(nb[t] | nb[o]), o) for o in nb if o != t and (nb[t] & nb[o] or o in nb[t])))[:4]
        assert got[t] == [(o, round(-s, 4)) for s, o in want]


def test_co_neighbors_and_bridges(spark, make):
    g = make(["hub", "甲", "乙", "丙", "丁", "戊"], [("甲", "r", "hub"), ("乙", "r", "hub"), ("丙", "r", "丁"), ("丙", "r", "戊"), ("丁", "r", "戊")])
    sets = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 5), (2, 1, 6)], "set_id long, pos long, id long")
    got = {(r.set_id, r.a, r.b, r.shared_count) for r in R.co_neighbors(g, sets, light_members=1).collect()}
    assert got == {(1, 2, 3, 1), (2, 5, 6, 1)}
    assert {(r.set_id, r.name) for r in R.bridges(g, sets).collect()} == {(1, "hub"), (2, "丙")}


def test_edge_pattern_rules(spark, make):
    g = make(["Ab", "b"], [("Ab", "R", "b")])
    assert M.match_edges(g, ["r"], [("source", "name", "contains", "A")]).count() == 1
    assert M.match_edges(g, ["r"], [("source", "name", "~", "a")]).count() == 0
    assert M.match_edges_ci(g, "R", [("a", "name", "contains", "AB")]).count() == 1
    assert M.match_edges_ci(g, "R", [("a", "size", "=", "x")]).count() == 0
    with pytest.raises(ValueError):
        M.match_edges(g, [], [("source", "size", "=", "x")])
