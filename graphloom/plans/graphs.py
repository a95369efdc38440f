"""Ego subgraphs, paths, inference."""

from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import infer as I
from graphloom.operators import traverse as T
from graphloom.plans.base_sql import ADJ, EDG, ENT, LOG, REL, VEC, sql
from graphloom.plans.basic import ids_of
from graphloom.plans.registry import ORACLES, query, store
from graphloom.sources.derived import KIND, NATION, REGION, SUPPLIER, table


def text(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), "-")


def _bfs_sql(seed: str, depth: int) -> str:
    """Unrolled breadth-first levels as (center, id, level)."""
    out = [f"l0 AS MATERIALIZED (SELECT id AS center, id, 0 AS level FROM ({seed}))"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT center, id FROM l{i}" for i in range(max(0, d - 2), d))
        out.append(
            f"l{d} AS MATERIALIZED (SELECT DISTINCT center, dst AS id, {d} AS level FROM l{d - 1} JOIN adj ON src = id "
            f"WHERE (center, dst) NOT IN ({seen}))")
    out.append("bfs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1)) + ")")
    return ",\n".join(out)


_REGIONS = "SELECT (1000000000 + r_regionkey)::BIGINT AS id FROM region"


def regions(spark, sf_dir):
    return ids_of(spark, sf_dir, "region", "r_regionkey", REGION)


@query
def ego_depth2(spark, sf_dir):
    nodes, _ = T.ego(store(spark, sf_dir), regions(spark, sf_dir), 2)
    return nodes.select("center", "id", "level", "name", "category")


ORACLES["ego_depth2"] = sql(ENT, REL, ADJ, _bfs_sql(_REGIONS, 2), body="""
SELECT center, id, level, name, category FROM bfs JOIN ent USING (id)""")


@query
def ego_all(spark, sf_dir):
    return T.ego_levels(store(spark, sf_dir), regions(spark, sf_dir))


ORACLES["ego_all"] = sql(ENT, REL, ADJ, _bfs_sql(_REGIONS, 7), body=" SELECT center, id, level FROM bfs")


@query
def ego_relations(spark, sf_dir):
    nations = ids_of(spark, sf_dir, "nation", "n_nationkey", NATION)
    _, rel = T.ego(store(spark, sf_dir), nations, 1)
    return rel.select("center", "id", "source_id", "target_id", "name")


ORACLES["ego_relations"] = sql(
    ENT, REL, ADJ, _bfs_sql("SELECT (2000000000 + n_nationkey)::BIGINT AS id FROM nation", 1), body="""
SELECT s.center, r.id, r.source_id, r.target_id, r.name FROM rel r JOIN bfs s ON s.id = r.source_id
JOIN bfs t ON t.id = r.target_id AND t.center = s.center""")


def supplier_region_pairs(spark, sf_dir):
    """Every supplier with the region of every nation other suppliers or customers sit in."""
    s = ids_of(spark, sf_dir, "supplier", "s_suppkey", SUPPLIER)
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + REGION * KIND).cast("long").alias("target_id")).distinct()
    keyed = s.select(F.col("id").alias("source_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return keyed.join(n, F.col("k") == F.col("target_id") - REGION * KIND).select("source_id", "target_id")


@query
def shortest_paths(spark, sf_dir):
    p = T.shortest_paths(store(spark, sf_dir), supplier_region_pairs(spark, sf_dir))
    return p.select("source_id", "target_id", "found", "hops", text("path").alias("path"), text("nodes").alias("nodes"))


# levels from the regions, then all shortest paths by falling level, smallest relation-id list wins
ORACLES["shortest_paths"] = sql(ENT, REL, ADJ, EDG, _bfs_sql(_REGIONS, 6), body=""",
walk AS (
  SELECT id AS source_id, center AS target_id, id AS node, level, level AS hops, []::BIGINT[] AS path, [id] AS nodes
  FROM bfs WHERE id // 1000000000 = 5
  UNION ALL
  SELECT w.source_id, w.target_id, e.dst, w.level - 1, w.hops, list_append(w.path, e.rel_id), list_append(w.nodes, e.dst)
  FROM walk w JOIN edg e ON e.src = w.node JOIN bfs b ON b.center = w.target_id AND b.id = e.dst AND b.level = w.level - 1
  WHERE w.level > 0),
best AS (SELECT source_id, target_id, any_value(hops) AS hops, min((path, nodes)) AS m FROM walk WHERE level = 0 GROUP BY ALL)
SELECT (5000000000 + s_suppkey)::BIGINT AS source_id, (1000000000 + r_regionkey)::BIGINT AS target_id, b.hops IS NOT NULL AS found,
  b.hops, array_to_string(m[1], '-') AS path, array_to_string(m[2], '-') AS nodes
FROM supplier, region LEFT JOIN best b ON b.source_id = 5000000000 + s_suppkey AND b.target_id = 1000000000 + r_regionkey""", recursive=True)


@query
def all_paths(spark, sf_dir):
    """From every region to its nations, up to four hops."""
    pairs = table(spark, sf_dir, "nation").select(
        (F.col("n_regionkey") + REGION * KIND).cast("long").alias("source_id"),
        (F.col("n_nationkey") + NATION * KIND).cast("long").alias("target_id"))
    p = T.all_paths(store(spark, sf_dir), pairs)
    return p.select("source_id", "target_id", "rank", "hops", text("path").alias("path"), text("nodes").alias("nodes"))


ORACLES["all_paths"] = sql(ENT, REL, EDG, body=""",
pairs AS (SELECT (1000000000 + n_regionkey)::BIGINT AS source_id, (2000000000 + n_nationkey)::BIGINT AS target_id FROM nation),
stop AS MATERIALIZED (SELECT src AS node, dst AS target_id, min(rel_id) AS stop FROM edg WHERE dst // 1000000000 = 2 GROUP BY ALL),
walk AS (
  SELECT source_id, target_id, source_id AS node, []::BIGINT[] AS path, [source_id] AS nodes FROM pairs
  UNION ALL
  SELECT w.source_id, w.target_id, e.dst, list_append(w.path, e.rel_id), list_append(w.nodes, e.dst)
  FROM walk w JOIN edg e ON e.src = w.node LEFT JOIN stop s ON s.node = w.node AND s.target_id = w.target_id
  WHERE len(w.path) < 4 AND w.node <> w.target_id AND NOT list_contains(w.nodes, e.dst)
    AND (s.stop IS NULL OR e.rel_id <= s.stop) AND (e.dst <> w.target_id OR e.rel_id = s.stop)
    AND (len(w.path) < 3 OR e.dst = w.target_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY len(path), path) AS rank FROM walk WHERE node = target_id)
SELECT source_id, target_id, rank::INTEGER AS rank, len(path)::INTEGER AS hops, array_to_string(path, '-') AS path,
  array_to_string(nodes, '-') AS nodes FROM ranked WHERE rank <= 5""", recursive=True)


def evidence_sets(spark, sf_dir):
    """Per supplier: the supplier, its nation, its region and the nation beside it."""
    g = store(spark, sf_dir)
    rel = g.relations.select("id", "source_id", "target_id", "name")
    own = rel.where("name = '位于'").where(F.floor(F.col("source_id") / KIND) == SUPPLIER)
    base = own.select(F.col("source_id").alias("set_id"), F.col("id").alias("r0"), F.col("source_id").alias("s"), F.col("target_id").alias("n"))
    up = rel.where("name = '位于'").select(F.col("source_id").alias("n"), F.col("id").alias("r1"), F.col("target_id").alias("g"))
    side = rel.where("name = '相邻'").select(F.col("source_id").alias("n"), F.col("id").alias("r2"), F.col("target_id").alias("m"))
    up2 = up.select(F.col("n").alias("m"), F.col("r1").alias("r3"), F.col("g").alias("g3"))
    row = base.join(up, "n").join(side, "n", "left").join(up2, "m", "left")
    item = lambda pos, c: F.struct(F.lit(pos).alias("pos"), F.col(c).alias("id"))
    members = row.select("set_id", F.explode(F.array(item(0, "s"), item(1, "n"), item(2, "g"), item(3, "m"))).alias("x"))
    members = members.select("set_id", "x.pos", "x.id").where("id IS NOT NULL").join(g.entities.select("id", "name"), "id")
    edge = lambda pos, r, s, t: F.struct(
        F.lit(pos).cast("long").alias("rpos"), F.col(r).alias("rel_id"), F.col(s).alias("source_id"), F.col(t).alias("target_id"))
    edges = row.select("set_id", F.explode(F.array(
        edge(0, "r0", "s", "n"), edge(1, "r1", "n", "g"), edge(2, "r2", "n", "m"), edge(3, "r3", "m", "g3"))).alias("x"))
    return members, edges.select("set_id", "x.*").where("rel_id IS NOT NULL")


@query
def evidence_paths(spark, sf_dir):
    members, edges = evidence_sets(spark, sf_dir)
    p = T.evidence_paths(members, edges)
    return p.select("set_id", "rank", "hops", text("path").alias("path"))


ORACLES["evidence_paths"] = sql(ENT, REL, body=""",
own AS (SELECT source_id AS s, id AS r0, target_id AS n FROM rel WHERE name = '位于' AND source_id // 1000000000 = 5),
full_ AS (SELECT s, r0, n, u.id AS r1, u.target_id AS g, d.id AS r2, d.target_id AS m, u2.id AS r3 FROM own
  JOIN rel u ON u.source_id = n AND u.name = '位于' LEFT JOIN rel d ON d.source_id = n AND d.name = '相邻'
  LEFT JOIN rel u2 ON u2.source_id = d.target_id AND u2.name = '位于'),
mem AS (SELECT s AS set_id, 0 AS pos, s AS id FROM full_ UNION ALL SELECT s, 1, n FROM full_ UNION ALL SELECT s, 2, g FROM full_
  UNION ALL SELECT s, 3, m FROM full_ WHERE m IS NOT NULL),
ed AS (SELECT s AS set_id, 0 AS rpos, r0 AS rel_id, s AS a, n AS b FROM full_ UNION ALL SELECT s, 1, r1, n, g FROM full_
  UNION ALL SELECT s, 2, r2, n, m FROM full_ WHERE m IS NOT NULL UNION ALL SELECT s, 3, r3, m, g FROM full_ WHERE m IS NOT NULL),
bi AS (SELECT set_id, rpos, rel_id, a AS src, b AS dst FROM ed UNION ALL SELECT set_id, rpos, rel_id, b, a FROM ed),
walk AS (SELECT set_id, pos, id AS node, []::BIGINT[] AS path, []::INTEGER[] AS steps, [id] AS nodes FROM mem
  UNION ALL SELECT w.set_id, w.pos, bi.dst, list_append(path, rel_id), list_append(steps, rpos), list_append(nodes, bi.dst)
  FROM walk w JOIN bi ON bi.set_id = w.set_id AND bi.src = w.node WHERE len(path) < 3 AND NOT list_contains(nodes, bi.dst)),
every AS (SELECT set_id, 0 AS late, -1 AS pos, 1 AS hops, [rpos] AS steps, [rel_id] AS path FROM ed
  UNION ALL SELECT set_id, 1, pos, len(path), steps, path FROM walk WHERE len(path) > 1),
uniq AS (SELECT set_id, min((late, pos, hops, steps, path)) AS m FROM every GROUP BY set_id, list_sort(path)),
ranked AS (SELECT set_id, m, row_number() OVER (PARTITION BY set_id ORDER BY m) AS rank FROM uniq)
SELECT set_id, rank::INTEGER AS rank, m[3]::INTEGER AS hops, array_to_string(m[5], '-') AS path FROM ranked WHERE rank <= 6""", recursive=True)


def inferred(df):
    return df.withColumn("via", text("via"))


@query
def infer_transitive(spark, sf_dir):
    return inferred(I.infer_transitive(store(spark, sf_dir)))


_TRANS = """tr AS (SELECT a.source_id, b.target_id, a.name, min((a.id, b.id, a.category)) AS m FROM rel a
  JOIN rel b ON b.source_id = a.target_id AND b.name = a.name
  WHERE a.name IN ('位于', '属于') AND a.source_id <> b.target_id GROUP BY ALL),
t AS (SELECT source_id, target_id, name, m[3] AS category, '传递性(' || name || ')' AS rule, m[1] || '-' || m[2] AS via
  FROM tr WHERE (source_id, target_id, name) NOT IN (SELECT source_id, target_id, name FROM rel))"""
_SYM = """s AS (SELECT target_id AS source_id, source_id AS target_id, name, category, '对称性(' || name || ')' AS rule, min(id)::VARCHAR AS via
  FROM rel WHERE name = '相邻' AND (target_id, source_id, name) NOT IN (SELECT source_id, target_id, name FROM rel) GROUP BY ALL)"""
_INV = """i AS (SELECT target_id AS source_id, source_id AS target_id, '创建者' AS name, category, '逆关系(创建 ↔ 创建者)' AS rule,
  min(id)::VARCHAR AS via FROM rel WHERE name = '创建' GROUP BY ALL)"""
# nation -> region is the longest chain of the derived graph, so two edges close it
ORACLES["infer_transitive"] = sql(ENT, REL, _TRANS, body=" SELECT * FROM t")


@query
def infer_symmetric(spark, sf_dir):
    return inferred(I.infer_symmetric(store(spark, sf_dir)))


ORACLES["infer_symmetric"] = sql(ENT, REL, _SYM, body=" SELECT * FROM s")


@query
def infer_inverse(spark, sf_dir):
    return inferred(I.infer_inverse(store(spark, sf_dir)))


ORACLES["infer_inverse"] = sql(ENT, REL, _INV, body=" SELECT * FROM i")


@query
def infer_all(spark, sf_dir):
    return inferred(I.infer_all(store(spark, sf_dir)))


_ALL = """x AS (SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM i),
named AS (SELECT x.*, a.name AS source, b.name AS target FROM x LEFT JOIN ent a ON a.id = source_id LEFT JOIN ent b ON b.id = target_id)"""
ORACLES["infer_all"] = sql(ENT, REL, _TRANS, _SYM, _INV, _ALL, body=" SELECT * FROM named")


@query
def infer_center(spark, sf_dir):
    """Inferred relations that touch a region."""
    return inferred(I.infer_all(store(spark, sf_dir), centers=regions(spark, sf_dir)))


ORACLES["infer_center"] = sql(ENT, REL, _TRANS, _SYM, _INV, _ALL, body="""
SELECT * FROM named WHERE source_id // 1000000000 = 1 OR target_id // 1000000000 = 1""")


@query
def inferred_entities(spark, sf_dir):
    return I.inferred_entities(I.infer_all(store(spark, sf_dir)))


ORACLES["inferred_entities"] = sql(ENT, REL, _TRANS, _SYM, _INV, _ALL, body="""
SELECT source_id AS id FROM x UNION SELECT target_id FROM x""")


@query
def graph_stats(spark, sf_dir):
    return A.graph_stats(store(spark, sf_dir))


ORACLES["graph_stats"] = sql(ENT, REL, LOG, VEC, _TRANS, _SYM, _INV, _ALL, body="""
SELECT (SELECT count(*) FROM ent)::BIGINT AS entities, (SELECT count(*) FROM rel)::BIGINT AS relations, (SELECT count(*) FROM log)::BIGINT AS logs,
  (SELECT max(id) FROM log) AS version, (SELECT count(*) FROM named)::BIGINT AS inferred_relations, (SELECT count(*) FROM vec)::BIGINT AS indexed_vectors""")
