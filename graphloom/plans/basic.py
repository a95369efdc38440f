"""Edge patterns, key resolution, pages, counts, logs."""

from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import logs as L
from graphloom.operators import match as M
from graphloom.plans.base_sql import ALI, ENT, LOG, REL, sql
from graphloom.plans.registry import ORACLES, query, store
from graphloom.sources.derived import CUSTOMER, KIND, NATION, PART, REGION, SUPPLIER, table

_EDGE = """SELECT coalesce(a.name, '#' || r.source_id) AS source, r.name AS relation, r.category AS category,
  coalesce(b.name, '#' || r.target_id) AS target, r.source_id, r.target_id, r.id AS relation_id
FROM rel r LEFT JOIN ent a ON a.id = r.source_id LEFT JOIN ent b ON b.id = r.target_id """


def ids_of(spark, sf_dir, name, key, kind):
    return table(spark, sf_dir, name).select((F.lit(kind * KIND) + F.col(key)).cast("long").alias("id"))


@query
def match_edges_located(spark, sf_dir):
    g = store(spark, sf_dir)
    return M.match_edges(g, ["位于"], [("target", "name", "=", "ASIA")], limit=500)


ORACLES["match_edges_located"] = sql(ENT, REL, body=f" {_EDGE} WHERE r.name = '位于' AND b.name = 'ASIA' ORDER BY r.id LIMIT 500")


@query
def match_edges_contains(spark, sf_dir):
    g = store(spark, sf_dir)
    where = [("source", "name", "contains", "#00000001"), ("relation", "source", "=", "文档")]
    return M.match_edges(g, ["互动", "相邻"], where, limit=None)


ORACLES["match_edges_contains"] = sql(
    ENT, REL, body=f" {_EDGE} WHERE (r.category IN ('互动') OR r.name IN ('相邻')) AND contains(a.name, '#00000001') AND r.source = '文档'")


@query
def match_edges_first(spark, sf_dir):
    return M.match_edges(store(spark, sf_dir), ["供应", "购买"])


ORACLES["match_edges_first"] = sql(ENT, REL, body=f" {_EDGE} WHERE r.name IN ('供应', '购买') ORDER BY r.id LIMIT 100")


@query
def match_edges_count_capped(spark, sf_dir):
    g = store(spark, sf_dir)
    capped = M.match_edges_count(g, ["互动"], limit=500).select(F.lit("capped").alias("kind"), "count")
    return capped.unionAll(M.match_edges_count(g, ["互动"], limit=None).select(F.lit("all").alias("kind"), "count"))


ORACLES["match_edges_count_capped"] = sql(
    ENT, REL, body=""" SELECT 'capped' AS kind, least(count(*), 500)::BIGINT AS count FROM rel WHERE category = '互动'
UNION ALL SELECT 'all', count(*)::BIGINT FROM rel WHERE category = '互动'""")


@query
def match_edges_ci(spark, sf_dir):
    return M.match_edges_ci(store(spark, sf_dir), "购买", [("b", "name", "contains", "RED")], limit=None)


ORACLES["match_edges_ci"] = sql(ENT, REL, body=""" SELECT a.name AS source, r.name AS relation, r.category AS category, b.name AS target,
  r.source_id, r.target_id, r.id AS relation_id FROM rel r JOIN ent a ON a.id = r.source_id JOIN ent b ON b.id = r.target_id
  WHERE r.name = '购买' AND contains(lower(b.name), 'red')""")


def text_keys(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    s = lambda c: c.cast("string").alias("key")
    return (
        t("nation").select(s(F.col("n_name")))
        .unionAll(t("nation").select(s(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))))
        .unionAll(t("part").select(s(F.col("p_name"))))
        .unionAll(t("customer").select(s(F.col("c_custkey") + CUSTOMER * KIND)))
        .unionAll(t("orders").select(s(F.col("o_orderkey") + CUSTOMER * KIND)))
        .unionAll(t("region").select(F.concat(F.lit(" "), F.col("r_name"), F.lit(" ")).alias("key")))
        .unionAll(t("region").select(F.concat(F.lit("no "), F.col("r_name")).alias("key")))
        .unionAll(t("customer").select(F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("key")))
        .distinct()
    )


_KEYS = """keys AS (SELECT n_name AS key FROM nation UNION SELECT 'N' || n_nationkey FROM nation UNION SELECT p_name FROM part
 UNION SELECT (c_custkey + 7000000000)::VARCHAR FROM customer UNION SELECT (o_orderkey + 7000000000)::VARCHAR FROM orders
 UNION SELECT ' ' || r_name || ' ' FROM region UNION SELECT 'no ' || r_name FROM region UNION SELECT 'C#' || c_custkey FROM customer)"""


@query
def resolve_keys_http(spark, sf_dir):
    return M.resolve_keys(store(spark, sf_dir), text_keys(spark, sf_dir), "http")


@query
def resolve_keys_cli(spark, sf_dir):
    return M.resolve_keys(store(spark, sf_dir), text_keys(spark, sf_dir), "cli")


@query
def resolve_keys_tool(spark, sf_dir):
    return M.resolve_keys(store(spark, sf_dir), text_keys(spark, sf_dir), "tool")


def _resolve_sql(mode):
    k = "key" if mode == "tool" else "trim(key)"
    digits = f"regexp_full_match({k}, '[0-9]+')"
    text = f"NOT {digits}" if mode == "tool" else "true"
    alias = "" if mode == "http" else f"""
  UNION ALL SELECT key, 3 AS way, a.entity_id FROM keys JOIN ali a ON a.alias = {k} JOIN ent e ON e.id = a.entity_id WHERE {text}"""
    return sql(ENT, ALI, _KEYS, body=f""",
hits AS (SELECT key, 1 AS way, e.id FROM keys JOIN ent e ON {digits} AND e.id = try_cast({k} AS BIGINT)
  UNION ALL SELECT key, 2, e.id FROM keys JOIN ent e ON e.name = {k} WHERE {text}{alias}),
best AS (SELECT key, count(DISTINCT id) AS n, min(id) AS id FROM hits h
  WHERE way = (SELECT min(way) FROM hits x WHERE x.key = h.key) GROUP BY key)
SELECT key, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0)::BIGINT AS n_candidates FROM keys LEFT JOIN best USING (key)""")


for _m in ("http", "cli", "tool"):
    ORACLES[f"resolve_keys_{_m}"] = _resolve_sql(_m)


@query
def find_entities(spark, sf_dir):
    return M.find_entities(store(spark, sf_dir), text_keys(spark, sf_dir)).drop("via")


ORACLES["find_entities"] = sql(ENT, ALI, _KEYS, body=""",
hits AS (SELECT trim(key) AS key, 1 AS way, e.id FROM keys JOIN ent e ON e.name = trim(key)
  UNION ALL SELECT trim(key), 2, a.entity_id FROM keys JOIN ali a ON a.alias = trim(key) JOIN ent e ON e.id = a.entity_id),
best AS (SELECT key, count(*) AS n, min(id) AS id FROM hits h
  WHERE way = (SELECT min(way) FROM hits x WHERE x.key = h.key) GROUP BY key)
SELECT k.key, coalesce(n, 0) = 1 AS found, CASE WHEN n = 1 THEN id END AS id, coalesce(n, 0)::BIGINT AS n_candidates
FROM (SELECT DISTINCT trim(key) AS key FROM keys) k LEFT JOIN best USING (key)""")


@query
def key_candidates(spark, sf_dir):
    return M.key_candidates(store(spark, sf_dir), text_keys(spark, sf_dir), "cli")


ORACLES["key_candidates"] = sql(ENT, ALI, _KEYS, body=""",
hits AS (SELECT key, 1 AS rnk, 'id' AS way, e.id, e.name, e.category FROM keys JOIN ent e
    ON regexp_full_match(trim(key), '[0-9]+') AND e.id = try_cast(trim(key) AS BIGINT)
  UNION ALL SELECT key, 2, 'name', e.id, e.name, e.category FROM keys JOIN ent e ON e.name = trim(key)
  UNION ALL SELECT key, 3, 'alias', e.id, e.name, e.category FROM keys JOIN ali a ON a.alias = trim(key) JOIN ent e ON e.id = a.entity_id)
SELECT key, way, id, name, category FROM hits h WHERE rnk = (SELECT min(rnk) FROM hits x WHERE x.key = h.key)""")


@query
def name_conflicts(spark, sf_dir):
    return M.name_conflicts(store(spark, sf_dir), text_keys(spark, sf_dir))


ORACLES["name_conflicts"] = sql(ENT, ALI, _KEYS, body=""", k AS (SELECT DISTINCT trim(key) AS key FROM keys)
SELECT key, id, name, category, '主名' AS via FROM k JOIN ent ON name = key
UNION ALL SELECT key, e.id, e.name, e.category, '别名(' || alias || ')' FROM k JOIN ali ON alias = key JOIN ent e ON e.id = entity_id""")


@query
def alias_conflicts(spark, sf_dir):
    """Every supplier asks for the names of the nations, their aliases and its own name."""
    g = store(spark, sf_dir)
    sup = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + SUPPLIER * KIND).alias("entity_id"), "s_nationkey", "s_name")
    nat = table(spark, sf_dir, "nation")
    both = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    req = (
        both.select("entity_id", F.col("n_name").alias("alias"))
        .unionAll(both.select("entity_id", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias")))
        .unionAll(sup.select("entity_id", F.col("s_name").alias("alias")))
        .unionAll(sup.select("entity_id", F.concat(F.lit("free "), F.col("s_name")).alias("alias")))
    )
    return M.alias_conflicts(g, req)


ORACLES["alias_conflicts"] = sql(ENT, ALI, body=""",
req AS (SELECT 5000000000 + s_suppkey AS entity_id, n_name AS alias FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION SELECT 5000000000 + s_suppkey, 'N' || n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION SELECT 5000000000 + s_suppkey, s_name FROM supplier UNION SELECT 5000000000 + s_suppkey, 'free ' || s_name FROM supplier),
fst AS (SELECT name, min(id) AS id FROM ent GROUP BY name)
SELECT r.entity_id, r.alias, CASE WHEN f.id <> r.entity_id THEN f.id ELSE a.entity_id END AS conflict_id,
  CASE WHEN f.id <> r.entity_id THEN '主名' ELSE '别名(' || r.alias || ')' END AS via
FROM req r LEFT JOIN fst f ON f.name = r.alias LEFT JOIN ali a ON a.alias = r.alias
WHERE f.id <> r.entity_id OR a.entity_id <> r.entity_id""")


@query
def entity_details(spark, sf_dir):
    keys = ids_of(spark, sf_dir, "nation", "n_nationkey", NATION).unionAll(
        ids_of(spark, sf_dir, "customer", "c_custkey", CUSTOMER))
    d = A.entity_details(store(spark, sf_dir), keys)
    return d.select("id", "name", "category", "attributes", F.array_join("aliases", "|").alias("aliases"), "n_relations")


ORACLES["entity_details"] = sql(ENT, REL, ALI, body=""",
k AS (SELECT id FROM ent WHERE id // 1000000000 IN (2, 7)),
n AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id),
al AS (SELECT entity_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM ali GROUP BY entity_id)
SELECT e.id, e.name, e.category, e.attributes, coalesce(al.aliases, '') AS aliases, coalesce(n.n, 0)::BIGINT AS n_relations
FROM ent e JOIN k USING (id) LEFT JOIN n ON n.id = e.id LEFT JOIN al ON al.entity_id = e.id""")


@query
def incident_relations(spark, sf_dir):
    keys = ids_of(spark, sf_dir, "nation", "n_nationkey", NATION)
    return M.incident(store(spark, sf_dir).relations, keys).select("key", "id", "source_id", "target_id", "name")


ORACLES["incident_relations"] = sql(ENT, REL, body="""
SELECT source_id AS key, id, source_id, target_id, name FROM rel WHERE source_id // 1000000000 = 2
UNION ALL SELECT target_id, id, source_id, target_id, name FROM rel WHERE target_id // 1000000000 = 2""")


@query
def induced_subgraph(spark, sf_dir):
    """Relations among nations, regions and suppliers only."""
    ids = ids_of(spark, sf_dir, "nation", "n_nationkey", NATION).unionAll(
        ids_of(spark, sf_dir, "region", "r_regionkey", REGION)).unionAll(
        ids_of(spark, sf_dir, "supplier", "s_suppkey", SUPPLIER))
    return M.induced(store(spark, sf_dir).relations, ids).select("id", "source_id", "target_id", "name", "category")


ORACLES["induced_subgraph"] = sql(ENT, REL, body="""
SELECT id, source_id, target_id, name, category FROM rel WHERE source_id // 1000000000 IN (1, 2, 5) AND target_id // 1000000000 IN (1, 2, 5)""")


@query
def relations_by_confidence(spark, sf_dir):
    return M.by_confidence(store(spark, sf_dir).relations, "推测").select("id", "confidence", "source_ref")


ORACLES["relations_by_confidence"] = sql(ENT, REL, body=" SELECT id, confidence, source_ref FROM rel WHERE confidence = '推测'")


@query
def list_entities_page(spark, sf_dir):
    page = A.list_entities(store(spark, sf_dir), "物理实体", limit=40, offset=15)
    return page.select("id", "name", "category", F.array_join("aliases", "|").alias("aliases"), "total")


ORACLES["list_entities_page"] = sql(ENT, ALI, body="""
SELECT e.id, e.name, e.category, coalesce(alias, '') AS aliases, (SELECT count(*) FROM ent WHERE category = '物理实体')::BIGINT AS total
FROM (SELECT * FROM ent WHERE category = '物理实体' ORDER BY id LIMIT 40 OFFSET 15) e LEFT JOIN ali ON entity_id = e.id""")


@query
def graph_payload(spark, sf_dir):
    e, r, totals = A.graph_payload(store(spark, sf_dir))
    one = F.lit(1).alias("one")
    shown = e.select("id").unionAll(r.select("id")).groupBy(one).agg(F.count(F.lit(1)).alias("shown"), F.max("id").alias("last_id"))
    return totals.withColumn("one", F.lit(1)).join(shown, "one").drop("one")


ORACLES["graph_payload"] = sql(ENT, REL, body=""",
s AS (SELECT id FROM (SELECT id FROM ent ORDER BY id LIMIT 300) UNION ALL SELECT id FROM (SELECT id FROM rel ORDER BY id LIMIT 1000))
SELECT (SELECT count(*) FROM ent)::BIGINT AS total_entities, (SELECT count(*) FROM rel)::BIGINT AS total_relations,
 ((SELECT count(*) FROM ent) > 300 OR (SELECT count(*) FROM rel) > 1000) AS truncated, (SELECT count(*) FROM s)::BIGINT AS shown,
 (SELECT max(id) FROM s) AS last_id""")


@query
def graph_counts(spark, sf_dir):
    g = store(spark, sf_dir)
    one = F.lit(1).alias("one")
    return A.graph_counts(g).select("*", one).join(A.graph_version(g.op_logs).select("*", one), "one").drop("one")


ORACLES["graph_counts"] = sql(ENT, REL, LOG, body="""
SELECT (SELECT count(*) FROM ent)::BIGINT AS entities, (SELECT count(*) FROM rel)::BIGINT AS relations,
 (SELECT count(*) FROM log)::BIGINT AS logs, (SELECT max(id) FROM log) AS version""")


@query
def relation_name_freq(spark, sf_dir):
    return A.relation_name_freq(store(spark, sf_dir).relations)


ORACLES["relation_name_freq"] = sql(ENT, REL, body="""
SELECT name, count(*)::BIGINT AS count, min(id) AS first_id FROM rel GROUP BY name ORDER BY count DESC, first_id LIMIT 20""")


@query
def degrees(spark, sf_dir):
    return A.degrees(store(spark, sf_dir).relations)


ORACLES["degrees"] = sql(ENT, REL, body="""
SELECT id, count(*)::BIGINT AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id""")


@query
def neighbor_counts(spark, sf_dir):
    return A.neighbor_counts(store(spark, sf_dir).relations)


ORACLES["neighbor_counts"] = sql(ENT, REL, body="""
SELECT src AS id, count(DISTINCT dst)::BIGINT AS degree
FROM (SELECT source_id AS src, target_id AS dst FROM rel UNION ALL SELECT target_id, source_id FROM rel) GROUP BY src""")


@query
def category_counts(spark, sf_dir):
    return A.category_counts(store(spark, sf_dir))


ORACLES["category_counts"] = sql(ENT, REL, body="""
SELECT 'entity' AS kind, category, count(*)::BIGINT AS count FROM ent GROUP BY category
UNION ALL SELECT 'relation', category, count(*)::BIGINT FROM rel GROUP BY category""")


@query
def distinct_categories(spark, sf_dir):
    return A.distinct_categories(store(spark, sf_dir))


ORACLES["distinct_categories"] = sql(ENT, REL, body="""
SELECT 'entity' AS kind, category, min(id) AS first_id FROM ent GROUP BY category
UNION ALL SELECT 'relation', category, min(id) FROM rel GROUP BY category""")


@query
def alias_map(spark, sf_dir):
    return A.alias_map(store(spark, sf_dir).aliases).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


ORACLES["alias_map"] = sql(ALI, body=" SELECT entity_id, string_agg(alias, '|' ORDER BY alias) AS aliases FROM ali GROUP BY entity_id")


@query
def image_counts(spark, sf_dir):
    return A.image_counts(store(spark, sf_dir).entity_images)


ORACLES["image_counts"] = """SELECT (5000000000 + page_id % 10)::BIGINT AS entity_id, count(*)::BIGINT AS count
FROM pages GROUP BY 1"""


@query
def graph_digest(spark, sf_dir):
    return A.graph_digest(store(spark, sf_dir), 2048)


ORACLES["graph_digest"] = sql(ENT, REL, body=""",
deg AS (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id),
high AS (SELECT id, name, 1 AS part, row_number() OVER (ORDER BY d DESC, id) AS k FROM deg JOIN ent USING (id) WHERE d >= 2
  ORDER BY d DESC, id LIMIT 8),
pos AS (SELECT id, name, row_number() OVER (ORDER BY id) - 1 AS p, greatest(1, (SELECT count(*) FROM ent) // 8) AS step FROM ent),
spread AS (SELECT id, name, 2 AS part, p AS k FROM pos WHERE p % step = 0 AND p < 7 * step),
samp AS (SELECT id, any_value(name) AS name, min((part, k)) AS o FROM (SELECT * FROM high UNION ALL SELECT * FROM spread) GROUP BY id ORDER BY o LIMIT 15),
top AS (SELECT name, count(*) AS n, min(id) AS f FROM rel GROUP BY name ORDER BY n DESC, f LIMIT 20)
SELECT left('实体大类: ' || (SELECT string_agg(category, '/' ORDER BY f) FROM (SELECT category, min(id) AS f FROM ent GROUP BY category)) || chr(10) ||
 '关系大类: ' || (SELECT string_agg(category, '/' ORDER BY f) FROM (SELECT category, min(id) AS f FROM rel GROUP BY category)) || chr(10) ||
 '高频关系名: ' || (SELECT string_agg(name || '(' || n || ')', ', ' ORDER BY n DESC, f) FROM top) || chr(10) ||
 '样例实体: ' || (SELECT string_agg(name || '(id' || id || ')', ', ' ORDER BY o) FROM samp) || chr(10) ||
 '规模: 实体' || (SELECT count(*) FROM ent) || ' 关系' || (SELECT count(*) FROM rel), 2048) AS digest""")


@query
def list_op_logs(spark, sf_dir):
    return L.list_op_logs(store(spark, sf_dir).op_logs).select("id", "op_type", "snapshot", "source")


ORACLES["list_op_logs"] = sql(LOG, body=" SELECT id, op_type, snapshot, source FROM log ORDER BY id DESC LIMIT 200")


@query
def search_op_logs(spark, sf_dir):
    return L.search_op_logs(store(spark, sf_dir), "", "user 1").select("id", "op_type", "rendered")


ORACLES["search_op_logs"] = sql(ENT, LOG, body=""",
r AS (SELECT log.id, op_type, log.source, CASE op_type
  WHEN 'ADD_ENTITY' THEN '新增实体 「user ' || u || '」(抽象实体)，来源 手工'
  WHEN 'UPDATE_ENTITY' THEN '更新实体 「user ' || u || ' e' || e || '」(抽象实体)：name→' ||
     CASE WHEN length('user ' || u || ' e' || e) > 28 THEN left('user ' || u || ' e' || e, 28) || '…' ELSE 'user ' || u || ' e' || e END
  WHEN 'ADD_RELATION' THEN '新增关系 #' || u || ' —[购买]→ ' || coalesce('「' || ent.name || '」', '#1000000000') || '（互动）'
  ELSE CASE WHEN length(snapshot) > 160 THEN left(snapshot, 160) || '…' ELSE snapshot END END AS rendered
  FROM log LEFT JOIN ent ON ent.id = 1000000000)
SELECT id, op_type, rendered FROM r WHERE contains(lower(rendered || ' ' || source || ' ' || CASE op_type WHEN 'ADD_ENTITY' THEN '新增实体'
  WHEN 'UPDATE_ENTITY' THEN '更新实体' WHEN 'ADD_RELATION' THEN '新增关系' ELSE op_type END), 'user 1')""")


@query
def log_diff_fields(spark, sf_dir):
    return L.diff_fields(store(spark, sf_dir).op_logs)


ORACLES["log_diff_fields"] = sql(LOG, body=""" SELECT id, 'name' AS field, 'user ' || u AS before, 'user ' || u || ' e' || e AS after
FROM log WHERE op_type = 'UPDATE_ENTITY'""")


@query
def parts_of_supplier_names(spark, sf_dir):
    """J1: supply relations with both endpoint names."""
    g = store(spark, sf_dir)
    return M.with_endpoint_names(g.relations.where("name = '供应'"), g.entities).select(
        "id", F.col("a.name").alias("source_name"), F.col("b.name").alias("target_name"))


ORACLES["parts_of_supplier_names"] = sql(ENT, REL, body=""" SELECT r.id, a.name AS source_name, b.name AS target_name
FROM rel r LEFT JOIN ent a ON a.id = source_id LEFT JOIN ent b ON b.id = target_id WHERE r.name = '供应'""")


@query
def alias_owners(spark, sf_dir):
    return M.alias_owner(store(spark, sf_dir))


ORACLES["alias_owners"] = sql(ENT, ALI, body=" SELECT entity_id, alias, name, category FROM ali JOIN ent ON ent.id = entity_id")


def many_aliases(spark, sf_dir):
    """The store with two aliases for every customer and supplier, one of them shared by a customer and a supplier of one key."""
    named = lambda name, key, kind, own: table(spark, sf_dir, name).select(
        F.col(key).cast("long").alias("key"), (F.lit(kind * KIND) + F.col(key).cast("long")).alias("entity_id"), F.lit(own).alias("own"))
    both = named("customer", "c_custkey", CUSTOMER, "客户").unionByName(named("supplier", "s_suppkey", SUPPLIER, "供应商"))
    rows = both.select("entity_id", F.explode(F.array(F.concat("own", F.col("key").cast("string")), F.concat(F.lit("No."), F.col("key").cast("string")))).alias("alias"))
    rows = rows.select((F.col("entity_id") * 2 + F.col("alias").startswith("No.").cast("int")).alias("id"), "entity_id", "alias", F.current_timestamp().alias("created_at"))
    return replace(store(spark, sf_dir), aliases=rows)


_MANY = """own AS (SELECT c_custkey AS k, 7000000000 + c_custkey AS entity_id, '客户' AS own FROM customer
  UNION ALL SELECT s_suppkey, 5000000000 + s_suppkey, '供应商' FROM supplier),
many AS (SELECT entity_id::BIGINT AS entity_id, own || k::VARCHAR AS alias FROM own UNION ALL SELECT entity_id, 'No.' || k::VARCHAR FROM own)"""


@query
def alias_map_many(spark, sf_dir):
    return A.alias_map(many_aliases(spark, sf_dir).aliases).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


# in the order of the alias ids: the own name, then the shared one
ORACLES["alias_map_many"] = sql(_MANY, body=" SELECT entity_id, string_agg(alias, '|' ORDER BY starts_with(alias, 'No.')) AS aliases FROM many GROUP BY entity_id")


@query
def alias_owners_many(spark, sf_dir):
    return M.alias_owner(many_aliases(spark, sf_dir))


ORACLES["alias_owners_many"] = sql(ENT, _MANY, body=" SELECT m.entity_id, alias, name, category FROM many m JOIN ent ON ent.id = m.entity_id")


@query
def resolve_keys_many(spark, sf_dir):
    """Every alias of every customer as a key: its own leads to one entity, the shared one to one or two."""
    g = many_aliases(spark, sf_dir)
    keys = g.aliases.where(F.col("entity_id") >= CUSTOMER * KIND).select(F.col("alias").alias("key"))
    return M.resolve_keys(g, keys, "cli").select("key", "status", "id")


ORACLES["resolve_keys_many"] = sql(_MANY, body=""",
n AS (SELECT alias, count(DISTINCT entity_id) AS n, min(entity_id) AS id FROM many GROUP BY alias)
SELECT alias AS key, CASE WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS id
FROM n WHERE alias IN (SELECT alias FROM many WHERE entity_id >= 7000000000)""")
