"""Validation, batch changes, undo, versions, image rows."""

from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.graph import load_graph, make_graph, save_graph
from graphloom.operators import changes as C
from graphloom.operators import images as M
from graphloom.operators import undo as U
from graphloom.operators import undo_steps as US
from graphloom.operators import validate as V
from graphloom.plans.base_sql import ALI, ENT, LOG, REL, sql
from graphloom.plans.registry import ORACLES, query, store
from graphloom.session import new_path
from graphloom.sources import versions as VS
from graphloom.sources.derived import BRAND, CUSTOMER, KIND, NATION, PART, REGION, RKIND, SUPPLIER, table

joined = lambda c: F.array_join(c, "; ")


def entity_requests(spark, sf_dir):
    """Documents as entity rows: the whole text is the name."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    attrs = F.expr("CASE WHEN toxic = 1 THEN '{\"a\":{\"b\":1},\" \":2}' WHEN quality = 0 THEN '[1]' WHEN quality = 1 THEN '{\"n\":1}' ELSE 'no json' END")
    return d.select("doc_id", F.col("text").alias("name"), F.when(F.col("lang") == "en", "物理实体").otherwise(F.col("lang")).alias("category"), attrs.alias("attributes"))


@query
def validate_entities(spark, sf_dir):
    return V.validate_entities(entity_requests(spark, sf_dir)).select("doc_id", joined("errors").alias("errors"), F.length("value_name").cast("long").alias("len"))


ORACLES["validate_entities"] = """WITH d AS (SELECT doc_id, text, lang, toxic, quality FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT *, concat_ws('; ', 
  CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN '实体名称必须为非空字符串' END,
  CASE WHEN length(text) > 200 THEN '实体名称长度不得超过200字符' END,
  CASE WHEN lang <> 'en' THEN '实体大类必须为以下4类之一: 物理实体 / 抽象实体 / 数值实体 / 时间实体' END,
  CASE WHEN toxic = 1 THEN '属性"a"的值必须为字符串/数值/布尔/空值(扁平三元组结构)，禁止嵌套对象或数组' END,
  CASE WHEN toxic = 1 THEN '属性键" "必须为非空字符串' END,
  CASE WHEN (coalesce(toxic, 0) = 0 AND quality = 0) OR quality IS NULL THEN '属性(attributes)必须为JSON对象' END) AS er FROM d)
SELECT doc_id, er AS errors, CASE WHEN er = '' THEN length(trim(text, E' \\t\\n\\r'))::BIGINT END AS len FROM e"""


def relation_requests(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_orderkey") + CUSTOMER * KIND).alias("source_id"), F.when(F.col("l_linenumber") == 3, F.col("l_orderkey") + CUSTOMER * KIND).when(
            F.col("l_linenumber") == 4, 0).otherwise(F.col("l_partkey") + PART * KIND).alias("target_id"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "互动").otherwise("x").alias("category"),
        F.when(F.col("l_returnflag") == "A", "推测").when(F.col("l_returnflag") == "R", "").otherwise("y").alias("confidence"),
        F.lit("").alias("source_ref"))


@query
def validate_relations(spark, sf_dir):
    out = V.validate_relations(relation_requests(spark, sf_dir), store(spark, sf_dir).entities)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", joined("errors").alias("errors"))


ORACLES["validate_relations"] = """WITH r AS (SELECT *, 7000000000 + l_orderkey AS s,
  CASE l_linenumber WHEN 3 THEN 7000000000 + l_orderkey WHEN 4 THEN 0 ELSE 6000000000 + l_partkey END AS t,
  l_orderkey < (SELECT count(*) FROM customer) AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('; ', 
  CASE WHEN l_linenumber = 4 THEN '终点实体id必须为正整数' END,
  CASE WHEN l_linenumber <> 4 AND NOT ok THEN '起点实体id=' || s || ' 不存在' END,
  CASE WHEN l_linenumber = 3 AND NOT ok THEN '终点实体id=' || t || ' 不存在' END,
  CASE WHEN l_linenumber = 3 THEN '起点与终点不能为同一实体' END,
  CASE WHEN l_returnflag = 'N' THEN '关系名称必须为非空字符串' END,
  CASE WHEN l_linestatus <> 'O' THEN '关系大类必须为以下5类之一: 空间 / 互动 / 归属 / 时间 / 属性' END,
  CASE WHEN l_returnflag = 'N' THEN '置信度必须为以下3档之一: 确证 / 推测 / 存疑' END) AS errors FROM r"""


@query
def validate_entity_patches(spark, sf_dir):
    """A new name for every customer order key, with attributes for odd keys."""
    p = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + CUSTOMER * KIND).alias("id"), F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.repeat("o_orderpriority", 60)).alias("p_name"),
        F.when(F.col("o_orderstatus") == "O", "时间实体").alias("p_category"),
        F.when(F.col("o_orderkey") % 2 == 1, '{"k":1}').alias("p_attributes"))
    return V.validate_entity_patches(p, store(spark, sf_dir).entities).select("id", "category", joined("errors").alias("errors"))


ORACLES["validate_entity_patches"] = """WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS st, length(o_orderpriority) * 60 > 200 AS long,
   o_orderkey < (SELECT count(*) FROM customer) AS ok FROM orders)
SELECT 7000000000 + k AS id, CASE WHEN st = 'O' THEN '时间实体' WHEN ok THEN '物理实体' END AS category,
 CASE WHEN NOT ok THEN '实体id=' || (7000000000 + k) || ' 不存在' ELSE concat_ws('; ', 
  CASE WHEN st = 'F' THEN '实体名称必须为非空字符串' END,
  CASE WHEN st <> 'F' AND k % 2 = 1 AND long THEN '实体名称长度不得超过200字符' END) END AS errors FROM c"""


@query
def validate_relation_patches(spark, sf_dir):
    g = store(spark, sf_dir)
    n = F.lit(None).cast("string")
    p = g.relations.select("id", F.lit(None).cast("long").alias("p_source_id"), F.when(F.col("name") == "属于", F.col("source_id")).alias("p_target_id"),
                           F.when(F.col("name") == "创建", " ").alias("p_name"), n.alias("p_category"),
                           F.when(F.col("name") == "购买", "?").when(F.col("name") == "供应", "").alias("p_confidence"), n.alias("p_source_ref"))
    return V.validate_relation_patches(p, g.relations, g.entities).select("id", "name", "confidence", joined("errors").alias("errors"))


ORACLES["validate_relation_patches"] = sql(ENT, REL, body=""" SELECT id, name, CASE WHEN name = '供应' THEN '确证' ELSE confidence END AS confidence,
 CASE name WHEN '属于' THEN '起点与终点不能为同一实体' WHEN '创建' THEN '关系名称必须为非空字符串'
   WHEN '购买' THEN '置信度必须为: 确证 / 推测 / 存疑' ELSE '' END AS errors FROM rel""")


def batch(spark, sf_dir):
    """A mixed batch: patches, new entities with placeholders and aliases, relations by reference and by
    name, relation patches and deletions, and entity deletions with their cascades."""
    t = lambda n: table(spark, sf_dir, n)
    B = 10**10
    at = lambda block, key: (F.lit(block * B) + key.cast("long")).alias("op_idx")
    nk, sk = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    parts = [
        t("supplier").select(at(1, F.col("s_suppkey")), F.lit("update_entity").alias("op"), (F.col("s_suppkey") + SUPPLIER * KIND).alias("id"),
                             F.lit('{"acctbal":0}').alias("attributes")),
        t("supplier").select(at(2, F.col("s_suppkey")), F.lit("update_entity").alias("op"), (F.col("s_suppkey") + SUPPLIER * KIND).alias("id"),
                             F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name")),
        t("nation").select(at(3, nk), F.lit("add_entity").alias("op"), F.concat(F.lit("hq"), sk).alias("ref"), F.concat(F.lit(" HQ "), sk, F.lit(" ")).alias("name"),
                           F.lit("抽象实体").alias("category"), F.array(F.concat(F.lit("hq "), sk), F.col("n_name"), F.lit(" ")).alias("aliases")),
        t("nation").select(at(4, nk), F.lit("add_relation").alias("op"), F.concat(F.lit("hq"), sk).alias("source_key_ref"), F.col("n_name").alias("target_name"),
                           F.lit("位于").alias("name"), F.lit("空间").alias("category"), F.lit("推测").alias("confidence"), F.lit("note").alias("evidence_ref")),
        t("nation").select(at(5, nk), F.lit("add_relation").alias("op"), F.concat(F.lit("hq "), sk).alias("source_name"), (F.col("n_regionkey") + REGION * KIND).cast("long").alias("target_id"),
                           F.lit("属于").alias("name"), F.lit("归属").alias("category")),
        t("nation").select(at(6, nk), F.lit("update_relation").alias("op"), (F.lit(RKIND) + nk.cast("long") * KIND + F.col("n_regionkey")).alias("id"), F.lit("存疑").alias("confidence")),
        t("part").where("p_size = 1").select(at(7, F.col("p_partkey")), F.lit("delete_entity").alias("op"), (F.col("p_partkey") + PART * KIND).alias("id")),
        t("customer").select(at(8, F.col("c_custkey")), F.lit("delete_relation").alias("op"),
                             (F.lit(3 * RKIND) + F.col("c_custkey") * KIND + F.col("c_nationkey")).alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_HW = """hw AS (SELECT (SELECT max(id) FROM ent) AS e, (SELECT max(id) FROM rel) AS r),
nat AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation)"""
_GONE = "gone AS (SELECT 6000000000 + p_partkey AS id FROM part WHERE p_size = 1)"


_DONE: dict = {}


def _applied(spark, sf_dir):
    """The batch applied once per application; the new version of the graph is saved and read back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        r = C.apply_ops(store(spark, sf_dir), batch(spark, sf_dir))
        if r.error:
            raise RuntimeError(r.error)
        path = new_path(spark, "applied")
        save_graph(r.graph, path)
        _DONE[key] = replace(r, graph=load_graph(spark, path))
    return _DONE[key]


@query
def apply_ops_entities(spark, sf_dir):
    return _applied(spark, sf_dir).graph.entities.select("id", "name", "category", "attributes", "source")


ORACLES["apply_ops_entities"] = sql(ENT, REL, _HW, _GONE, body="""
SELECT id, CASE WHEN id // 1000000000 = 5 THEN 'S' || (id % 1000000000) ELSE name END AS name, category,
  CASE WHEN id // 1000000000 = 5 THEN '{"acctbal":0}' ELSE attributes END AS attributes, '手工' AS source FROM ent WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT hw.e + pos, 'HQ ' || n_nationkey, '抽象实体', '{}', 'OpenCode' FROM nat, hw""")


@query
def apply_ops_relations(spark, sf_dir):
    return _applied(spark, sf_dir).graph.relations.drop("created_at")


ORACLES["apply_ops_relations"] = sql(ENT, REL, _HW, _GONE, body="""
SELECT id, source_id, target_id, name, category, CASE WHEN id // 1000000000000000000 = 1 THEN '存疑' ELSE confidence END AS confidence, source_ref, source
FROM rel WHERE target_id NOT IN (SELECT id FROM gone) AND id // 1000000000000000000 <> 3
UNION ALL SELECT hw.r + pos, hw.e + pos, 2000000000 + n_nationkey, '位于', '空间', '推测', 'note', 'OpenCode' FROM nat, hw
UNION ALL SELECT hw.r + (SELECT count(*) FROM nation) + pos, hw.e + pos, 1000000000 + n_regionkey, '属于', '归属', '确证', '', 'OpenCode' FROM nat, hw""")


@query
def apply_ops_aliases(spark, sf_dir):
    return _applied(spark, sf_dir).graph.aliases.select("entity_id", "alias")


ORACLES["apply_ops_aliases"] = sql(ENT, REL, ALI, _HW, body="""
SELECT entity_id, alias FROM ali UNION ALL SELECT hw.e + pos, 'hq ' || n_nationkey FROM nat, hw""")


@query
def apply_ops_logs(spark, sf_dir):
    """New log rows per kind, with their cascade counts."""
    g = store(spark, sf_dir)
    r = _applied(spark, sf_dir)
    new = r.graph.op_logs.where("created_at > '2025-01-01'")
    snap = F.from_json("snapshot", "struct<cascaded_relations:bigint,reason:string>")
    return new.groupBy("op_type", "source").agg(
        F.count(F.lit(1)).alias("n"), (F.max("id") - F.min("id") + 1).alias("span"),
        F.coalesce(F.sum(snap["cascaded_relations"]), F.lit(0)).alias("cascaded"), F.count(snap["reason"]).alias("with_reason")).select(
        "op_type", "source", "n", "cascaded", "with_reason")


ORACLES["apply_ops_logs"] = sql(ENT, REL, _GONE, body=""",
c AS (SELECT count(*)::BIGINT AS n FROM rel WHERE target_id IN (SELECT id FROM gone))
SELECT * FROM (VALUES ('ADD_ENTITY', (SELECT count(*) FROM nation), 0, 0), ('ADD_ALIAS', (SELECT count(*) FROM nation), 0, 0),
  ('ADD_RELATION', 2 * (SELECT count(*) FROM nation), 0, 0), ('UPDATE_ENTITY', 2 * (SELECT count(*) FROM supplier), 0, 0),
  ('UPDATE_RELATION', (SELECT count(*) FROM nation), 0, 0), ('DELETE_ENTITY', (SELECT count(*) FROM gone), (SELECT n FROM c), 0),
  ('DELETE_RELATION', (SELECT count(*) FROM customer) + (SELECT n FROM c), 0, (SELECT n FROM c))) t(op_type, n, cascaded, with_reason),
  (SELECT 'OpenCode' AS source) WHERE n > 0""")


@query
def apply_ops_report(spark, sf_dir):
    return C.apply_report(_applied(spark, sf_dir).applied)


ORACLES["apply_ops_report"] = """SELECT (SELECT count(*) FROM nation)::BIGINT AS entities_added, 2 * (SELECT count(*) FROM nation)::BIGINT AS relations_added,
 (SELECT 2 * (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part WHERE p_size = 1) + (SELECT count(*) FROM customer))::BIGINT AS others"""


@query
def apply_ops_reject(spark, sf_dir):
    """The batch followed by relations to the deleted parts: refused as a whole."""
    bad = table(spark, sf_dir, "part").where("p_size = 1").select(
        (F.lit(9 * 10**10) + F.col("p_partkey")).alias("op_idx"), F.lit("add_relation").alias("op"), F.lit(REGION * KIND).alias("source_id"),
        (F.col("p_partkey") + PART * KIND).alias("target_id"), F.lit("x").alias("name"), F.lit("空间").alias("category"))
    g = store(spark, sf_dir)
    r = C.apply_ops(g, batch(spark, sf_dir).unionByName(bad, allowMissingColumns=True))
    return r.graph.entities.agg(F.count(F.lit(1)).alias("entities")).withColumn("error", F.lit(r.error))


ORACLES["apply_ops_reject"] = sql(ENT, body=""" SELECT (SELECT count(*) FROM ent)::BIGINT AS entities, '第' || (90000000000 + k) ||
 '条操作(add_relation)失败: RDF校验未通过: 终点实体id=' || (6000000000 + k) || ' 不存在' AS error FROM (SELECT min(p_partkey) AS k FROM part WHERE p_size = 1)""")


@query
def cascade_delete(spark, sf_dir):
    """Delete every brand: the relations to its parts fall with it."""
    g = store(spark, sf_dir)
    ids = table(spark, sf_dir, "part").select((F.substring_index("p_brand", "#", -1).cast("long") + BRAND * KIND).alias("id"))
    r = C.delete_entities(g, ids)
    return r.applied.select("id", "op", "cascaded_relations")


ORACLES["cascade_delete"] = """SELECT 4000000000 + split_part(p_brand, '#', 2)::BIGINT AS id, 'delete_entity' AS op, count(*)::BIGINT AS cascaded_relations
FROM part GROUP BY 1"""


@query
def reset_graph(spark, sf_dir):
    g = C.reset_graph(store(spark, sf_dir), confirm=True).graph
    one = lambda df, w: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n")
    return one(g.entities, "entities").unionAll(one(g.relations, "relations")).unionAll(one(g.aliases, "aliases")).unionAll(one(g.op_logs, "logs"))


ORACLES["reset_graph"] = sql(ENT, REL, body=""" SELECT 'entities' AS what, 0::BIGINT AS n UNION ALL SELECT 'relations', 0 UNION ALL SELECT 'aliases', 0
UNION ALL SELECT 'logs', ((SELECT count(*) FROM events) + (SELECT count(*) FROM ent) + (SELECT count(*) FROM rel))::BIGINT""")


def alias_requests(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own = (F.col("c_custkey") + CUSTOMER * KIND).alias("entity_id")
    rows = [
        both.select((F.col("c_custkey") + 1).alias("req_idx"), own, F.concat(F.lit(" seg "), "c_mktsegment").alias("alias")),
        both.select((F.col("c_custkey") + 10**9).alias("req_idx"), own, F.col("n_name").alias("alias")),
        both.select((F.col("c_custkey") + 2 * 10**9).alias("req_idx"), own, F.col("c_name").alias("alias")),
        both.select((F.col("c_custkey") + 3 * 10**9).alias("req_idx"), own, F.concat(F.lit("C#"), F.col("c_custkey").cast("string")).alias("alias")),
        table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 4 * 10**9).alias("req_idx"), (F.col("o_orderkey") + CUSTOMER * KIND).alias("entity_id"),
                                              F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("alias")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


@query
def add_aliases(spark, sf_dir):
    return C.add_aliases(store(spark, sf_dir), alias_requests(spark, sf_dir))


ORACLES["add_aliases"] = """WITH s AS (SELECT c_mktsegment AS m, min(c_custkey) AS k FROM customer GROUP BY 1)
SELECT c_custkey + 1 AS req_idx, 7000000000 + c_custkey AS entity_id, 'seg ' || m AS alias, CASE WHEN c_custkey = k THEN 201 ELSE 409 END AS status
  FROM customer JOIN s ON m = c_mktsegment
UNION ALL SELECT c_custkey + 1000000000, 7000000000 + c_custkey, n_name, 409 FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT c_custkey + 2000000000, 7000000000 + c_custkey, c_name, 400 FROM customer
UNION ALL SELECT c_custkey + 3000000000, 7000000000 + c_custkey, 'C#' || c_custkey, 200 FROM customer
UNION ALL SELECT o_orderkey + 4000000000, 7000000000 + o_orderkey, 'o' || o_orderkey, CASE WHEN o_orderkey < (SELECT count(*) FROM customer) THEN 201 ELSE 404 END FROM orders"""


@query
def commit_aliases(spark, sf_dir):
    g = store(spark, sf_dir)
    out = C.commit_aliases(g, C.add_aliases(g, alias_requests(spark, sf_dir)))
    return out.aliases.select("entity_id", "alias")


ORACLES["commit_aliases"] = sql(ALI, body=""", o AS (SELECT * FROM (""" + ORACLES["add_aliases"] + """) WHERE status = 201)
SELECT entity_id, alias FROM ali UNION ALL SELECT entity_id, alias FROM o""")


@query
def remove_aliases(spark, sf_dir):
    """Remove the alias with the id of every customer and supplier; suppliers have none."""
    g = store(spark, sf_dir)
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER * KIND).alias("id"))
    ids = ids.unionAll(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER * KIND).alias("id")))
    return C.remove_aliases(g, ids)[1]


ORACLES["remove_aliases"] = """SELECT 7000000000 + c_custkey AS id, 200 AS status FROM customer
UNION ALL SELECT 5000000000 + s_suppkey, 404 FROM supplier"""


@query
def add_entities_or_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    req = p.select((F.col("p_partkey") + 1).alias("req_idx"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat(F.lit("new "), "p_type")).alias("name"),
                   F.lit("物理实体").alias("category"), F.lit("{}").alias("attributes"),
                   F.when(F.col("p_size") > 40, F.lit(REGION * KIND)).alias("merge_into"), (F.col("p_size") < 5).alias("force"))
    return C.add_entities_or_merge(store(spark, sf_dir), req).select("req_idx", "name", "action")


ORACLES["add_entities_or_merge"] = """WITH r AS (SELECT p_partkey + 1 AS req_idx, p_size, CASE WHEN p_size > 25 THEN p_name ELSE 'new ' || p_type END AS name FROM part),
f AS (SELECT *, min(req_idx) OVER (PARTITION BY name) AS first, name IN (SELECT p_name FROM part) AS taken FROM r)
SELECT req_idx, name, CASE WHEN NOT taken AND req_idx = first THEN 'insert' WHEN p_size > 40 THEN 'merge' WHEN p_size < 5 THEN 'insert' ELSE 'conflict' END AS action FROM f"""


@query
def undo_candidate(spark, sf_dir):
    return U.undo_candidate(store(spark, sf_dir).op_logs, 100).select("id", "op_type", "snapshot")


ORACLES["undo_candidate"] = sql(LOG, body=""", n AS (SELECT * FROM log ORDER BY id DESC LIMIT 100)
SELECT id, op_type, snapshot FROM n WHERE op_type <> 'UNDO' AND id NOT IN (SELECT e::BIGINT FROM n WHERE op_type = 'UNDO') ORDER BY id DESC LIMIT 1""")


def event_history(spark, sf_dir):
    """The events as the history of a graph of users: the first event of a user adds them, a click renames, a purchase adds a relation to
    one region, a view an alias, a later signup deletes a relation, an error undoes the event before. Purchases and deleted
    relations of a value below 10 are exceptions: the former are gone, the latter exist again."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    e = e.join(first, "user_id").withColumn("op", F.expr(
        "CASE WHEN event_id = first THEN 'ADD_ENTITY' WHEN event_type = 'click' THEN 'UPDATE_ENTITY' WHEN event_type = 'purchase' THEN 'ADD_RELATION' "
        "WHEN event_type = 'view' THEN 'ADD_ALIAS' WHEN event_type = 'signup' THEN 'DELETE_RELATION' ELSE 'UNDO' END"))
    text, low = F.col("user_id").cast("string"), F.col("value") < 10
    user = lambda name: F.struct(F.col("user_id").alias("id"), name.alias("name"), F.lit("抽象实体").alias("category"), F.lit("{}").alias("attributes"), F.lit("手工").alias("source"))
    plain = F.concat(F.lit("user "), text)
    rel = F.struct(F.when(F.col("op") == "ADD_RELATION", F.col("event_id")).otherwise(F.col("event_id") + 10**9).alias("id"), F.col("user_id").alias("source_id"),
                   F.lit(REGION * KIND).alias("target_id"), F.lit("购买").alias("name"), F.lit("互动").alias("category"), F.lit("确证").alias("confidence"),
                   F.lit("").alias("source_ref"), F.lit("手工").alias("source"))
    alias = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("alias"))
    is_ = lambda *ops: F.col("op").isin(*ops)
    snap = F.to_json(F.struct(
        F.when(is_("ADD_ENTITY"), user(plain)).alias("entity"), F.when(is_("ADD_RELATION", "DELETE_RELATION"), rel).alias("relation"),
        F.when(is_("UPDATE_ENTITY"), user(F.concat(plain, F.lit(" before e"), F.col("event_id").cast("string")))).alias("before"),
        F.when(is_("ADD_ALIAS"), alias).alias("alias"), F.when(is_("UNDO"), F.col("event_id")).alias("undone_log")))
    logs = e.select((F.col("event_id") + 1).alias("id"), F.col("op").alias("op_type"), snap.alias("snapshot"), F.col("ts").cast("timestamp").alias("created_at"), F.lit("手工").alias("source"))
    when = F.lit(None).cast("timestamp").alias("created_at")
    root = spark.range(1).select(F.lit(REGION * KIND).alias("id"), F.lit("root").alias("name"), F.lit("抽象实体").alias("category"), F.lit("{}").alias("attributes"), when, F.lit("手工").alias("source"))
    users = e.where(is_("ADD_ENTITY")).select(user(plain).alias("u")).select("u.id", "u.name", "u.category", "u.attributes", when, "u.source")
    rels = e.where((is_("ADD_RELATION") & ~low) | (is_("DELETE_RELATION") & low)).select(rel.alias("r")).select(
        "r.id", "r.source_id", "r.target_id", "r.name", "r.category", "r.confidence", "r.source_ref", when, "r.source")
    als = e.where(is_("ADD_ALIAS")).select(alias.alias("a")).select("a.id", "a.entity_id", "a.alias", when)
    return make_graph(spark, entities=users.unionByName(root), relations=rels, aliases=als, op_logs=logs)


_UNDONE: dict = {}


def _all_undone(spark, sf_dir):
    """Every change of the event history undone, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _UNDONE:
        path = new_path(spark, "events")
        save_graph(event_history(spark, sf_dir), path)
        _UNDONE[key] = US.undo_many(load_graph(spark, path))
    return _UNDONE[key]


@query
def undo_all_steps(spark, sf_dir):
    """What became of every change of the event history, newest first."""
    return _all_undone(spark, sf_dir)[1]


@query
def undo_all_rows(spark, sf_dir):
    """The rows that are left when every change is undone."""
    g = _all_undone(spark, sf_dir)[0]
    row = lambda df, what, name: df.select(F.lit(what).alias("what"), "id", F.col(name).alias("name"))
    return row(g.entities, "entity", "name").union(row(g.relations, "relation", "name")).union(row(g.aliases, "alias", "alias"))


_HISTORY = """WITH e AS (SELECT event_id AS e, user_id AS u, value < 10 AS low, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'ADD_ENTITY'
    WHEN event_type = 'click' THEN 'UPDATE_ENTITY' WHEN event_type = 'purchase' THEN 'ADD_RELATION' WHEN event_type = 'view' THEN 'ADD_ALIAS'
    WHEN event_type = 'signup' THEN 'DELETE_RELATION' ELSE 'UNDO' END AS op FROM events),
c AS (SELECT *, row_number() OVER (ORDER BY e DESC) AS step FROM e WHERE op <> 'UNDO' AND e + 1 NOT IN (SELECT e FROM e WHERE op = 'UNDO')),
r AS (SELECT e AS id, u FROM e WHERE op = 'ADD_RELATION' AND NOT low AND e NOT IN (SELECT e FROM c)
  UNION ALL SELECT e + 1000000000, u FROM e WHERE op = 'DELETE_RELATION' AND (low OR e IN (SELECT e FROM c))),
gone AS (SELECT u FROM c WHERE op = 'ADD_ENTITY')"""

ORACLES["undo_all_steps"] = _HISTORY + """, n AS (SELECT u, count(*) AS n FROM r GROUP BY 1)
SELECT step, (e + 1)::BIGINT AS log_id, op AS op_type, (CASE op WHEN 'ADD_RELATION' THEN e WHEN 'ADD_ALIAS' THEN e WHEN 'DELETE_RELATION' THEN e + 1000000000 ELSE u END)::BIGINT AS id,
 CASE WHEN op = 'ADD_RELATION' AND low THEN 'gone' WHEN op = 'DELETE_RELATION' AND low THEN 'back' ELSE 'undone' END AS outcome,
 (CASE WHEN op = 'ADD_ENTITY' THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS n_relations FROM c LEFT JOIN n USING (u)"""

ORACLES["undo_all_rows"] = _HISTORY + """, b AS (SELECT u, min(e) AS e FROM c WHERE op = 'UPDATE_ENTITY' GROUP BY 1)
SELECT 'entity' AS what, u::BIGINT AS id, 'user ' || u || coalesce(' before e' || b.e, '') AS name FROM (SELECT DISTINCT u FROM e WHERE u NOT IN (FROM gone)) LEFT JOIN b USING (u)
UNION ALL SELECT 'entity', 1000000000, 'root'
UNION ALL SELECT 'relation', id::BIGINT, '购买' FROM r WHERE u NOT IN (FROM gone)
UNION ALL SELECT 'alias', e::BIGINT, 'u' || e FROM e WHERE op = 'ADD_ALIAS' AND e NOT IN (SELECT e FROM c) AND u NOT IN (FROM gone)"""


@query
def version_history(spark, sf_dir):
    """Two savepoints around a batch, one that finds no change, and a restore."""
    g = store(spark, sf_dir)
    vs = VS.VersionStore(spark, new_path(spark, "versions"))
    vs.savepoint(g, "first", "手工")
    vs.savepoint(g, "same", "手工")
    after = _applied(spark, sf_dir).graph
    vs.savepoint(after, "second", "手工")
    back, _ = vs.restore(after, 1)
    n = back.op_logs.agg(F.max("id").alias("restored_log")).withColumn("one", F.lit(1))
    return vs.history().withColumn("one", F.lit(1)).join(n, "one").select("version", "title", "source", "log_from", "restored_log")


ORACLES["version_history"] = """SELECT version::BIGINT AS version, title, '手工' AS source, log_from::BIGINT AS log_from, (SELECT count(*) + 1 FROM events)::BIGINT AS restored_log
FROM (VALUES (1, 'first', 1), (2, 'second', (SELECT count(*) + 1 FROM events))) t(version, title, log_from)"""


@query
def version_diff(spark, sf_dir):
    """Entity rows that differ before and after the batch."""
    g = store(spark, sf_dir)
    cols = ["id", "name", "category", "attributes"]
    return VS.diff_tables(g.entities.select(*cols), _applied(spark, sf_dir).graph.entities.select(*cols))


ORACLES["version_diff"] = sql(ENT, REL, _HW, _GONE, body=""",
s AS (SELECT * FROM ent WHERE id // 1000000000 = 5)
SELECT *, -1::BIGINT AS change FROM ent WHERE id IN (SELECT id FROM gone)
UNION ALL SELECT *, -1 FROM s
UNION ALL SELECT id, 'S' || (id % 1000000000), category, '{"acctbal":0}', 1 FROM s
UNION ALL SELECT hw.e + pos, 'HQ ' || n_nationkey, '抽象实体', '{}', 1 FROM nat, hw""")


@query
def version_log_members(spark, sf_dir):
    """The log saved half way and at its end: the savepoint each log row is bound to."""
    logs = store(spark, sf_dir).op_logs
    half = logs.agg(F.floor(F.max("id") / 2)).first()[0]
    vs = VS.VersionStore(spark, new_path(spark, "versions"))
    vs.savepoint(make_graph(spark, op_logs=logs.where(F.col("id") <= half)), "half", always=True)
    vs.savepoint(make_graph(spark, op_logs=logs), "all", always=True)
    return vs.log_range_members(logs)


ORACLES["version_log_members"] = """SELECT (CASE WHEN event_id + 1 <= (SELECT (max(event_id) + 1) // 2 FROM events) THEN 1 ELSE 2 END)::BIGINT AS version, (event_id + 1)::BIGINT AS id
FROM events"""


@query
def parse_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    msg = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.concat(
        F.col("event_type"), F.lit("｜来源:u"), F.col("user_id").cast("string"), F.lit("｜日志ID:"), F.col("event_id").cast("string"), F.lit("-"), (F.col("event_id") + 3).cast("string")))
    return VS.parse_history(e.select("event_id", msg.alias("message"))).drop("message")


ORACLES["parse_history"] = """SELECT event_id, event_type AS title, CASE WHEN event_type = 'click' THEN '' ELSE 'u' || user_id END AS source,
CASE WHEN event_type <> 'click' THEN event_id END AS log_from, CASE WHEN event_type <> 'click' THEN event_id + 3 END AS log_to FROM events"""


@query
def add_images(spark, sf_dir):
    g = store(spark, sf_dir)
    d = table(spark, sf_dir, "pages")
    req = d.select((F.col("page_id") + 1).alias("req_idx"), (F.col("page_id") + SUPPLIER * KIND).alias("entity_id"),
                   F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.concat(F.lit(" f"), F.col("page_id").cast("string"))).alias("filename"),
                   F.col("url").alias("stored_path"), F.lit("").alias("thumb_path"), F.col("html").alias("caption"))
    table_, status = M.add_images(g.entity_images, g.entities, req, top_id=10**6, filename_chars=200, caption_chars=300)
    return status.join(table_.where(F.col("id") > 10**6).select(
        (F.substring_index("filename", "f", -1).cast("long") + 1).alias("req_idx"), "filename", F.length("caption").cast("long").alias("len")), "req_idx", "left")


ORACLES["add_images"] = """SELECT page_id + 1 AS req_idx, CASE WHEN NOT ok THEN 404 WHEN page_id % 7 = 0 THEN 400 ELSE 201 END AS status,
 CASE WHEN ok AND page_id % 7 <> 0 THEN 'f' || page_id END AS filename,
 CASE WHEN ok AND page_id % 7 <> 0 THEN length(left(trim(html, E' \\t\\n\\r'), 300))::BIGINT END AS len
FROM (SELECT *, page_id < (SELECT count(*) FROM supplier) AS ok FROM pages)"""


@query
def missing_image_files(spark, sf_dir):
    """Image rows whose file is not among the pages with a query string."""
    listing = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("?"))).select(F.col("url").alias("path"))
    return M.prune_missing_images(store(spark, sf_dir).entity_images, listing)[1].select("id", "stored_path")


ORACLES["missing_image_files"] = """SELECT page_id AS id, url AS stored_path FROM pages
WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '?'))"""


def _images_asked(spark, sf_dir):
    """Images named by the labelled documents, whether they exist or not."""
    return M.delete_images(store(spark, sf_dir).entity_images, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id")))


@query
def delete_images_status(spark, sf_dir):
    return _images_asked(spark, sf_dir)[1]


ORACLES["delete_images_status"] = """SELECT DISTINCT doc_id::BIGINT AS id, CASE WHEN doc_id IN (SELECT page_id FROM pages) THEN 200 ELSE 404 END AS status FROM labels"""


@query
def delete_images_left(spark, sf_dir):
    return _images_asked(spark, sf_dir)[0].select("id", "entity_id", "filename", "stored_path")


ORACLES["delete_images_left"] = """SELECT page_id::BIGINT AS id, (5000000000 + page_id % 10)::BIGINT AS entity_id, 'p' || page_id || '.html' AS filename, url AS stored_path
FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)"""


@query
def source_errors(spark, sf_dir):
    """Orders whose state stands for a source that graph rows, or log rows, may not have."""
    source = F.when(F.col("o_orderstatus") == "F", "手工").when(F.col("o_orderstatus") == "O", "系统")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", source.alias("source"))
    return V.source_errors(rows).withColumn("rule", F.lit("graph")).union(V.source_errors(rows, True).withColumn("rule", F.lit("log")))


ORACLES["source_errors"] = """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '系统' END AS source, 'graph' AS rule FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, NULL, 'log' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"""


@query
def retained_times(spark, sf_dir):
    """Every event as a snapshot: those to keep, at least ten minutes apart."""
    kept = VS.keep_spaced(table(spark, sf_dir, "events").select("ts"), "ts", VS.GAP_SECONDS)
    return kept.select(F.unix_micros("ts").alias("kept_at"))


ORACLES["retained_times"] = """WITH RECURSIVE e AS (SELECT DISTINCT epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
chain AS (SELECT min(t) AS t FROM e UNION ALL SELECT min(e.t) FROM chain c JOIN e ON e.t >= c.t + 600000000 GROUP BY c.t)
SELECT t AS kept_at FROM chain WHERE t IS NOT NULL"""
