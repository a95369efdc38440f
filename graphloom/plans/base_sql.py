"""SQL for the derived graph, shared by the oracle queries."""

ENT = """seg AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) AS seg_key
         FROM (SELECT DISTINCT c_mktsegment FROM customer)),
ent AS MATERIALIZED (
  SELECT (1000000000 + r_regionkey)::BIGINT AS id, r_name AS name, '物理实体' AS category, '{}' AS attributes FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, n_name, '物理实体', '{}' FROM nation
  UNION ALL SELECT 3000000000 + seg_key, c_mktsegment, '抽象实体', '{}' FROM seg
  UNION ALL SELECT DISTINCT 4000000000 + split_part(p_brand, '#', 2)::BIGINT, p_brand, '抽象实体', '{}' FROM part
  UNION ALL SELECT 5000000000 + s_suppkey, s_name, '物理实体', '{"acctbal":' || s_acctbal::VARCHAR || '}' FROM supplier
  UNION ALL SELECT 6000000000 + p_partkey, p_name, '物理实体', '{"type":"' || p_type || '","size":' || p_size::VARCHAR || '}' FROM part
  UNION ALL SELECT 7000000000 + c_custkey, c_name, '物理实体', '{"segment":"' || c_mktsegment || '"}' FROM customer
  UNION ALL SELECT DISTINCT 8000000000 + strftime(o_orderdate, '%Y%m')::BIGINT, strftime(o_orderdate, '%Y%m'), '时间实体', '{}' FROM orders
)"""

REL = """rel AS MATERIALIZED (
  SELECT (1000000000000000000 + n_nationkey::BIGINT * 1000000000 + n_regionkey)::BIGINT AS id,
         (2000000000 + n_nationkey)::BIGINT AS source_id, (1000000000 + n_regionkey)::BIGINT AS target_id,
         '位于' AS name, '空间' AS category, '确证' AS confidence, '' AS source_ref, '手工' AS source FROM nation
  UNION ALL SELECT 2000000000000000000 + s_suppkey * 1000000000 + s_nationkey, 5000000000 + s_suppkey, 2000000000 + s_nationkey,
         '位于', '空间', '确证', '', '手工' FROM supplier
  UNION ALL SELECT 3000000000000000000 + c_custkey * 1000000000 + c_nationkey, 7000000000 + c_custkey, 2000000000 + c_nationkey,
         '位于', '空间', '确证', '', '手工' FROM customer
  UNION ALL SELECT 4000000000000000000 + c_custkey * 1000000000 + seg_key, 7000000000 + c_custkey, 3000000000 + seg_key,
         '属于', '归属', '确证', '', '手工' FROM customer JOIN seg USING (c_mktsegment)
  UNION ALL SELECT 5000000000000000000 + split_part(p_brand, '#', 2)::BIGINT * 1000000000 + p_partkey,
         4000000000 + split_part(p_brand, '#', 2)::BIGINT, 6000000000 + p_partkey, '创建', '互动', '确证', '', '手工' FROM part
  UNION ALL SELECT 6000000000000000000 + l_suppkey * 1000000000 + l_partkey, 5000000000 + l_suppkey, 6000000000 + l_partkey, '供应', '互动',
         CASE min(l_returnflag) WHEN 'A' THEN '推测' WHEN 'N' THEN '确证' ELSE '存疑' END, 'order:' || min(l_orderkey)::VARCHAR, '文档'
         FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 7000000000000000000 + o_custkey * 1000000000 + l_partkey, 7000000000 + o_custkey, 6000000000 + l_partkey, '购买', '互动',
         CASE min(l_returnflag) WHEN 'A' THEN '推测' WHEN 'N' THEN '确证' ELSE '存疑' END, 'order:' || min(l_orderkey)::VARCHAR, '文档'
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT 8000000000000000000 + n_nationkey::BIGINT * 1000000000 + nxt, 2000000000 + n_nationkey, 2000000000 + nxt,
         '相邻', '空间', '确证', '', '手工'
         FROM (SELECT n_nationkey, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nxt FROM nation)
         WHERE nxt IS NOT NULL
)"""

ALI = """ali AS (
  SELECT (2000000000 + n_nationkey)::BIGINT AS entity_id, 'N' || n_nationkey::VARCHAR AS alias FROM nation
  UNION ALL SELECT 7000000000 + c_custkey, 'C#' || c_custkey::VARCHAR FROM customer
)"""

VEC = """vec AS (
  SELECT (6000000000 + vec_id)::BIGINT AS entity_id, embedding AS vector,
         CASE WHEN label % 2 = 0 THEN coalesce(p_name || '（物理实体） type:' || p_type || '；size:' || p_size::VARCHAR, '') ELSE 'old' END AS text
  FROM embeddings LEFT JOIN part ON vec_id = p_partkey
)"""

LOG = """log AS (
  SELECT (event_id + 1)::BIGINT AS id, op_type,
    CASE op_type
      WHEN 'ADD_ENTITY' THEN '{"entity":{"id":' || u || ',"name":"user ' || u || '","category":"抽象实体","source":"手工"}}'
      WHEN 'ADD_RELATION' THEN '{"relation":{"id":' || e || ',"source_id":' || u || ',"target_id":1000000000,"name":"购买","category":"互动"}}'
      WHEN 'UPDATE_ENTITY' THEN '{"before":{"id":' || u || ',"name":"user ' || u || '","category":"抽象实体","source":"手工"},"after":{"id":' || u || ',"name":"user ' || u || ' e' || e || '","category":"抽象实体","source":"手工"}}'
      WHEN 'ADD_ALIAS' THEN '{"alias":{"entity_id":' || u || ',"alias":"u' || e || '"}}'
      ELSE '{"undone_log":' || e || '}' END AS snapshot,
    CASE op_type WHEN 'UNDO' THEN '系统' ELSE '手工' END AS source, u, e, ts
  FROM (SELECT event_id, user_id::VARCHAR AS u, event_id::VARCHAR AS e, ts,
    CASE event_type WHEN 'signup' THEN 'ADD_ENTITY' WHEN 'purchase' THEN 'ADD_RELATION' WHEN 'click' THEN 'UPDATE_ENTITY'
         WHEN 'view' THEN 'ADD_ALIAS' ELSE 'UNDO' END AS op_type FROM events)
)"""

# undirected neighbor pairs, both directions
ADJ = """adj AS MATERIALIZED (SELECT DISTINCT source_id AS src, target_id AS dst FROM rel WHERE source_id <> target_id
  UNION SELECT target_id, source_id FROM rel WHERE source_id <> target_id)"""

# undirected edges with relation ids
EDG = """edg AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, id AS rel_id FROM rel
  UNION ALL SELECT target_id, source_id, id FROM rel WHERE source_id <> target_id)"""


def sql(*ctes: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the given CTE texts, then the body; the body may go on with more CTEs after a leading comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + body
