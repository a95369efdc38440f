"""Recommendation, similarity, keyword, vector and fused search."""

from pyspark.sql import functions as F

from graphloom.operators import recommend as R
from graphloom.operators import search as Q
from graphloom.operators.ingest import judge_prompts
from graphloom.plans.base_sql import ADJ, ALI, ENT, REL, VEC, sql
from graphloom.plans.basic import ids_of
from graphloom.plans.registry import ORACLES, query, store
from graphloom.sources.derived import CUSTOMER, KIND, NATION, PART, REGION, SUPPLIER, table

_DEG = """deg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM adj GROUP BY src)"""
_NAMED = """SELECT p.{center}source_id, p.target_id, p.common_count, p.score, p.rank,
 (SELECT string_agg(e.name, '|' ORDER BY f) FROM (SELECT m, min(rid) AS f FROM (
    SELECT x.dst AS m, x.rel_id AS rid FROM edg x WHERE x.src = p.source_id
      AND x.dst IN (SELECT dst FROM adj WHERE src = p.target_id)) GROUP BY m ORDER BY f LIMIT 6) JOIN ent e ON e.id = m) AS common_names,
 a.name AS source_name, b.name AS target_name FROM p JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id"""
_EDGES = """edg AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, id AS rel_id FROM rel
  UNION ALL SELECT target_id, source_id, id FROM rel)"""


def _recommend_sql(rel):
    return sql(ENT, rel, ADJ, _EDGES, _DEG, body=""",
pair AS (SELECT x.src AS source_id, y.src AS target_id, count(*) AS common_count, round(sum(1 / ln(d.d + 1)), 4) AS score
  FROM adj x JOIN adj y ON x.dst = y.dst AND x.src < y.src JOIN deg d ON d.id = x.dst GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT pair.*, (row_number() OVER (ORDER BY score DESC, common_count DESC, source_id, target_id))::INTEGER AS rank FROM pair
  JOIN deg a ON a.id = source_id JOIN deg b ON b.id = target_id
  WHERE least(a.d, b.d) <= 300 AND (source_id, target_id) NOT IN (SELECT src, dst FROM adj)
  ORDER BY score DESC, common_count DESC, source_id, target_id LIMIT 20)
""" + _NAMED.format(center=""))


def recs(df):
    return df.withColumn("common_names", F.array_join("common_names", "|"))


def purchases(spark, sf_dir):
    g = store(spark, sf_dir)
    return g.with_tables(relations=g.relations.where("name = '购买'"))


_BUY = REL.replace("rel AS MATERIALIZED (", "rel0 AS (") + ",\nrel AS MATERIALIZED (SELECT * FROM rel0 WHERE name = '购买')"


@query
def recommend_purchases(spark, sf_dir):
    return recs(R.recommend(purchases(spark, sf_dir), hub_degree=R.HUB_DEGREE))


ORACLES["recommend_purchases"] = _recommend_sql(_BUY)


@query
def recommend_all_relations(spark, sf_dir):
    """The whole graph: suppliers, segments, nations and brands are the long middles."""
    return recs(R.recommend(store(spark, sf_dir), hub_degree=R.HUB_DEGREE))


ORACLES["recommend_all_relations"] = _recommend_sql(REL)


@query
def recommend_center(spark, sf_dir):
    nations = ids_of(spark, sf_dir, "nation", "n_nationkey", NATION)
    return recs(R.recommend_for(store(spark, sf_dir), nations, hub_degree=R.HUB_DEGREE))


_CENTER = """,
pair AS (SELECT x.src AS center, least(x.src, y.src) AS source_id, greatest(x.src, y.src) AS target_id, count(*) AS common_count,
    round(sum(1 / ln(d.d + 1)), 4) AS score
  FROM adj x JOIN adj y ON x.dst = y.dst AND x.src <> y.src JOIN deg d ON d.id = x.dst WHERE x.src // 1000000000 = 2 GROUP BY ALL),
r AS (SELECT pair.*, (row_number() OVER (PARTITION BY center ORDER BY score DESC, common_count DESC, source_id, target_id))::INTEGER AS rank FROM pair
  JOIN deg a ON a.id = source_id JOIN deg b ON b.id = target_id
  WHERE {hubs}(source_id, target_id) NOT IN (SELECT src, dst FROM adj)),
p AS (SELECT * FROM r WHERE rank <= 20)
"""


def _center_sql(hubs=""):
    return sql(ENT, REL, ADJ, _EDGES, _DEG, body=_CENTER.format(hubs=hubs) + _NAMED.format(center="center, p."))


ORACLES["recommend_center"] = _center_sql("least(a.d, b.d) <= 300 AND ")


@query
def jaccard_similar(spark, sf_dir):
    """Every customer against the whole graph."""
    targets = ids_of(spark, sf_dir, "customer", "c_custkey", CUSTOMER)
    return R.similar_by_structure(store(spark, sf_dir), targets)


def _jaccard(kind, where=""):
    return f"""jac AS (SELECT target, id, score, row_number() OVER (PARTITION BY target ORDER BY raw DESC, id) AS rank FROM (
  SELECT target, j.id, i / (a.d + b.d - i) AS raw, round(i / (a.d + b.d - i), 4) AS score FROM (
    SELECT target, id, sum(n) AS i FROM (
      SELECT x.src AS target, y.src AS id, count(*)::DOUBLE AS n FROM adj x JOIN adj y ON x.dst = y.dst AND x.src <> y.src
      WHERE x.src // 1000000000 IN ({kind}) {where} GROUP BY ALL
      UNION ALL SELECT src, dst, 0 FROM adj x WHERE src // 1000000000 IN ({kind}) {where}) GROUP BY ALL) j
  JOIN deg a ON a.id = target JOIN deg b ON b.id = j.id))"""


ORACLES["jaccard_similar"] = sql(ENT, REL, ADJ, _DEG, _jaccard("7"), body="""
SELECT target, id, score, rank::INTEGER AS rank FROM jac WHERE rank <= 8""")


def nation_sets(spark, sf_dir):
    """Per nation: its suppliers, in key order."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        (F.col("s_nationkey") + NATION * KIND).cast("long").alias("set_id"), F.col("s_suppkey").alias("pos"),
        (F.col("s_suppkey") + SUPPLIER * KIND).cast("long").alias("id"))


@query
def co_neighbors(spark, sf_dir):
    return R.co_neighbors(store(spark, sf_dir), nation_sets(spark, sf_dir))


_SETS = """mem AS (SELECT (2000000000 + s_nationkey)::BIGINT AS set_id, s_suppkey AS pos, 5000000000 + s_suppkey AS id FROM supplier)"""
ORACLES["co_neighbors"] = sql(ENT, REL, ADJ, _SETS, body=""",
pr AS (SELECT x.set_id, x.id AS a, y.id AS b, x.pos AS pa, y.pos AS pb, count(*) AS shared_count FROM mem x JOIN mem y ON y.set_id = x.set_id AND y.pos > x.pos
  JOIN adj p ON p.src = x.id JOIN adj q ON q.src = y.id AND q.dst = p.dst WHERE p.dst <> x.id AND p.dst <> y.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY shared_count DESC, pa, pb) AS rank FROM pr)
SELECT set_id, a, b, shared_count, rank::INTEGER AS rank FROM r WHERE rank <= 5""")


@query
def shared_neighbors(spark, sf_dir):
    g = store(spark, sf_dir)
    return R.shared_neighbors(g, R.co_neighbors(g, nation_sets(spark, sf_dir)))


ORACLES["shared_neighbors"] = sql(ENT, REL, ADJ, _SETS, body=""",
pr AS (SELECT x.set_id, x.id AS a, y.id AS b, x.pos AS pa, y.pos AS pb, count(*) AS n FROM mem x JOIN mem y ON y.set_id = x.set_id AND y.pos > x.pos
  JOIN adj p ON p.src = x.id JOIN adj q ON q.src = y.id AND q.dst = p.dst GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, pa, pb) AS rank FROM pr)
SELECT a, b, p.dst AS shared FROM r JOIN adj p ON p.src = a JOIN adj q ON q.src = b AND q.dst = p.dst WHERE rank <= 5""")


@query
def bridges(spark, sf_dir):
    return R.bridges(store(spark, sf_dir), nation_sets(spark, sf_dir))


ORACLES["bridges"] = sql(ENT, REL, ADJ, _SETS, body=""",
b AS (SELECT set_id, dst AS id, count(*) AS links FROM mem JOIN adj ON src = mem.id WHERE (set_id, dst) NOT IN (SELECT set_id, id FROM mem)
  GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY links DESC, id) AS rank FROM b)
SELECT set_id, r.id, name, links, rank::INTEGER AS rank FROM r JOIN ent ON ent.id = r.id WHERE rank <= 5""")


def part_queries(spark, sf_dir):
    """One query per distinct part name, with the vector of the first part so named."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return p.join(e, "qid", "left").select("qid", F.concat(F.lit(" "), F.upper("p_name"), F.lit("  n1 ")).alias("text"), "vector")


_QS = """qs AS (SELECT qid, p_name || ' n1' AS text, embedding::DOUBLE[] AS vector FROM (SELECT p_name, min(p_partkey) AS qid FROM part GROUP BY p_name)
  LEFT JOIN embeddings ON vec_id = qid),
term AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(string_split(lower(text), ' ')) AS term FROM qs) GROUP BY ALL),
txt AS (SELECT id, lower(name) AS n, lower(name || '（' || category || '）' || CASE id // 1000000000
    WHEN 5 THEN ' acctbal:' || (attributes->>'acctbal') WHEN 6 THEN ' type:' || (attributes->>'type') || '；size:' || (attributes->>'size')
    WHEN 7 THEN ' segment:' || (attributes->>'segment') ELSE '' END) AS t, lower(attributes) AS j FROM ent)"""
_KW = """kw AS MATERIALIZED (SELECT qid, id, sum(times * s)::BIGINT AS score FROM term JOIN (
  SELECT term, id, CASE WHEN n = term THEN 10 WHEN contains(n, term) THEN 5 WHEN lower(alias) = term THEN 6 WHEN contains(lower(alias), term) THEN 3
    WHEN contains(t, term) THEN 1 ELSE 0 END AS s
  FROM (SELECT DISTINCT term FROM term), txt LEFT JOIN ali ON entity_id = id) USING (term) WHERE s > 0 GROUP BY ALL)"""


@query
def keyword_search(spark, sf_dir):
    return Q.keyword_search(store(spark, sf_dir), part_queries(spark, sf_dir))


ORACLES["keyword_search"] = sql(ENT, ALI, _QS, _KW, body=" SELECT qid, id, score FROM kw")


@query
def keyword_simple(spark, sf_dir):
    return Q.keyword_topk(store(spark, sf_dir), part_queries(spark, sf_dir))


ORACLES["keyword_simple"] = sql(ENT, _QS, body=""",
k AS (SELECT qid, id, sum(times * s)::BIGINT AS score FROM (
  SELECT qid, times, id, CASE WHEN n = term THEN 10 WHEN contains(n, term) THEN 5 WHEN contains(j, term) THEN 1 ELSE 0 END AS s FROM term, txt)
  WHERE s > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k)
SELECT qid, r.id, score, rank::INTEGER AS rank, name, category, attributes FROM r JOIN ent ON ent.id = r.id WHERE rank <= 10""")


@query
def hit_relation_texts(spark, sf_dir):
    g = store(spark, sf_dir)
    return Q.hit_relation_texts(g, ids_of(spark, sf_dir, "region", "r_regionkey", REGION))


ORACLES["hit_relation_texts"] = sql(ENT, REL, body=""" SELECT r.target_id AS id, r.id AS relation_id, a.name || ' —[' || r.name || ']→ ' || b.name AS text
FROM rel r JOIN ent a ON a.id = source_id JOIN ent b ON b.id = target_id WHERE target_id // 1000000000 = 1""")


def vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


@query
def cosine_topk(spark, sf_dir):
    """Every vector against every other, eight best above the bound."""
    g = store(spark, sf_dir)
    q = g.vectors.select(F.col("entity_id").alias("qid"), "vector")
    out = Q.vector_topk(q, g.vectors, 8, Q.SIMILAR_MIN, skip_self=True)
    return out.select("qid", "id", F.round("score", 4).alias("score"))


ORACLES["cosine_topk"] = """WITH v AS (SELECT 6000000000 + vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.id AS qid, b.id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM c WHERE s > 0.1)
SELECT qid, id, round(s, 4) AS score FROM r WHERE rank <= 8"""


@query
def semantic_search(spark, sf_dir):
    out = Q.semantic_search(part_queries(spark, sf_dir), store(spark, sf_dir).vectors, 30)
    return out.select("qid", "id", F.round("score", 4).alias("score"))


_SEM = """sem AS (SELECT qid, entity_id AS id, list_cosine_similarity(qs.vector, vec.vector::DOUBLE[]) AS s FROM qs, vec WHERE qs.vector IS NOT NULL),
sr AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM sem WHERE s > 0.15)"""
ORACLES["semantic_search"] = sql(ENT, VEC, _QS, _SEM, body=" SELECT qid, id, round(s, 4) AS score FROM sr WHERE rank <= 30")


@query
def hybrid_search(spark, sf_dir):
    return Q.hybrid_search(store(spark, sf_dir), part_queries(spark, sf_dir))


ORACLES["hybrid_search"] = sql(ENT, REL, ALI, VEC, _QS, _KW, _SEM, body=""",
kr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM kw),
f AS (SELECT coalesce(k.qid, s.qid) AS qid, coalesce(k.id, s.id) AS id, k.rank AS kr, s.rank AS sr,
   coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf
   FROM (SELECT * FROM kr WHERE rank <= 30) k FULL JOIN (SELECT * FROM sr WHERE rank <= 30) s ON s.qid = k.qid AND s.id = k.id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, kr NULLS LAST, sr) AS rank FROM f),
n AS (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id)
SELECT t.qid, t.rank::INTEGER AS rank, t.id, e.name, round(rrf, 5) AS rrf_score, round(s.s, 4) AS semantic_score, kw.score AS keyword_score,
  coalesce(n.n, 0)::BIGINT AS hit_relations, CASE WHEN qs.vector IS NULL THEN 'keyword_only' ELSE 'hybrid' END AS mode
FROM t JOIN qs USING (qid) LEFT JOIN ent e ON e.id = t.id LEFT JOIN sr s ON s.qid = t.qid AND s.id = t.id
LEFT JOIN kw ON kw.qid = t.qid AND kw.id = t.id LEFT JOIN n ON n.id = t.id WHERE t.rank <= 10""")


@query
def similar_entities(spark, sf_dir):
    """Parts by vector where one is close, nations and the other parts by structure."""
    targets = ids_of(spark, sf_dir, "part", "p_partkey", PART).unionAll(ids_of(spark, sf_dir, "nation", "n_nationkey", NATION))
    return Q.similar_entities(store(spark, sf_dir), targets, 5)


ORACLES["similar_entities"] = sql(ENT, REL, ADJ, _DEG, VEC, body=""",
ve AS (SELECT entity_id AS id, vector::DOUBLE[] AS v FROM vec),
sm AS (SELECT a.id AS target, b.id, list_cosine_similarity(a.v, b.v) AS s FROM ve a JOIN ve b ON a.id <> b.id JOIN ent ON ent.id = a.id),
sr AS (SELECT target, id, s, row_number() OVER (PARTITION BY target ORDER BY s DESC, id) AS rank FROM sm WHERE s > 0.1),
""" + _jaccard("2, 6", "AND x.src NOT IN (SELECT target FROM sr)") + """
SELECT target, 'semantic' AS mode, id, round(s, 4) AS score, rank::INTEGER AS rank FROM sr WHERE rank <= 5 AND id IN (SELECT id FROM ent)
UNION ALL SELECT target, 'structure', id, score, rank::INTEGER FROM jac WHERE rank <= 5""")


@query
def stale_vectors(spark, sf_dir):
    return Q.stale_vectors(store(spark, sf_dir))


ORACLES["stale_vectors"] = sql(ENT, VEC, body=""",
now AS (SELECT id, name || '（' || category || '）' || CASE id // 1000000000
    WHEN 5 THEN ' acctbal:' || (attributes->>'acctbal') WHEN 6 THEN ' type:' || (attributes->>'type') || '；size:' || (attributes->>'size')
    WHEN 7 THEN ' segment:' || (attributes->>'segment') ELSE '' END AS text FROM ent)
SELECT id, now.text, CASE WHEN vec.entity_id IS NULL THEN 'missing' ELSE 'changed' END AS state
FROM now LEFT JOIN vec ON entity_id = id WHERE vec.entity_id IS NULL OR vec.text <> now.text""")


@query
def orphan_vectors(spark, sf_dir):
    return Q.orphan_vectors(store(spark, sf_dir)).select("entity_id")


ORACLES["orphan_vectors"] = sql(VEC, body=" SELECT entity_id FROM vec WHERE entity_id NOT IN (SELECT 6000000000 + p_partkey FROM part)")


@query
def prune_orphan_vectors(spark, sf_dir):
    return Q.prune_orphan_vectors(store(spark, sf_dir)).vectors.select("entity_id", "text")


ORACLES["prune_orphan_vectors"] = sql(VEC, body=" SELECT entity_id, text FROM vec WHERE entity_id IN (SELECT 6000000000 + p_partkey FROM part)")


@query
def embedding_status(spark, sf_dir):
    return Q.embedding_status(store(spark, sf_dir))


ORACLES["embedding_status"] = sql(ENT, body=""" SELECT true AS configured, (SELECT count(*) FROM embeddings)::BIGINT AS indexed,
(SELECT count(*) FROM ent)::BIGINT AS total_entities""")


@query
def upsert_vectors(spark, sf_dir):
    """Refresh the outdated part vectors and add those of customers' keys not indexed yet."""
    g = store(spark, sf_dir)
    new = Q.embed_table(Q.stale_vectors(g), char_vector)
    out = Q.upsert_vectors(g.vectors, new)
    return out.select("entity_id", "text", F.size("vector").alias("dim"))


def char_vector(texts):
    """Deterministic stand-in for a vector service: character counts over 8 slots."""
    out = []
    for t in texts:
        v = [0.0] * 8
        for ch in t:
            v[ord(ch) % 8] += 1.0
        out.append(v)
    return out


ORACLES["upsert_vectors"] = sql(ENT, VEC, body=""",
now AS (SELECT id, name || '（' || category || '）' || CASE id // 1000000000
    WHEN 5 THEN ' acctbal:' || (attributes->>'acctbal') WHEN 6 THEN ' type:' || (attributes->>'type') || '；size:' || (attributes->>'size')
    WHEN 7 THEN ' segment:' || (attributes->>'segment') ELSE '' END AS text FROM ent),
st AS (SELECT id, now.text FROM now LEFT JOIN vec ON entity_id = id WHERE vec.entity_id IS NULL OR vec.text <> now.text)
SELECT id AS entity_id, text, 8 AS dim FROM st
UNION ALL SELECT entity_id, text, 64 FROM vec WHERE entity_id NOT IN (SELECT id FROM st)""")


def nation_questions(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("qid"),
        F.concat(F.lit("How is "), F.col("n_name"), F.lit(" linked to "), F.col("r_name")).alias("text"))


@query
def scan_by_name(spark, sf_dir):
    return Q.mentions(nation_questions(spark, sf_dir), store(spark, sf_dir).entities, 10)


ORACLES["scan_by_name"] = sql(ENT, body=""",
q AS (SELECT n_nationkey::BIGINT AS qid, 'How is ' || n_name || ' linked to ' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT qid, id, name, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM q JOIN ent ON length(name) >= 2 AND contains(text, name))
SELECT qid, id, name, rank::INTEGER AS rank FROM h WHERE rank <= 10""")


@query
def judge_prompt_texts(spark, sf_dir):
    """The whole prompt of every recommended pair of a nation, pairs of hubs included."""
    g = store(spark, sf_dir)
    pairs = R.recommend_for(g, ids_of(spark, sf_dir, "nation", "n_nationkey", NATION))
    return judge_prompts(g, pairs, "J").select("center", "rank", "prompt")


_SHOWN = "{0}.name || '（' || {0}.category || '）' || CASE WHEN {0}.attributes <> '{{}}' THEN ' ' || {0}.attributes ELSE '' END"
ORACLES["judge_prompt_texts"] = sql(ENT, body=f"""
SELECT q.center, q.rank, 'J' || chr(10) || 'A: ' || {_SHOWN.format("a")} || chr(10) || 'B: ' || {_SHOWN.format("b")}
  || CASE WHEN q.common_names <> '' THEN chr(10) || 'common: ' || replace(q.common_names, '|', '、') ELSE '' END AS prompt
FROM ({_center_sql()}) q JOIN ent a ON a.id = q.source_id JOIN ent b ON b.id = q.target_id""")
