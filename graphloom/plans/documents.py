"""Chunking, model outputs, candidates, retrieval, export, streams."""


from pyspark.sql import functions as F

from graphloom.functions import jsontext as J
from graphloom.operators import ingest as I
from graphloom.operators import recommend as R
from graphloom.operators import retrieval as RT
from graphloom.plans.base_sql import ADJ, ALI, ENT, LOG, REL, sql
from graphloom.plans.basic import ids_of
from graphloom.plans.registry import ORACLES, query, store
from graphloom.plans.search import nation_questions
from graphloom.session import materialize, new_path
from graphloom.sources import export as X
from graphloom.sources.derived import CUSTOMER, KIND, NATION, RKIND, table
from graphloom.streaming import changes as ST

LIMITS = (RT.MAX_STEPS, RT.EDGE_ROWS, RT.KEYWORD_TOP, RT.EGO_NODES)

_WS = "E' \\t\\n\\r'"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def dialogs(spark, sf_dir):
    """Each conversation as one text, turns set apart by blank lines."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n\n").alias("text"))


@query
def chunk_documents(spark, sf_dir):
    return I.chunk_documents(documents(spark, sf_dir))


# document texts have no blank line inside, so each is one paragraph
ORACLES["chunk_documents"] = f"""WITH d AS (SELECT doc_id, trim(text, {_WS}) AS t FROM documents)
SELECT doc_id, i::INTEGER AS chunk_idx, substr(t, i * 3000 + 1, 3000) AS chunk
FROM (SELECT doc_id, t, unnest(generate_series(0, greatest((length(t) - 1) // 3000, 0))) AS i FROM d WHERE t <> '')"""


@query
def chunk_conversations(spark, sf_dir):
    return I.chunk_documents(dialogs(spark, sf_dir), 600)


ORACLES["chunk_conversations"] = f"""WITH RECURSIVE d AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
raw AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(t, '\\n{{2,}}'), 1) AS o FROM d),
par AS MATERIALIZED (SELECT doc_id, trim(p, {_WS}) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i FROM raw WHERE trim(p, {_WS}) <> ''),
fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, '' AS cur, []::VARCHAR[] AS outp FROM par
  UNION ALL SELECT f.doc_id, f.i + 1,
    CASE WHEN length(p) > 600 THEN '' WHEN length(cur) + 2 + length(p) > 600 THEN p WHEN cur = '' THEN p ELSE cur || chr(10) || chr(10) || p END,
    CASE WHEN length(p) > 600 THEN list_concat(CASE WHEN cur <> '' THEN list_append(outp, cur) ELSE outp END,
           list_transform(generate_series(0, (length(p) - 1) // 600), lambda k: substr(p, k * 600 + 1, 600)))
         WHEN length(cur) + 2 + length(p) > 600 AND cur <> '' THEN list_append(outp, cur) ELSE outp END
  FROM fold f JOIN par ON par.doc_id = f.doc_id AND par.i = f.i + 1),
fin AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(outp, cur) ELSE outp END AS c FROM fold f
  WHERE i = (SELECT max(i) FROM par WHERE par.doc_id = f.doc_id))
SELECT doc_id, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_idx, unnest(c) AS chunk FROM fin"""


@query
def chunk_sentences(spark, sf_dir):
    return I.chunk_sentences(documents(spark, sf_dir))


ORACLES["chunk_sentences"] = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, text, length(text) > 2100 AS long,
   CASE WHEN length(text) > 2100 THEN regexp_extract_all(text, '[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+') ELSE [text] END AS ss FROM documents),
fold AS (SELECT doc_id, 0 AS i, '' AS cur, NULL::VARCHAR AS done FROM s
  UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN length(cur) + length(ss[f.i + 1]) > 1400 AND cur <> '' THEN ss[f.i + 1] ELSE cur || ss[f.i + 1] END,
    CASE WHEN length(cur) + length(ss[f.i + 1]) > 1400 AND cur <> '' THEN cur END
  FROM fold f JOIN s ON s.doc_id = f.doc_id WHERE f.i < len(ss)),
c AS (SELECT doc_id, i, trim(done, {_WS}) AS t FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT f.doc_id, i + 1, trim(cur, {_WS}) FROM fold f JOIN s ON s.doc_id = f.doc_id WHERE f.i = len(ss))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS chunk_idx, t AS chunk FROM c WHERE t <> ''"""


@query
def oversized_documents(spark, sf_dir):
    return I.oversized_documents(I.chunk_documents(documents(spark, sf_dir)), 5)


ORACLES["oversized_documents"] = f"""WITH d AS (SELECT doc_id, trim(text, {_WS}) AS t FROM documents)
SELECT doc_id, ((length(t) - 1) // 3000 + 1)::BIGINT AS chunks FROM d WHERE (length(t) - 1) // 3000 + 1 > 5"""


@query
def extract_prompts(spark, sf_dir):
    p = I.extract_prompts(I.chunk_documents(documents(spark, sf_dir)), "T:")
    return p.select("doc_id", "chunk_idx", F.md5("prompt").alias("prompt_md5"))


ORACLES["extract_prompts"] = "SELECT doc_id, chunk_idx, md5('T:' || chunk) AS prompt_md5 FROM (" + ORACLES["chunk_documents"] + ")"


def outputs(spark, sf_dir):
    """A model output per chunk: fenced JSON for labelled documents, with a stray comma where toxic,
    the chunk itself for the others."""
    chunks = I.chunk_documents(documents(spark, sf_dir))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = lambda c: F.col(c).cast("string")
    body = F.concat(
        F.lit('{"entities":[{"name":" doc'), s("doc_id"), F.lit('","category":"x","attributes":{"chunk'), s("chunk_idx"), F.lit('":'), F.length("chunk").cast("string"),
        F.lit(',"first":"'), s("chunk_idx"), F.lit('"},"aliases":[" d'), s("doc_id"), F.lit('",5,"","c'), s("chunk_idx"), F.lit('"]},{"name":"'), F.col("lang"),
        F.lit('","category":"抽象实体"},{"name":"NATION_'), (F.col("doc_id") % 25).cast("string"), F.lit('"},{"name":"d'), s("doc_id"),
        F.lit('"},{"name":7}],"relations":[{"from":"doc'), s("doc_id"), F.lit('","to":"'), F.col("lang"), F.lit('","name":"属于","category":"归属","confidence":"确证"},{"from":"d'),
        s("doc_id"), F.lit('","to":"N'), (F.col("doc_id") % 25).cast("string"), F.lit('","name":"提到"},{"from":"","to":"x","name":"y"},{"from":"doc'), s("doc_id"),
        F.lit('","to":"nowhere'), s("chunk_idx"), F.lit('","name":"去"}'), F.when(F.col("toxic") == 1, ",").otherwise(""), F.lit("]}"))
    text = F.when(F.col("quality").isNull(), F.col("chunk")).otherwise(F.concat(F.lit("Answer:\n```json\n"), body, F.lit("\n```\nend {}")))
    return chunks.join(d, "doc_id").select("doc_id", "chunk_idx", F.concat(F.lit("f"), s("doc_id"), F.lit(".md")).alias("filename"), text.alias("text"))


_OUT = f"""ch AS MATERIALIZED (SELECT c.doc_id, c.chunk_idx, length(c.chunk) AS n, c.chunk, lang, quality IS NOT NULL AS labelled FROM (""" + ORACLES["chunk_documents"] + """) c
  JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)),
lab AS (SELECT * FROM ch WHERE labelled)"""


@query
def parse_model_json(spark, sf_dir):
    return I.parse_model_json(outputs(spark, sf_dir)).select("doc_id", "chunk_idx", "json")


ORACLES["parse_model_json"] = f"WITH {_OUT} " + """SELECT doc_id, chunk_idx, CASE WHEN labelled THEN '{"entities":[{"name":" doc' || doc_id || '","category":"x","attributes":{"chunk' || chunk_idx || '":' || n ||
 ',"first":"' || chunk_idx || '"},"aliases":[" d' || doc_id || '",5,"","c' || chunk_idx || '"]},{"name":"' || lang || '","category":"抽象实体"},{"name":"NATION_' || (doc_id % 25) ||
 '"},{"name":"d' || doc_id || '"},{"name":7}],"relations":[{"from":"doc' || doc_id || '","to":"' || lang || '","name":"属于","category":"归属","confidence":"确证"},{"from":"d' || doc_id ||
 '","to":"N' || (doc_id % 25) || '","name":"提到"},{"from":"","to":"x","name":"y"},{"from":"doc' || doc_id || '","to":"nowhere' || chunk_idx || '","name":"去"}]}' END AS json FROM ch"""


@query
def extract_json_strict(spark, sf_dir):
    j = J.strict_json(F.col("text"))
    return outputs(spark, sf_dir).select("doc_id", "chunk_idx", j["json"].isNotNull().alias("ok"), j["error"].alias("error"))


# the text behind the block ends with {}, so the span is longer than the object and is refused
ORACLES["extract_json_strict"] = f"WITH {_OUT} SELECT doc_id, chunk_idx, false AS ok, " + """CASE WHEN labelled THEN 'JSON解析失败'
 WHEN contains(chunk, '{') AND contains(chunk, '}') AND strpos(chunk, '{') < length(chunk) - strpos(reverse(chunk), '}') + 1 THEN 'JSON解析失败' ELSE '输出中未找到JSON对象' END AS error FROM ch"""


def candidates(spark, sf_dir):
    return I.normalize_candidates(I.parse_model_json(outputs(spark, sf_dir)), I.MAX_ALIASES)


@query
def normalize_candidate_entities(spark, sf_dir):
    return candidates(spark, sf_dir)[0].withColumn("aliases", F.array_join("aliases", "|"))


ORACLES["normalize_candidate_entities"] = f"WITH {_OUT} " + """SELECT doc_id, chunk_idx, 0 AS pos, 'doc' || doc_id AS name, '抽象实体' AS category,
 '{"chunk' || chunk_idx || '":' || n || ',"first":"' || chunk_idx || '"}' AS attributes, 'd' || doc_id || '|c' || chunk_idx AS aliases FROM lab
UNION ALL SELECT doc_id, chunk_idx, 1, lang, '抽象实体', '{}', '' FROM lab
UNION ALL SELECT doc_id, chunk_idx, 2, 'NATION_' || (doc_id % 25), '抽象实体', '{}', '' FROM lab
UNION ALL SELECT doc_id, chunk_idx, 3, 'd' || doc_id, '抽象实体', '{}', '' FROM lab"""


@query
def normalize_candidate_relations(spark, sf_dir):
    return candidates(spark, sf_dir)[1]


_CREL = """SELECT doc_id, chunk_idx, 0 AS pos, 'doc' || doc_id AS "from", lang AS "to", '属于' AS name, '归属' AS category, '确证' AS confidence,
 '《f' || doc_id || '.md》片段' || (chunk_idx + 1) AS source_ref FROM lab
UNION ALL SELECT doc_id, chunk_idx, 1, 'd' || doc_id, 'N' || (doc_id % 25), '提到', '属性', '推测', '《f' || doc_id || '.md》片段' || (chunk_idx + 1) FROM lab
UNION ALL SELECT doc_id, chunk_idx, 3, 'doc' || doc_id, 'nowhere' || chunk_idx, '去', '属性', '推测', '《f' || doc_id || '.md》片段' || (chunk_idx + 1) FROM lab"""
ORACLES["normalize_candidate_relations"] = f"WITH {_OUT} " + _CREL


@query
def merge_candidate_entities(spark, sf_dir):
    return I.merge_candidate_entities(candidates(spark, sf_dir)[0]).withColumn("aliases", F.array_join("aliases", "|"))


_MERGED = """SELECT doc_id, 0 AS chunk_idx, 0 AS pos, 'doc' || doc_id AS name, '抽象实体' AS category,
  '{"chunk0":' || any_value(n) FILTER (chunk_idx = 0) || ',"first":"0"' || coalesce(string_agg(',"chunk' || chunk_idx || '":' || n, '' ORDER BY chunk_idx) FILTER (chunk_idx > 0), '') || '}' AS attributes,
  'd' || doc_id || '|' || string_agg('c' || chunk_idx, '|' ORDER BY chunk_idx) AS aliases FROM lab GROUP BY doc_id
UNION ALL SELECT DISTINCT doc_id, 0, 1, lang, '抽象实体', '{}', '' FROM lab
UNION ALL SELECT DISTINCT doc_id, 0, 2, 'NATION_' || (doc_id % 25), '抽象实体', '{}', '' FROM lab
UNION ALL SELECT DISTINCT doc_id, 0, 3, 'd' || doc_id, '抽象实体', '{}', '' FROM lab"""
ORACLES["merge_candidate_entities"] = f"WITH {_OUT} " + _MERGED


@query
def dedup_candidate_relations(spark, sf_dir):
    return I.dedup_candidate_relations(candidates(spark, sf_dir)[1])


ORACLES["dedup_candidate_relations"] = f"WITH {_OUT}, r AS ({_CREL}) SELECT * FROM r WHERE chunk_idx = 0 OR pos = 3"


def matched(spark, sf_dir):
    e, r = candidates(spark, sf_dir)
    return I.match_candidates(store(spark, sf_dir), I.merge_candidate_entities(e), I.dedup_candidate_relations(r))


@query
def match_candidate_entities(spark, sf_dir):
    return matched(spark, sf_dir)[0].select("doc_id", "name", "existing_id", "dupe_of", "dupe_of_candidate")


ORACLES["match_candidate_entities"] = f"WITH {_OUT}, m AS ({_MERGED}) " + """SELECT doc_id, name, CASE pos WHEN 2 THEN 2000000000 + doc_id % 25 END AS existing_id,
 CASE pos WHEN 3 THEN 0::BIGINT END AS dupe_of, pos = 3 AS dupe_of_candidate FROM m"""


@query
def match_candidate_relations(spark, sf_dir):
    return matched(spark, sf_dir)[1].select("doc_id", "from", "to", "name", "from_id", "from_cand", "to_id", "to_cand", "unresolved")


ORACLES["match_candidate_relations"] = f"WITH {_OUT}, r AS ({_CREL}) " + """SELECT doc_id, "from", "to", name, NULL::BIGINT AS from_id, 0::BIGINT AS from_cand,
 CASE pos WHEN 1 THEN 2000000000 + doc_id % 25 END AS to_id, CASE pos WHEN 0 THEN 1::BIGINT END AS to_cand, pos = 3 AS unresolved FROM r WHERE chunk_idx = 0 OR pos = 3"""


@query
def commit_candidates(spark, sf_dir):
    e, r = matched(spark, sf_dir)
    _, counts, error = I.commit_candidates(store(spark, sf_dir), e, r)
    if error:
        raise RuntimeError(error)
    return counts


ORACLES["commit_candidates"] = f"WITH {_OUT} " + """SELECT DISTINCT doc_id, 2::BIGINT AS entities_added, 1::BIGINT AS entities_linked, 2::BIGINT AS relations_added,
 0::BIGINT AS relations_skipped FROM lab"""


@query
def ingest_task_summary(spark, sf_dir):
    parsed = materialize(I.parse_model_json(outputs(spark, sf_dir)).drop("text"), "parsed")
    e, r = I.normalize_candidates(parsed, I.MAX_ALIASES)
    return I.ingest_task_summary(I.chunk_documents(documents(spark, sf_dir)), parsed, I.merge_candidate_entities(e), I.dedup_candidate_relations(r))


ORACLES["ingest_task_summary"] = f"WITH {_OUT} " + """SELECT doc_id, count(*)::BIGINT AS chunks_total, count(*) FILTER (NOT labelled)::BIGINT AS failed_chunks,
 CASE WHEN bool_or(labelled) THEN 4 ELSE 0 END::BIGINT AS entity_count, CASE WHEN bool_or(labelled) THEN 2 + count(*) ELSE 0 END::BIGINT AS relation_count,
 CASE WHEN bool_or(labelled) THEN 'review' ELSE 'failed' END AS status FROM ch GROUP BY doc_id"""


@query
def doc_import_report(spark, sf_dir):
    chunks = I.chunk_sentences(documents(spark, sf_dir))
    labels = table(spark, sf_dir, "labels")
    errors = chunks.join(labels.where("toxic = 1"), "doc_id").select("doc_id", "chunk_idx")
    kind = F.when(F.col("chunk_idx") == 0, "add_entity").when(F.col("chunk_idx") % 2 == 0, "add_relation").otherwise("update_entity")
    return I.doc_import_report(chunks, chunks.select("doc_id", kind.alias("op")), errors)


ORACLES["doc_import_report"] = "WITH c AS (SELECT * FROM (" + ORACLES["chunk_sentences"] + """))
SELECT doc_id, count(*)::BIGINT AS chunks, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0 ELSE count(*) END::BIGINT AS chunks_ok,
 count(*) FILTER (chunk_idx = 0)::BIGINT AS entities_added, count(*) FILTER (chunk_idx > 0 AND chunk_idx % 2 = 0)::BIGINT AS relations_added,
 count(*) FILTER (chunk_idx % 2 = 1)::BIGINT AS others FROM c GROUP BY doc_id"""


def ops_messages(spark, sf_dir):
    """Conversation turns with blocks of operations: two good ones for assistants, a broken one for users."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id").cast("string")
    good = F.concat(F.lit('```kg-ops\n[{"op":"add_entity","name":"c'), k, F.lit('","category":"抽象实体","ref":"r","aliases":["a"]}]\n```'))
    more = F.concat(F.lit('```kg-ops [{"op":"add_relation","source_ref":"r","target_id":'), (F.col("turn") + 1).cast("string"), F.lit(',"name":"n"},{"op":"delete_entity","id":"9"}]```'))
    text = F.when(F.col("role") == "assistant", F.concat(good, F.col("text"), more)).otherwise(F.concat(F.col("text"), F.lit('```kg-ops {"a":1}```')))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), text.alias("text"))


@query
def parse_ops_blocks(spark, sf_dir):
    rows = I.parse_ops_blocks(ops_messages(spark, sf_dir))[0]
    return rows.select("msg_id", "block", "i", "op", "id", "name", "ref", "source_key_ref", "target_id", F.array_join("aliases", "|").alias("aliases"))


ORACLES["parse_ops_blocks"] = """WITH m AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT msg_id, 0 AS block, 0 AS i, 'add_entity' AS op, NULL::BIGINT AS id, 'c' || conv_id AS name, 'r' AS ref, NULL::VARCHAR AS source_key_ref, NULL::BIGINT AS target_id, 'a' AS aliases FROM m
UNION ALL SELECT msg_id, 1, 0, 'add_relation', NULL, 'n', NULL, 'r', turn + 1, NULL FROM m
UNION ALL SELECT msg_id, 1, 1, 'delete_entity', 9, NULL, NULL, NULL, NULL, NULL FROM m"""


@query
def ops_replies(spark, sf_dir):
    return I.parse_ops_blocks(ops_messages(spark, sf_dir))[1]


ORACLES["ops_replies"] = f"""SELECT conv_id * 1000 + turn AS msg_id, trim(text, {_WS}) AS reply, CASE WHEN role <> 'assistant' THEN 'kg-ops块必须是JSON数组' END AS parse_error FROM conversations"""


def agent_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.concat(F.lit('{"type":"text","sessionID":"s'), s("event_id"), F.lit('","part":{"text":"t'), s("event_id"), F.lit('"}}')))
        .when(kind == "view", F.concat(F.lit('  {"message":{"parts":[{"type":"text","text":"m'), s("event_id"), F.lit('"},{"type":"tool"}]}}')))
        .when(kind == "error", F.concat(F.lit('{"type":"error","error":{"data":{"message":"e'), s("event_id"), F.lit('","ref":"'), s("user_id"), F.lit('"}}}')))
        .otherwise(F.concat(F.lit("log "), F.col("props"))))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query
def agent_texts(spark, sf_dir):
    return I.parse_event_lines(agent_lines(spark, sf_dir))[0]


ORACLES["agent_texts"] = """SELECT user_id AS run_id, event_id AS line_no, 0 AS part, CASE event_type WHEN 'click' THEN 't' ELSE 'm' END || event_id AS text
FROM events WHERE event_type IN ('click', 'view')"""


@query
def agent_errors(spark, sf_dir):
    return I.parse_event_lines(agent_lines(spark, sf_dir))[1]


ORACLES["agent_errors"] = """SELECT user_id AS run_id, event_id AS line_no, 'e' || event_id || '（ref:' || user_id || '）' AS error FROM events WHERE event_type = 'error'"""


@query
def agent_sessions(spark, sf_dir):
    return I.parse_event_lines(agent_lines(spark, sf_dir))[2]


ORACLES["agent_sessions"] = "SELECT user_id AS run_id, 's' || min(event_id) AS session_id FROM events WHERE event_type = 'click' GROUP BY 1"


@query
def validate_judgements(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(
        F.lit('say ```json {"has_relation":'), F.when(F.col("p_size") < 10, "false").when(F.col("p_size") < 20, "1").otherwise("true"),
        F.lit(',"name":" '), F.when(F.col("p_size") > 40, "").otherwise(F.repeat("p_name", 5)), F.lit(' ","category":"'), F.when(F.col("p_size") % 2 == 0, "互动").otherwise(F.col("p_type")),
        F.lit('","confidence":"'), F.when(F.col("p_size") % 3 == 0, "存疑").otherwise("?"), F.lit('","evidence":"'), F.repeat("p_type", 60), F.lit('"} ```'))
    text = F.when(F.col("p_size") == 25, F.col("p_name")).otherwise(text)
    return I.validate_judgements(p.select("p_partkey", text.alias("text")), 30, 300).drop("text")


ORACLES["validate_judgements"] = """WITH p AS (SELECT p_partkey, p_size, p_size >= 10 AS has, trim(left(trim(repeat(p_name, 5)), 30)) AS nm0, left(trim(repeat(p_name, 5)), 30) AS nm, p_type FROM part),
e AS (SELECT *, CASE WHEN p_size = 25 THEN 'LLM输出无法解析: 输出中未找到JSON对象' WHEN has AND p_size > 40 THEN 'has_relation为true时关系名不能为空'
  WHEN has AND p_size % 2 <> 0 THEN '关系大类必须是: 空间/互动/归属/时间/属性' END AS error FROM p)
SELECT p_partkey, CASE WHEN error IS NULL THEN has END AS has_relation, CASE WHEN error IS NULL AND has THEN nm END AS name, CASE WHEN error IS NULL AND has THEN '互动' END AS category,
 CASE WHEN error IS NULL AND has THEN CASE WHEN p_size % 3 = 0 THEN '存疑' ELSE '推测' END END AS confidence,
 CASE WHEN error IS NULL AND has THEN left(repeat(p_type, 60), 300) END AS evidence, error FROM e"""


@query
def validate_plans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    kind = F.col("event_type")
    steps = (
        F.when(kind == "click", F.concat(F.lit('{"tool":"keyword","q":"'), n, F.lit('"},{"tool":"ego","center":"x","depth":'), (F.col("event_id") % 9).cast("string"), F.lit("}")))
        .when(kind == "view", F.lit('{"tool":"path","from":"a","to":" ","max":13},{"tool":"sql"}'))
        .when(kind == "error", F.lit('{"tool":"cypher","query":"MATCH (a)-[r]->(b) RETURN a"},7,{"tool":"cypher","query":"x"},{"tool":"keyword","q":" "},{"tool":"keyword","q":"k"}'))
        .otherwise(F.lit("")))
    text = F.when(kind == "signup", F.col("event_type")).otherwise(F.concat(F.lit('{"steps":['), steps, F.lit("]}")))
    return I.validate_plans(e.select("event_id", text.alias("text"))).select("event_id", "ok", F.array_join("errors", "; ").alias("errors"))


ORACLES["validate_plans"] = """SELECT event_id, errors = '' AS ok, errors FROM (SELECT event_id, CASE event_type
 WHEN 'click' THEN CASE WHEN event_id % 9 BETWEEN 1 AND 6 THEN '' ELSE '步骤2: ego.depth须为1-6整数' END
 WHEN 'view' THEN '步骤1: path需要非空from与to; 步骤1: path.max须为1-12整数; 步骤2工具"sql"不在白名单: keyword/cypher/path/ego'
 WHEN 'error' THEN '步骤数不得超过4; 步骤2必须是对象; 步骤3: cypher需要形如 MATCH (a)-[r]->(b) RETURN ... 的query; 步骤4: keyword需要非空q(字符串)'
 WHEN 'signup' THEN '输出中未找到JSON对象' ELSE 'steps必须为非空数组' END AS errors FROM events)"""


@query
def plan_steps(spark, sf_dir):
    """A plan of three steps per part; those of parts above size 12 ask for too long paths and give no steps."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("int")
    steps = [
        F.struct(F.lit("keyword").alias("tool"), F.col("p_name").alias("q")),
        F.struct(F.lit("path").alias("tool"), F.col("p_brand").alias("from"), F.col("p_type").alias("to"), size.alias("max")),
        F.struct(F.lit("ego").alias("tool"), F.col("p_type").alias("center"), F.when(size < 7, size).alias("depth"))]
    text = F.concat(F.lit('plan: {"steps":['), F.concat_ws(",", *map(F.to_json, steps)), F.lit("]}"))
    return I.plan_steps(p.select(F.col("p_partkey").cast("long").alias("qid"), text.alias("text"))).select("qid", "step", "tool", "q", "from", "to", "max", "center", "depth")


ORACLES["plan_steps"] = """WITH p AS (SELECT p_partkey::BIGINT AS qid, * FROM part WHERE p_size <= 12)
SELECT qid, 0 AS step, 'keyword' AS tool, p_name AS q, NULL AS "from", NULL AS "to", NULL::BIGINT AS max, NULL AS center, NULL::BIGINT AS depth FROM p
UNION ALL SELECT qid, 1, 'path', NULL, p_brand, p_type, p_size, NULL, NULL FROM p
UNION ALL SELECT qid, 2, 'ego', NULL, NULL, NULL, NULL, p_type, CASE WHEN p_size < 7 THEN p_size END FROM p"""


def retrieval_steps(spark, sf_dir):
    """Four steps per nation: keyword, edges into it, the path to its region, its surroundings."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    q = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("qid", F.col("n_nationkey").cast("long"))
    cond = F.array(F.struct(F.lit("target").alias("var"), F.lit("name").alias("field"), F.lit("=").alias("op"), F.col("n_name").alias("value")))
    none = lambda t: F.lit(None).cast(t)
    step = lambda i, tool, **c: q.select(
        "qid", F.lit(i).alias("step"), F.lit(tool).alias("tool"), c.get("q", none("string")).alias("q"), c.get("types", none("array<string>")).alias("rel_types"),
        c.get("conds", none("array<struct<var:string,field:string,op:string,value:string>>")).alias("conds"), c.get("f", none("string")).alias("from"),
        c.get("t", none("string")).alias("to"), none("int").alias("max"), c.get("center", none("string")).alias("center"), c.get("depth", none("int")).alias("depth"))
    return (
        step(0, "keyword", q=F.col("n_name")).unionByName(step(1, "cypher", types=F.array(F.lit("位于"), F.lit("空间")), conds=cond))
        .unionByName(step(2, "path", f=F.col("n_name"), t=F.col("r_name"))).unionByName(step(3, "ego", center=F.col("n_name"), depth=F.lit(1)))
    )


_STEPS = """nat AS (SELECT n_nationkey::BIGINT AS qid, 2000000000 + n_nationkey AS nid, 1000000000 + n_regionkey AS rid, lower(n_name) AS q FROM nation),
kws AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rn FROM (SELECT qid, id, max(CASE WHEN lower(name) = q THEN 10
  WHEN contains(lower(name), q) THEN 5 WHEN lower(alias) = q THEN 6 WHEN contains(lower(alias), q) THEN 3 ELSE 0 END) AS s
  FROM nat, ent LEFT JOIN ali ON entity_id = id GROUP BY qid, id) WHERE s > 0),
eds AS (SELECT qid, source_id, target_id, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rn FROM nat JOIN rel ON target_id = nid AND category = '空间'),
ego AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id <> nid, id) AS rn FROM (SELECT qid, nid, dst AS id FROM nat JOIN adj ON src = nid UNION ALL SELECT qid, nid, nid FROM nat)),
st AS (SELECT qid, 0 AS step, id FROM kws WHERE rn <= 10 UNION SELECT qid, 1, unnest([source_id, target_id]) FROM eds WHERE rn <= 50
  UNION SELECT qid, 2, unnest([nid, rid]) FROM nat UNION SELECT qid, 3, id FROM ego WHERE rn <= 100)"""


@query
def retrieval_status(spark, sf_dir):
    _, _, status = RT.run_retrieval_steps(store(spark, sf_dir), retrieval_steps(spark, sf_dir), *LIMITS)
    return status


ORACLES["retrieval_status"] = sql(ENT, REL, ALI, ADJ, _STEPS, body="""
SELECT qid, step, CASE step WHEN 0 THEN 'keyword' WHEN 1 THEN 'cypher' WHEN 2 THEN 'path' ELSE 'ego' END AS tool, 'ok' AS status, count(*)::BIGINT AS count FROM st GROUP BY qid, step""")


@query
def retrieval_entities(spark, sf_dir):
    ents, _, _ = RT.run_retrieval_steps(store(spark, sf_dir), retrieval_steps(spark, sf_dir), *LIMITS)
    return RT.merge_steps(ents, "id").select("qid", "id")


ORACLES["retrieval_entities"] = sql(ENT, REL, ALI, ADJ, _STEPS, body=" SELECT DISTINCT qid, id FROM st")


@query
def retrieval_context(spark, sf_dir):
    g = store(spark, sf_dir)
    ents, rels, _ = RT.run_retrieval_steps(g, retrieval_steps(spark, sf_dir), *LIMITS)
    return RT.answer_prompt(g, nation_questions(spark, sf_dir), RT.merge_steps(ents, "id"), RT.merge_steps(rels, "rel_id"), RT.SHOWN_ENTITIES, RT.SHOWN_RELATIONS)


@query
def customer_context(spark, sf_dir):
    """The prompt for a question about every customer: customer, nation and the relation between them."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    qid = F.col("c_custkey").cast("long").alias("qid")
    asked = c.select(qid, F.concat(F.lit("Where is "), "c_name").alias("text"))
    key = lambda col, kind: (F.col(col).cast("long") + kind * KIND).alias("id")
    members = c.select(qid, F.lit(0).alias("pos"), key("c_custkey", CUSTOMER)).union(c.select(qid, F.lit(1), key("c_nationkey", NATION)))
    rel = c.select(qid, F.lit(0).alias("pos"), (F.lit(3 * RKIND) + F.col("c_custkey").cast("long") * KIND + F.col("c_nationkey")).alias("rel_id"))
    return RT.answer_prompt(store(spark, sf_dir), asked, members, rel)


ORACLES["customer_context"] = sql(ENT, REL, body="""
SELECT c_custkey::BIGINT AS qid, '【用户问题】Where is ' || c_name || chr(10) || '【实体】' || a.name || '#' || a.id || '、' || b.name || '#' || b.id || chr(10) ||
 '【关系】' || a.name || '#id' || a.id || ' —[' || rel.name || ']→ ' || b.name AS prompt
FROM customer JOIN ent a ON a.id = 7000000000 + c_custkey JOIN rel ON rel.source_id = a.id JOIN ent b ON b.id = rel.target_id AND b.id = 2000000000 + c_nationkey""")


@query
def scan_by_name_relations(spark, sf_dir):
    _, rel = RT.scan_by_name(store(spark, sf_dir), nation_questions(spark, sf_dir), 10)
    return rel.select("qid", "rel_id")


ORACLES["scan_by_name_relations"] = sql(ENT, REL, body=""",
q AS (SELECT n_nationkey::BIGINT AS qid, 'How is ' || n_name || ' linked to ' || r_name AS text FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rn FROM q JOIN ent ON length(name) >= 2 AND contains(text, name))
SELECT DISTINCT qid, rel.id AS rel_id FROM h JOIN rel ON source_id = h.id OR target_id = h.id WHERE rn <= 10""")


@query
def judge_prompts(spark, sf_dir):
    g = store(spark, sf_dir)
    recs = R.recommend_for(g, ids_of(spark, sf_dir, "nation", "n_nationkey", NATION), limit=3, hub_degree=R.HUB_DEGREE)
    return I.judge_prompts(g, recs, "J").select("center", "rank", F.col("prompt").startswith("J\nA: ").alias("ok"))


ORACLES["judge_prompts"] = """SELECT (2000000000 + n_nationkey)::BIGINT AS center, r::INTEGER AS rank, true AS ok FROM nation, generate_series(1, 3) t(r)"""


# ---- export ---------------------------------------------------------------------------------------


@query
def export_triples(spark, sf_dir):
    return X.export_triples(store(spark, sf_dir))


_ATTR = """att AS (SELECT id, 0 AS pos, 'acctbal' AS k, CASE WHEN a = floor(a) THEN a::BIGINT::VARCHAR ELSE attributes->>'acctbal' END AS v,
    CASE WHEN a = floor(a) THEN 'xsd:integer' ELSE 'xsd:decimal' END AS d FROM (SELECT *, (attributes->>'acctbal')::DOUBLE AS a FROM ent WHERE id // 1000000000 = 5)
  UNION ALL SELECT id, 0, 'type', attributes->>'type', 'string' FROM ent WHERE id // 1000000000 = 6
  UNION ALL SELECT id, 1, 'size', attributes->>'size', 'xsd:integer' FROM ent WHERE id // 1000000000 = 6
  UNION ALL SELECT id, 0, 'segment', attributes->>'segment', 'string' FROM ent WHERE id // 1000000000 = 7)"""
_CLS = "CASE category WHEN '物理实体' THEN 'PhysicalEntity' WHEN '抽象实体' THEN 'AbstractEntity' ELSE 'TemporalEntity' END"
_RCLS = "CASE category WHEN '空间' THEN 'SpatialRelation' WHEN '互动' THEN 'InteractionRelation' ELSE 'BelongingRelation' END"
ORACLES["export_triples"] = sql(ENT, REL, ALI, _ATTR, body=f"""
SELECT 'kg:e' || id AS subject, 'rdf:type' AS predicate, 'kg:' || {_CLS} AS object, 'iri' AS datatype FROM ent
UNION ALL SELECT 'kg:e' || id, 'rdfs:label', name, '@zh' FROM ent UNION ALL SELECT 'kg:e' || id, 'kg:category', category, 'string' FROM ent
UNION ALL SELECT 'kg:e' || id, 'kg:createdAt', '2024-01-01T00:00:00.000Z', 'xsd:dateTime' FROM ent UNION ALL SELECT 'kg:e' || id, 'kg:source', '手工', 'string' FROM ent
UNION ALL SELECT 'kg:r' || id, 'rdf:type', 'kg:' || {_RCLS}, 'iri' FROM rel UNION ALL SELECT 'kg:r' || id, 'rdfs:label', name, '@zh' FROM rel
UNION ALL SELECT 'kg:r' || id, 'kg:category', category, 'string' FROM rel UNION ALL SELECT 'kg:r' || id, 'kg:subject', 'kg:e' || source_id, 'iri' FROM rel
UNION ALL SELECT 'kg:r' || id, 'kg:object', 'kg:e' || target_id, 'iri' FROM rel UNION ALL SELECT 'kg:r' || id, 'kg:confidence', confidence, 'string' FROM rel
UNION ALL SELECT 'kg:r' || id, 'kg:sourceRef', source_ref, 'string' FROM rel UNION ALL SELECT 'kg:r' || id, 'kg:createdAt', '2024-01-01T00:00:00.000Z', 'xsd:dateTime' FROM rel
UNION ALL SELECT 'kg:r' || id, 'kg:source', source, 'string' FROM rel UNION ALL SELECT 'kg:e' || entity_id, 'kg:alias', alias, 'string' FROM ali
UNION ALL SELECT 'kg:e' || id, 'kg:attribute', '_:a' || id || '_' || pos, 'iri' FROM att UNION ALL SELECT '_:a' || id || '_' || pos, 'kg:key', k, 'string' FROM att
UNION ALL SELECT '_:a' || id || '_' || pos, 'kg:value', v, d FROM att""")


@query
def turtle_blocks(spark, sf_dir):
    return X.turtle_blocks(store(spark, sf_dir))


_Q = '\'"\''
ORACLES["turtle_blocks"] = sql(ENT, REL, ALI, _ATTR, body=f""",
c AS (SELECT id, string_agg(t, ' ;' || chr(10) ORDER BY o, pos) AS t FROM (
  SELECT id, 0 AS o, pos, '    kg:attribute [ kg:key "' || k || '" ; kg:value "' || v || '"' || CASE WHEN d = 'string' THEN '' ELSE '^^' || d END || ' ]' AS t FROM att
  UNION ALL SELECT entity_id, 1, 0, '    kg:alias "' || alias || '"' FROM ali) GROUP BY id)
SELECT 'entity' AS kind, ent.id, 'kg:e' || ent.id || ' rdf:type kg:' || {_CLS} || ' ;' || chr(10) || '    rdfs:label "' || name || '"@zh ;' || chr(10) || '    kg:category "' || category ||
  '" ;' || chr(10) || '    kg:createdAt "2024-01-01T00:00:00.000Z"^^xsd:dateTime ;' || chr(10) || '    kg:source "手工"' || CASE WHEN c.t IS NULL THEN '' ELSE ' ;' || chr(10) || c.t END || ' .' || chr(10) AS block
FROM ent LEFT JOIN c ON c.id = ent.id
UNION ALL SELECT 'relation', id, 'kg:r' || id || ' rdf:type kg:' || {_RCLS} || ' ;' || chr(10) || '    rdfs:label "' || name || '"@zh ;' || chr(10) || '    kg:category "' || category || '" ;' || chr(10) ||
  '    kg:subject kg:e' || source_id || ' ;' || chr(10) || '    kg:object kg:e' || target_id || ' ;' || chr(10) || '    kg:confidence "' || confidence || '" ;' || chr(10) || '    kg:sourceRef "' || source_ref ||
  '" ;' || chr(10) || '    kg:createdAt "2024-01-01T00:00:00.000Z"^^xsd:dateTime ;' || chr(10) || '    kg:source "' || source || '" .' || chr(10) FROM rel""")


@query
def graph_json_rows(spark, sf_dir):
    rows = X.graph_json_rows(store(spark, sf_dir))
    return rows.select("kind", "id", F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.created_at").alias("created_at"))


ORACLES["graph_json_rows"] = sql(ENT, REL, body=""" SELECT 'entity' AS kind, id, name, '2024-01-01T00:00:00.000Z' AS created_at FROM ent
UNION ALL SELECT 'relation', id, name, '2024-01-01T00:00:00.000Z' FROM rel""")


@query
def import_graph(spark, sf_dir):
    """Old tables without the added columns: checked, upgraded, counted."""
    g = store(spark, sf_dir)
    old = {"entities": g.entities, "relations": g.relations.drop("confidence", "source_ref"), "op_logs": g.op_logs}
    new, report = X.import_graph(spark, old)
    n = new.relations.where("confidence = '确证' AND source_ref = ''").agg(F.count(F.lit(1)).alias("upgraded")).withColumn("one", F.lit(1))
    return report.withColumn("one", F.lit(1)).join(n, "one").drop("one")


ORACLES["import_graph"] = sql(ENT, REL, body=""" SELECT (SELECT count(*) FROM ent)::BIGINT AS entities, (SELECT count(*) FROM rel)::BIGINT AS relations,
 (SELECT count(*) FROM events)::BIGINT AS logs, (SELECT max(event_id) + 1 FROM events) AS version, (SELECT count(*) FROM rel)::BIGINT AS upgraded""")


# ---- streams --------------------------------------------------------------------------------------


def log_files(spark, sf_dir):
    path = new_path(spark, "logstream")
    store(spark, sf_dir).op_logs.repartitionByRange(4, "id").write.parquet(path)
    return path


def streamed(spark, moved, keys=()):
    """Newest rows of a running aggregate after all that is there has been read."""
    path = new_path(spark, "moved")
    ST.keep_moved(moved, path, new_path(spark, "stream"), {"availableNow": True}).awaitTermination()
    return ST.latest(spark, path, moved, keys)


@query
def stream_op_counts(spark, sf_dir):
    logs = ST.watch_changes(spark, log_files(spark, sf_dir), max_files=1)
    return streamed(spark, ST.stream_op_counts(logs), ["op_type", "source"])


ORACLES["stream_op_counts"] = sql(LOG, body=" SELECT op_type, source, count(*)::BIGINT AS n, max(id) AS last_id FROM log GROUP BY ALL")


@query
def stream_signature(spark, sf_dir):
    return streamed(spark, ST.change_signature(ST.watch_changes(spark, log_files(spark, sf_dir), max_files=1)))


ORACLES["stream_signature"] = "SELECT count(*)::BIGINT AS logs, max(event_id) + 1 AS version FROM events"
