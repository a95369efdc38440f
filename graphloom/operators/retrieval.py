"""Retrieval steps for many questions at once, and the context they give."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import recommend as R
from graphloom.operators import search as Q
from graphloom.operators import traverse as T
from graphloom.operators.frontier import union
from graphloom.operators.match import incident, resolve_keys, with_endpoint_names
from graphloom.session import materialize

#: Limits that queries pass where they want short results.
MAX_STEPS = 4
EDGE_ROWS = 50
KEYWORD_TOP = 10
EGO_NODES = 100
PATH_HOPS = 6
SHOWN_ENTITIES = 30
SHOWN_RELATIONS = 40


def match_edges_table(g: Graph, patterns: DataFrame, limit: int | None = None) -> DataFrame:
    """Edge patterns as data: (qid, step, rel_types array, conds array<struct<var,field,op,value>>) to
    (qid, step, relation_id, source_id, target_id), per pattern the first ``limit`` by relation id or all.

    Patterns meet relations by an equi-join on the type text; a pattern without types asks for every name.
    """
    typed = patterns.where("size(rel_types) > 0").withColumn("t", F.explode("rel_types")).withColumn("t", F.lower(F.trim("t")))
    names = g.relations.select(F.lower("name").alias("t")).distinct()
    free = patterns.where("coalesce(size(rel_types), 0) <= 0")
    if not free.isEmpty():
        free = free.withColumn("one", F.lit(1)).join(names.withColumn("one", F.lit(1)), "one").drop("one")
        typed = typed.unionByName(free.select(*typed.columns))
    rel = with_endpoint_names(g.relations, g.entities)
    rel = rel.withColumn("t", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("category")))))
    pick = lambda c: (F.when(c["var"] == "source", F.when(c["field"] == "name", F.col("a.name")).when(c["field"] == "category", F.col("a.category")).otherwise(F.col("a.source")))
                      .when(c["var"] == "target", F.when(c["field"] == "name", F.col("b.name")).when(c["field"] == "category", F.col("b.category")).otherwise(F.col("b.source")))
                      .otherwise(F.when(c["field"] == "name", F.col("name")).when(c["field"] == "category", F.col("category")).otherwise(F.col("source"))))
    holds = lambda c: F.coalesce(F.when(c["op"] == "=", pick(c) == c["value"]).otherwise(F.contains(pick(c), c["value"])), F.lit(False))
    hits = rel.join(typed, "t").where(F.forall(F.coalesce("conds", F.array().cast("array<struct<var:string,field:string,op:string,value:string>>")), holds))
    w = Window.partitionBy("qid", "step").orderBy("relation_id")
    # a relation whose name and category are both asked for comes twice
    hits = hits.select("qid", "step", F.col("id").alias("relation_id"), "source_id", "target_id").distinct()
    hits = hits.withColumn("rn", F.row_number().over(w))
    return hits if limit is None else hits.where(F.col("rn") <= limit)


def run_retrieval_steps(g: Graph, steps: DataFrame, max_steps: int | None = None, edge_rows: int | None = None,
                        keyword_top: int | None = None, ego_nodes: int | None = None):
    """(entities, relations, status) for steps (qid, step, tool, q, rel_types, conds, from, to, max, center, depth).

    One batch job per tool. Entities (qid, step, pos, id) and relations (qid, step, pos, rel_id) keep the
    order in which a step gives them; keyword steps give no relations. Steps from number ``max_steps`` on are not run
    and come back with status ``refused``; the other limits keep the first results of a step.
    """
    late = steps.where(F.lit(False) if max_steps is None else F.col("step") >= max_steps)
    steps = materialize(steps if max_steps is None else steps.where(F.col("step") < max_steps), "steps")
    tool = lambda name: steps.where(F.col("tool") == name)
    ents, rels = [], []

    kw = tool("keyword").select("qid", "step", F.col("q").alias("text"))
    texts = kw.select("text").distinct().withColumn("tid", F.xxhash64("text"))
    hits = Q.rank_scores(Q.keyword_search(g, texts.select(F.col("tid").alias("qid"), "text")), keyword_top)
    hits = kw.withColumn("tid", F.xxhash64("text")).join(hits.withColumnRenamed("qid", "tid"), "tid")
    ents.append(hits.select("qid", "step", F.col("rank").cast("long").alias("pos"), "id"))

    edges = materialize(match_edges_table(g, tool("cypher").select("qid", "step", "rel_types", "conds"), edge_rows), "edges")
    rels.append(edges.select("qid", "step", F.col("rn").cast("long").alias("pos"), F.col("relation_id").alias("rel_id")))
    both = edges.select("qid", "step", F.explode(F.array(
        F.struct((F.col("rn") * 2).cast("long").alias("pos"), F.col("source_id").alias("id")),
        F.struct((F.col("rn") * 2 + 1).cast("long").alias("pos"), F.col("target_id").alias("id")))).alias("x")).select("qid", "step", "x.*")
    ents.append(both.groupBy("qid", "step", "id").agg(F.min("pos").alias("pos")).select("qid", "step", "pos", "id"))

    p = tool("path").select("qid", "step", "from", "to", F.coalesce("max", F.lit(PATH_HOPS)).alias("max"))
    keys = resolve_keys(g, p.select(F.col("from").alias("key")).unionByName(p.select(F.col("to").alias("key"))))
    at = lambda c, out: keys.select(F.col("key").alias(c), F.col("id").alias(out), F.col("status").alias(f"{out}_status"))
    p = materialize(p.join(at("from", "source_id"), "from", "left").join(at("to", "target_id"), "to", "left"), "paths")
    found = T.shortest_paths(g, p.where("source_id IS NOT NULL AND target_id IS NOT NULL"), 12).where("found")
    found = p.join(found, ["source_id", "target_id"]).where("hops <= max")
    ents.append(found.select("qid", "step", F.posexplode("nodes").alias("pos", "id")).withColumn("pos", F.col("pos").cast("long")))
    rels.append(found.select("qid", "step", F.posexplode("path").alias("pos", "rel_id")).withColumn("pos", F.col("pos").cast("long")))

    c = tool("ego").select("qid", "step", F.col("center").alias("key"), "depth")
    c = materialize(c.join(resolve_keys(g, c.select("key")).select("key", F.col("id").alias("center"), "status"), "key", "left"), "egos")
    for bounded in (True, False):
        part = c.where(F.col("center").isNotNull() & (F.col("depth").isNotNull() if bounded else F.col("depth").isNull()))
        top = part.agg(F.max("depth")).first()[0] if bounded else None
        if (bounded and top is None) or (not bounded and part.isEmpty()):
            continue
        lv = T.ego_levels(g, part.select(F.col("center").alias("id")), top).join(g.entities.select("id"), "id", "left_semi")
        lv = part.join(lv, "center").where("depth IS NULL OR level <= depth")
        w = Window.partitionBy("qid", "step").orderBy("level", "id")
        lv = lv.withColumn("pos", F.row_number().over(w).cast("long")).select("qid", "step", "pos", "id")
        lv = materialize(lv if ego_nodes is None else lv.where(F.col("pos") <= ego_nodes), "ego")
        ents.append(lv)
        end = lambda col: lv.select("qid", "step", F.col("id").alias(col))
        inner = g.relations.join(end("source_id"), "source_id").join(end("target_id"), ["qid", "step", "target_id"], "left_semi")
        rels.append(inner.select("qid", "step", F.col("id").alias("pos"), F.col("id").alias("rel_id")))

    entities = materialize(union(ents).join(g.entities.select("id"), "id", "left_semi").select("qid", "step", "pos", "id"), "step_entities")
    relations = materialize(union(rels), "step_relations")
    unresolved = p.where("source_id IS NULL OR target_id IS NULL").select("qid", "step").unionByName(
        c.where("center IS NULL").select("qid", "step")).withColumn("bad", F.lit(True))
    n = entities.groupBy("qid", "step").agg(F.count(F.lit(1)).alias("count"))
    status = steps.select("qid", "step", "tool").join(unresolved, ["qid", "step"], "left").join(n, ["qid", "step"], "left").select(
        "qid", "step", "tool", F.when(F.col("bad"), "error").otherwise("ok").alias("status"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    refused = late.select("qid", "step", "tool", F.lit("refused").alias("status"), F.lit(0).cast("long").alias("count"))
    return entities, relations, status.unionByName(refused)


def merge_steps(rows: DataFrame, id_col: str) -> DataFrame:
    """First occurrence of every id per question, numbered in order of (step, pos)."""
    first = rows.groupBy("qid", id_col).agg(F.min(F.struct("step", "pos")).alias("m"))
    w = Window.partitionBy("qid").orderBy("m", id_col)
    return first.select("qid", id_col, (F.row_number().over(w) - 1).cast("long").alias("pos"))


def scan_by_name(g: Graph, questions: DataFrame, cap: int | None = None):
    """(hits, relations): entities named in the questions and all relations touching them."""
    hits = materialize(Q.mentions(questions, g.entities, cap), "hits")
    rel = incident(g.relations, hits).join(hits.select("qid", F.col("id").alias("key")), "key")
    return hits, rel.select("qid", F.col("id").alias("rel_id"), "source_id", "target_id", "name").distinct()


def _context_rows(g: Graph, entities: DataFrame, relations: DataFrame):
    """Merged step results with names, ends and relation names, written once."""
    e = materialize(entities.join(g.entities.select("id", "name"), "id"), "context")
    r = g.relations.select(F.col("id").alias("rel_id"), "source_id", "target_id", F.col("name").alias("rel"))
    return e, materialize(relations.join(r, "rel_id"), "context_rel")


def _prompt(questions: DataFrame, e: DataFrame, r: DataFrame, shown_entities: int | None, shown_relations: int | None) -> DataFrame:
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("name", F.lit("#"), F.col("id").cast("string")).alias("t")))), lambda x: x["t"]), "、")
    ent_text = (e if shown_entities is None else e.where(F.col("pos") < shown_entities)).groupBy("qid").agg(shown.alias("ents"))
    name = lambda c, out: e.select("qid", F.col("id").alias(c), F.col("name").alias(out))
    top = (r if shown_relations is None else r.where(F.col("pos") < shown_relations)).join(name("source_id", "s"), ["qid", "source_id"], "left").join(name("target_id", "t"), ["qid", "target_id"], "left")
    end = lambda n, i: F.coalesce(n, F.concat(F.lit("#"), F.col(i).cast("string")))
    line = F.concat(end("s", "source_id"), F.lit("#id"), F.col("source_id").cast("string"), F.lit(" —["), F.col("rel"), F.lit("]→ "), end("t", "target_id"))
    rel_text = top.select("qid", "pos", line.alias("t")).groupBy("qid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "；").alias("rels"))
    q = questions.join(ent_text, "qid", "left").join(rel_text, "qid", "left")
    none = lambda c: F.coalesce(c, F.lit("（无）"))
    return q.select("qid", F.concat(
        F.lit("【用户问题】"), F.col("text"), F.lit("\n【实体】"), none("ents"), F.lit("\n【关系】"), none("rels")).alias("prompt"))


def answer_prompt(g: Graph, questions: DataFrame, entities: DataFrame, relations: DataFrame,
                  shown_entities: int | None = None, shown_relations: int | None = None) -> DataFrame:
    """(qid, prompt) alone, for callers that ask for nothing else of :func:`answer_context`."""
    return _prompt(questions, *_context_rows(g, entities, relations), shown_entities, shown_relations)


def answer_context(g: Graph, questions: DataFrame, entities: DataFrame, relations: DataFrame, answers: DataFrame | None = None,
                   shown_entities: int | None = None, shown_relations: int | None = None):
    """Prompt text, co-neighbors, bridges and evidence paths per question.

    ``entities`` (qid, pos, id) and ``relations`` (qid, pos, rel_id) are merged step results; the prompt
    shows the first ``shown_entities`` and ``shown_relations``, or all.
    """
    e, r = _context_rows(g, entities, relations)
    prompt = _prompt(questions, e, r, shown_entities, shown_relations)
    members = e.select(F.col("qid").alias("set_id"), "pos", "id", "name")
    co = R.co_neighbors(g, members).withColumnRenamed("set_id", "qid")
    br = R.bridges(g, members).withColumnRenamed("set_id", "qid")
    ev = T.evidence_paths(members, r.select(F.col("qid").alias("set_id"), F.col("pos").alias("rpos"), "rel_id", "source_id", "target_id"),
                          None if answers is None else answers.withColumnRenamed("qid", "set_id")).withColumnRenamed("set_id", "qid")
    return prompt, co, br, ev
