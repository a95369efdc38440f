"""Documents to chunks, model outputs to candidates, candidates to changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import jsontext as J
from graphloom.functions.text import strip
from graphloom.graph import Graph
from graphloom.operators import changes as C
from graphloom.operators.frontier import union
from graphloom.session import materialize, ship_package

CHUNK_CHARS = 3000
SENTENCE_CHARS = 1400
MAX_CHUNKS = 40
MAX_ALIASES = 10
# Fixed value: sentence ends.
SENTENCE_END = r"(?<=[。！？.!?\n])"
DEFAULT_EXTRACT_TEMPLATE = (
    "Read the text and answer with one JSON object only: "
    '{"entities":[{"name","category","attributes","aliases"}],"relations":[{"from","to","name","category","confidence"}]}. '
    "Entity categories: " + "|".join(S.ENTITY_CATEGORIES) + ". Relation categories: " + "|".join(S.RELATION_CATEGORIES)
    + ". Confidence: " + "|".join(S.CONFIDENCES) + ". State only what the text says.\n\n"
)


def _state(cur, out):
    return F.struct(cur.alias("cur"), out.alias("out"))


def _emit(out, text):
    return F.when(text != "", F.concat(out, F.array(text))).otherwise(out)


def _texts():
    return F.array().cast("array<string>")


def chunk_documents(docs: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk_idx, chunk): paragraphs packed up to ``size`` characters; a longer one is cut hard.

    Whole texts are folded inside the row; nothing leaves the JVM.
    """
    paras = F.filter(F.transform(F.split("text", r"\n{2,}"), strip), lambda p: p != "")

    def step(acc, p):
        cur, out = acc["cur"], acc["out"]
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: p.substr(i * size + 1, F.lit(size)))
        cut = _state(F.lit(""), F.concat(_emit(out, cur), pieces))
        start = _state(p, _emit(out, cur))
        grow = _state(F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p)), out)
        return F.when(F.length(p) > size, cut).when(F.length(cur) + 2 + F.length(p) > size, start).otherwise(grow)

    folded = F.aggregate(paras, _state(F.lit(""), _texts()), step, lambda acc: _emit(acc["out"], acc["cur"]))
    return docs.select("doc_id", F.posexplode(folded).alias("chunk_idx", "chunk"))


def chunk_sentences(docs: DataFrame, size: int = SENTENCE_CHARS) -> DataFrame:
    """(doc_id, chunk_idx, chunk): paragraphs over 1.5 sizes are cut at sentence ends, the tail joins the
    next paragraph; others are packed."""

    def flush(out, cur):
        return _emit(out, strip(cur))

    def sentence(acc, s):
        cur, out = acc["cur"], acc["out"]
        full = (F.length(cur) + F.length(s) > size) & (cur != "")
        return F.when(full, _state(s, flush(out, cur))).otherwise(_state(F.concat(cur, s), out))

    def step(acc, p):
        cur, out = acc["cur"], acc["out"]
        cut = F.aggregate(F.split(p, SENTENCE_END), _state(F.lit(""), flush(out, cur)), sentence)
        start = _state(p, flush(out, cur))
        grow = _state(F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p)), out)
        return F.when(F.length(p) > size * 1.5, cut).when((F.length(cur) + F.length(p) > size) & (cur != ""), start).otherwise(grow)

    folded = F.aggregate(
        F.split("text", r"\n{2,}"), _state(F.lit(""), _texts()), step, lambda acc: flush(acc["out"], acc["cur"]))
    return docs.select("doc_id", F.posexplode(folded).alias("chunk_idx", "chunk"))


def oversized_documents(chunks: DataFrame, cap: int = MAX_CHUNKS) -> DataFrame:
    """Documents refused for having more than ``cap`` chunks."""
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")).where(F.col("chunks") > cap)


def extract_prompts(chunks: DataFrame, template: str = DEFAULT_EXTRACT_TEMPLATE) -> DataFrame:
    return chunks.withColumn("prompt", F.concat(F.lit(template), F.col("chunk")))


def judge_prompts(g: Graph, recs: DataFrame, head: str = "Is there a relation worth storing between A and B? Answer with one JSON object.",
                  attribute_chars: int | None = None) -> DataFrame:
    """Prompt per recommended pair: both entities, attributes (cut to ``attribute_chars`` if given), common names."""
    attrs = F.col("attributes") if attribute_chars is None else F.substring("attributes", 1, attribute_chars)
    shown = F.concat(F.col("name"), F.lit("（"), F.col("category"), F.lit("）"), F.when(
        F.col("attributes") != "{}", F.concat(F.lit(" "), attrs)).otherwise(""))
    end = lambda c, out: g.entities.select(F.col("id").alias(c), shown.alias(out))
    df = recs.join(end("source_id", "_a"), "source_id").join(end("target_id", "_b"), "target_id")
    common = F.when(F.size("common_names") > 0, F.concat(F.lit("\ncommon: "), F.array_join("common_names", "、"))).otherwise("")
    return df.select(*recs.columns, F.concat(F.lit(head + "\nA: "), "_a", F.lit("\nB: "), "_b", common).alias("prompt"))


def answer_table(prompts: DataFrame, fn) -> DataFrame:
    """Model answers for a prompt column from ``fn(list of prompts) -> list of texts``, run inside the tasks."""
    import pandas as pd

    def answer(batches):
        for pdf in batches:
            yield pdf.assign(text=pd.Series(fn(pdf["prompt"].tolist()), index=pdf.index, dtype="object"))

    ship_package(prompts.sparkSession)
    return prompts.mapInPandas(answer, prompts.withColumn("text", F.lit("")).schema)


def parse_model_json(outputs: DataFrame) -> DataFrame:
    """Adds ``json``, the object text of each output; NULL when unreadable."""
    return J.with_tolerant_json(outputs, "text")


def normalize_candidates(parsed: DataFrame, max_aliases: int | None = None):
    """(entities, relations) of (doc_id, chunk_idx, filename, json) rows with defaults filled in.

    Attribute keys come in sorted order, as parsed objects hold them.
    """
    # written before the filter, which would be pushed below the reading of the texts and repeat it
    v = materialize(parsed.select("doc_id", "chunk_idx", "filename", "json"), "parsed").where("json IS NOT NULL")
    v = v.withColumn("v", F.try_parse_json("json"))
    one_of = lambda c, allowed, other: F.when(c.isin(allowed), c).otherwise(F.lit(other))
    e = v.select("doc_id", "chunk_idx", F.posexplode(J.elements(F.col("v"), "entities")).alias("pos", "e"))
    x = F.col("e")
    attrs = J.field(x, "attributes")
    aliases = F.filter(F.transform(J.elements(x, "aliases"), lambda a: F.when(
        J.is_kind(a, "STRING"), strip(F.try_variant_get(a, "$", "string")))), lambda a: a != "")
    entities = e.select(
        "doc_id", "chunk_idx", "pos", J.string_field(x, "name").alias("name"),
        one_of(F.try_variant_get(x, "$.category", "string"), S.ENTITY_CATEGORIES, S.DEFAULT_CANDIDATE_ENTITY_CATEGORY).alias("category"),
        F.when(J.is_kind(attrs, "OBJECT"), F.to_json(attrs)).otherwise("{}").alias("attributes"),
        (aliases if max_aliases is None else F.slice(aliases, 1, max_aliases)).alias("aliases")).where("name <> ''")
    ref = F.concat(F.lit("《"), "filename", F.lit("》片段"), (F.col("chunk_idx") + 1).cast("string"))
    r = v.select("doc_id", "chunk_idx", ref.alias("source_ref"), F.posexplode(J.elements(F.col("v"), "relations")).alias("pos", "r"))
    y = F.col("r")
    relations = r.select(
        "doc_id", "chunk_idx", "pos", J.string_field(y, "from").alias("from"), J.string_field(y, "to").alias("to"),
        J.string_field(y, "name").alias("name"),
        one_of(F.try_variant_get(y, "$.category", "string"), S.RELATION_CATEGORIES, S.DEFAULT_CANDIDATE_RELATION_CATEGORY).alias("category"),
        one_of(F.try_variant_get(y, "$.confidence", "string"), S.CONFIDENCES, S.GUESSED_CONFIDENCE).alias("confidence"), "source_ref",
    ).where("`from` <> '' AND `to` <> '' AND name <> ''")
    return entities, relations


def merge_candidate_entities(cands: DataFrame) -> DataFrame:
    """One candidate per (doc_id, name): first category, first value per attribute key, aliases in order."""
    c = materialize(cands, "candidates").withColumn("ord", F.struct("chunk_idx", "pos"))
    key = ["doc_id", "name"]
    head = c.groupBy(*key).agg(F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category"))
    value = F.when(F.col("v").isNull(), F.lit("null")).otherwise(F.to_json("v"))
    attrs = c.select(*key, "ord", F.explode(F.try_variant_get(F.try_parse_json("attributes"), "$", "map<string,variant>")).alias("k", "v"))
    attrs = attrs.groupBy(*key, "k").agg(F.min_by(F.struct("ord", value.alias("t")), "ord").alias("m"))
    text = lambda x: F.concat(F.to_json(F.array(x["k"])).substr(F.lit(2), F.length(F.to_json(F.array(x["k"]))) - 2), F.lit(":"), x["t"])
    attrs = attrs.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("m.ord", "k", "m.t"))), text), ","), F.lit("}")).alias("attributes"))
    al = c.select(*key, "ord", F.posexplode("aliases").alias("i", "alias")).groupBy(*key, "alias").agg(F.min(F.struct("ord", "i")).alias("m"))
    al = al.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return head.join(attrs, key, "left").join(al, key, "left").select(
        "doc_id", "ord.chunk_idx", "ord.pos", "name", "category", F.coalesce("attributes", F.lit("{}")).alias("attributes"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def dedup_candidate_relations(cands: DataFrame) -> DataFrame:
    """First relation per (doc_id, from, name, to)."""
    rest = ["chunk_idx", "pos", "category", "confidence", "source_ref"]
    best = cands.groupBy("doc_id", "from", "name", "to").agg(F.min(F.struct(*rest)).alias("m"))
    return best.select("doc_id", "m.chunk_idx", "m.pos", "from", "to", "name", "m.category", "m.confidence", "m.source_ref")


def name_index(g: Graph, texts: DataFrame) -> DataFrame:
    """(key, entity_id) for the texts that name a stored entity: latest main name, else alias owner."""
    main = g.entities.join(texts, F.col("name") == F.col("key"), "left_semi").groupBy(F.col("name").alias("key")).agg(F.max("id").alias("by_name"))
    other = g.aliases.join(texts, F.col("alias") == F.col("key"), "left_semi").groupBy(F.col("alias").alias("key")).agg(F.min("entity_id").alias("by_alias"))
    return main.join(other, "key", "full").select("key", F.coalesce("by_name", "by_alias").alias("entity_id"))


def match_candidates(g: Graph, entities: DataFrame, relations: DataFrame):
    """(entities, relations) with links to stored entities, duplicates of earlier candidates and endpoints.

    A candidate is looked up among stored names, then among names and aliases of earlier candidates that
    are new themselves. Whether a candidate is new depends on the earlier ones that list its name, so
    candidates settle in rounds; a round settles all whose earlier ones are settled.
    """
    e = materialize(entities.withColumn("ord", F.col("chunk_idx").cast("long") * 1_000_000 + F.col("pos")), "cand")
    rel = materialize(relations, "cand_rel")
    texts = union([e.select(F.col("name").alias("key")), rel.select(F.col("from").alias("key")), rel.select(F.col("to").alias("key"))]).distinct()
    known = materialize(name_index(g, texts), "known")
    e = e.join(known.withColumnRenamed("key", "name"), "name", "left")
    fresh = materialize(e.where("entity_id IS NULL").select("doc_id", "ord", "name", "aliases"), "fresh")
    claims = fresh.select("doc_id", F.col("ord").alias("by"), F.explode("aliases").alias("name"))
    waits = materialize(fresh.join(claims, ["doc_id", "name"]).where("by < ord").select("doc_id", "ord", "by").distinct(), "waits")
    new = [fresh.join(waits, ["doc_id", "ord"], "left_anti").select("doc_id", "ord")]
    dup = []
    left = waits
    while not left.isEmpty():
        settled_new = materialize(union(new), "new")
        new = [settled_new]
        done = settled_new if not dup else settled_new.unionByName(union([d.select("doc_id", "ord") for d in dup]))
        by = lambda df: df.withColumnRenamed("ord", "by")
        stuck = left.join(by(done), ["doc_id", "by"], "left_anti").select("doc_id", "ord").distinct()
        ready = left.join(stuck, ["doc_id", "ord"], "left_anti")
        hit = ready.join(by(settled_new), ["doc_id", "by"], "left_semi").groupBy("doc_id", "ord").agg(F.min("by").alias("dupe_of"))
        hit = materialize(hit, "dup")
        dup.append(hit)
        new.append(ready.select("doc_id", "ord").distinct().join(hit, ["doc_id", "ord"], "left_anti"))
        left = materialize(left.join(stuck, ["doc_id", "ord"], "left_semi"), "waits")
    registered = fresh.join(union(new), ["doc_id", "ord"], "left_semi")
    own = registered.select("doc_id", "ord", F.explode(F.concat(F.array("name"), "aliases")).alias("key"))
    own = materialize(own.groupBy("doc_id", "key").agg(F.min("ord").alias("cand")), "own")
    dups = union(dup) if dup else None
    out_e = e.withColumn("dupe_of", F.lit(None).cast("long")) if dups is None else e.join(dups, ["doc_id", "ord"], "left")
    out_e = out_e.withColumnRenamed("entity_id", "existing_id").withColumn("dupe_of_candidate", F.col("dupe_of").isNotNull())
    out_r = rel
    for side in ("from", "to"):
        out_r = out_r.join(known.select(F.col("key").alias(side), F.col("entity_id").alias(f"{side}_id")), side, "left").join(
            own.select("doc_id", F.col("key").alias(side), F.col("cand").alias(f"{side}_cand")), ["doc_id", side], "left")
    unresolved = lambda s: F.col(f"{s}_id").isNull() & F.col(f"{s}_cand").isNull()
    return out_e, out_r.withColumn("unresolved", unresolved("from") | unresolved("to"))


def commit_candidates(g: Graph, entities: DataFrame, relations: DataFrame, marks: dict | None = None):
    """(graph, per-document counts, error): apply matched candidates with a true ``selected`` as one batch.

    Selected new entities are added with their aliases, linked ones get their aliases, relations need two
    different resolved ends. Rows without ``selected`` count as selected.
    """
    sel = lambda df: df.where("selected") if "selected" in df.columns else df
    e = materialize(sel(entities).where("NOT dupe_of_candidate"), "chosen")
    ref = lambda d, o: F.concat(F.col(d).cast("string"), F.lit("|"), F.col(o).cast("string"))
    add = e.where("existing_id IS NULL").select(
        "doc_id", F.col("ord"), F.lit("add_entity").alias("op"), ref("doc_id", "ord").alias("ref"), "name", "category", "attributes", "aliases")
    r = relations.where("NOT unresolved")
    want = F.col("selected") if "selected" in relations.columns else F.lit(True)
    live = add.select("doc_id", F.col("ord").alias("c"), F.lit(True).alias("there"))
    for s in ("from", "to"):
        r = r.join(live.select("doc_id", F.col("c").alias(f"{s}_cand"), F.col("there").alias(f"{s}_there")), ["doc_id", f"{s}_cand"], "left")
        r = r.withColumn(f"{s}_ok", F.col(f"{s}_id").isNotNull() | F.col(f"{s}_there"))
    differ = ~(F.coalesce(F.col("from_id") == F.col("to_id"), F.lit(False))
               | (F.col("from_id").isNull() & F.col("to_id").isNull() & F.coalesce(F.col("from_cand") == F.col("to_cand"), F.lit(False))))
    use = F.coalesce(want & F.col("from_ok") & F.col("to_ok"), F.lit(False)) & differ & (F.length("name") <= 200) & (F.length("source_ref") <= 500)
    r = materialize(r.withColumn("use", use), "chosen_rel")
    pick = lambda s: F.when(F.col(f"{s}_id").isNull(), ref("doc_id", f"{s}_cand"))
    rel = r.where("use").select(
        "doc_id", (F.col("chunk_idx").cast("long") * 1_000_000 + F.col("pos")).alias("ord"), F.lit("add_relation").alias("op"),
        F.col("from_id").alias("source_id"), F.col("to_id").alias("target_id"), pick("from").alias("source_key_ref"),
        pick("to").alias("target_key_ref"), "name", "category", "confidence", F.col("source_ref").alias("evidence_ref"))
    ops = add.withColumn("kind", F.lit(0)).unionByName(rel.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    ops = C._numbered(ops, ["doc_id", "kind", "ord"], 0, "op_idx")
    done = C.apply_ops(g, ops, source="文档", marks=marks)
    if done.error:
        return g, None, done.error
    out = done.graph
    linked = e.where("existing_id IS NOT NULL")
    more = linked.select("existing_id", F.col("doc_id"), F.col("ord"), F.explode("aliases").alias("alias"))
    if not more.isEmpty():
        req = C._numbered(more, ["doc_id", "ord", "alias"], 0, "req_idx").select("req_idx", F.col("existing_id").alias("entity_id"), "alias")
        out = C.commit_aliases(out, C.add_aliases(out, req), marks=done.high_water)
    n = lambda df, test, c: df.groupBy("doc_id").agg(F.count(F.when(test, 1)).alias(c))
    counts = n(e, F.col("existing_id").isNull(), "entities_added").join(n(e, F.col("existing_id").isNotNull(), "entities_linked"), "doc_id", "full")
    counts = counts.join(n(r, F.col("use"), "relations_added"), "doc_id", "full").join(n(r, ~F.col("use"), "relations_skipped"), "doc_id", "full")
    return out, counts.fillna(0), None


def ingest_task_summary(chunks: DataFrame, parsed: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per document: chunk total, failed chunks, candidate counts, status."""
    n = lambda df, c: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    bad = parsed.where("json IS NULL")
    out = n(chunks, "chunks_total")
    for df, c in ((bad, "failed_chunks"), (entities, "entity_count"), (relations, "relation_count")):
        out = out.join(n(df, c), "doc_id", "left")
    out = out.fillna(0)
    return out.withColumn("status", F.when((F.col("entity_count") + F.col("relation_count")) > 0, "review").otherwise("failed"))


def doc_import_report(chunks: DataFrame, applied: DataFrame, errors: DataFrame) -> DataFrame:
    """Per document: chunks, chunks without an error, entities and relations added, other changes.

    ``applied`` (doc_id, op), ``errors`` (doc_id, chunk_idx)."""
    count = lambda test, c: F.count(F.when(test, 1)).alias(c)
    a = applied.groupBy("doc_id").agg(
        count(F.col("op") == "add_entity", "entities_added"), count(F.col("op") == "add_relation", "relations_added"),
        count(~F.col("op").isin("add_entity", "add_relation"), "others"))
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    e = errors.select("doc_id", "chunk_idx").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("bad"))
    out = c.join(a, "doc_id", "left").join(e, "doc_id", "left").fillna(0)
    return out.select("doc_id", "chunks", (F.col("chunks") - F.col("bad")).alias("chunks_ok"), "entities_added", "relations_added", "others")


# Fixed value: fence that marks blocks of operations.
OPS_BLOCK = r"```kg-ops\s*([\s\S]*?)```"


def parse_ops_blocks(texts: DataFrame):
    """(operations, replies) of (msg_id, text): every element of every fenced block, in order, and the text
    without the blocks together with the last parse error."""
    b = texts.select("msg_id", F.posexplode(F.regexp_extract_all("text", F.lit(OPS_BLOCK))).alias("block", "raw"))
    b = b.withColumn("v", J.json_value(strip(F.col("raw"))))
    ok = J.is_kind(F.col("v"), "ARRAY")
    items = b.where(ok).select("msg_id", "block", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "op"))
    text = lambda c: F.try_variant_get("op", f"$.{c}", "string").alias(c)
    whole = lambda c: F.try_variant_get("op", f"$.{c}", "long").alias(c)
    # on the wire source_ref/target_ref are placeholders for additions and evidence text for updates
    is_add = F.try_variant_get("op", "$.op", "string") == "add_relation"
    key = lambda c: F.when(is_add, F.try_variant_get("op", f"$.{c}_ref", "string")).alias(f"{c}_key_ref")
    evidence = F.when(is_add, F.try_variant_get("op", "$.evidence_ref", "string")).otherwise(F.try_variant_get("op", "$.source_ref", "string"))
    rows = items.select(
        "msg_id", "block", "i", text("op"), whole("id"), text("ref"), text("name"), text("category"),
        F.to_json(J.field(F.col("op"), "attributes")).alias("attributes"), F.try_variant_get("op", "$.aliases", "array<string>").alias("aliases"),
        whole("source_id"), whole("target_id"), key("source"), key("target"), text("source_name"), text("target_name"),
        text("confidence"), evidence.alias("evidence_ref"))
    error = F.when(F.col("v").isNull(), "kg-ops块JSON解析失败").when(~ok, "kg-ops块必须是JSON数组")
    bad = b.select("msg_id", "block", error.alias("error")).where("error IS NOT NULL").groupBy("msg_id").agg(F.max_by("error", "block").alias("parse_error"))
    replies = texts.select("msg_id", strip(F.regexp_replace("text", OPS_BLOCK, "")).alias("reply")).join(bad, "msg_id", "left")
    return rows, replies


def parse_event_lines(lines: DataFrame):
    """(texts, errors, sessions) of agent output (run_id, line_no, line).

    Texts and errors stay rows in line order; a session is the first id seen in a run."""
    v = lines.select("run_id", "line_no", J.json_value(strip(F.col("line"))).alias("v")).where(J.is_kind(F.col("v"), "OBJECT"))
    x = F.col("v")
    kind = F.try_variant_get(x, "$.type", "string")
    single = F.when(kind == "text", F.try_variant_get(x, "$.part.text", "string"))
    own, nested = J.field(x, "parts"), F.try_variant_get(x, "$.message.parts", "array<variant>")
    parts = F.when(own.isNotNull(), J.elements(x, "parts")).otherwise(F.coalesce(nested, F.array().cast("array<variant>")))
    listed = F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string")))
    texts = v.select("run_id", "line_no", F.posexplode(F.filter(F.concat(F.array(single), listed), lambda t: t != "")).alias("part", "text"))
    message = F.coalesce(F.try_variant_get(x, "$.error.data.message", "string"), F.try_variant_get(x, "$.error.message", "string"), F.lit("未知错误"))
    ref = F.try_variant_get(x, "$.error.data.ref", "string")
    message = F.when(ref != "", F.concat(message, F.lit("（ref:"), ref, F.lit("）"))).otherwise(message)
    errors = v.where(kind == "error").select("run_id", "line_no", message.alias("error"))
    sid = F.try_variant_get(x, "$.sessionID", "string")
    sessions = v.select("run_id", "line_no", sid.alias("sid")).where("sid <> ''").groupBy("run_id").agg(F.min_by("sid", "line_no").alias("session_id"))
    return texts, errors, sessions


def validate_judgements(outputs: DataFrame, name_chars: int | None = None, evidence_chars: int | None = None) -> DataFrame:
    """Checked fields of (…, text) judgement outputs: has_relation, name, category, confidence, evidence, error."""
    df = outputs.withColumn("_j", J.strict_json(F.col("text"))).withColumn("_v", F.try_parse_json("_j.json"))
    v = F.col("_v")
    has = J.truthy(v, "has_relation")
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    name = cut(strip(J.text_field(v, "name")), name_chars)
    cat = F.try_variant_get(v, "$.category", "string")
    conf = F.try_variant_get(v, "$.confidence", "string")
    error = (F.when(F.col("_j.error").isNotNull(), F.concat(F.lit("LLM输出无法解析: "), F.col("_j.error")))
             .when(has & (name == ""), "has_relation为true时关系名不能为空")
             .when(has & ~F.coalesce(cat.isin(S.RELATION_CATEGORIES), F.lit(False)), "关系大类必须是: " + "/".join(S.RELATION_CATEGORIES)))
    good = has & error.isNull()
    return df.select(
        *outputs.columns, F.when(error.isNull(), has).alias("has_relation"), F.when(good, name).alias("name"), F.when(good, cat).alias("category"),
        F.when(good, F.when(conf.isin(S.CONFIDENCES), conf).otherwise(S.GUESSED_CONFIDENCE)).alias("confidence"),
        F.when(good, cut(strip(J.text_field(v, "evidence")), evidence_chars)).alias("evidence"), error.alias("error"))


STEP_TOOLS = ["keyword", "cypher", "path", "ego"]
MAX_STEPS = 4


def validate_plans(outputs: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``errors`` to retrieval plans given as text."""
    df = outputs.withColumn("_j", J.strict_json(F.col("text"))).withColumn("_v", F.try_parse_json("_j.json"))
    steps = J.elements(F.col("_v"), "steps")

    def check(s, i):
        no = (i + 1).cast("string")
        tool = F.try_variant_get(s, "$.tool", "string")
        need = lambda good, msg: F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("步骤"), no, F.lit(": " + msg)))
        filled = lambda c: J.string_field(s, c) != ""
        ranged = lambda c, lo, hi: J.field(s, c).isNull() | J.integer_field(s, c).between(lo, hi)
        text = F.try_variant_get(s, "$.query", "string")
        by_tool = (
            F.when(tool == "keyword", F.array(need(filled("q"), "keyword需要非空q(字符串)")))
            .when(tool == "cypher", F.array(need(
                J.is_kind(J.field(s, "query"), "STRING") & text.rlike(r"(?i)^\s*MATCH") & text.rlike("(?i)RETURN"),
                "cypher需要形如 MATCH (a)-[r]->(b) RETURN ... 的query")))
            .when(tool == "path", F.array(need(filled("from") & filled("to"), "path需要非空from与to"), need(ranged("max", 1, 12), "path.max须为1-12整数")))
            .when(tool == "ego", F.array(need(filled("center"), "ego需要非空center"), need(ranged("depth", 1, 6), "ego.depth须为1-6整数")))
            .otherwise(F.array(F.concat(F.lit("步骤"), no, F.lit('工具"'), F.coalesce(tool, F.lit("undefined")), F.lit('"不在白名单: ' + "/".join(STEP_TOOLS)))))
        )
        return F.when(J.is_kind(s, "OBJECT"), by_tool).otherwise(F.array(F.concat(F.lit("步骤"), no, F.lit("必须是对象"))))

    many = F.when(F.size(steps) > MAX_STEPS, F.array(F.lit(f"步骤数不得超过{MAX_STEPS}"))).otherwise(F.array().cast("array<string>"))
    errors = F.concat(many, F.filter(F.flatten(F.transform(steps, check)), lambda m: m.isNotNull()))
    errors = (F.when(F.col("_j.error").isNotNull(), F.array("_j.error")).when(F.size(steps) == 0, F.array(F.lit("steps必须为非空数组"))).otherwise(errors))
    return df.withColumn("errors", errors).select(*outputs.columns, (F.size("errors") == 0).alias("ok"), "errors")


def plan_steps(outputs: DataFrame) -> DataFrame:
    """Steps of valid plans as rows: (qid, step, tool, q, query, from, to, max, center, depth)."""
    ok = validate_plans(outputs).where("ok")
    s = ok.select("qid", F.posexplode(J.elements(F.try_parse_json(J.strict_json(F.col("text"))["json"]), "steps")).alias("step", "s"))
    text = lambda c: F.try_variant_get("s", f"$.{c}", "string").alias(c)
    return s.select("qid", "step", text("tool"), text("q"), text("query"), text("from"), text("to"),
                    J.integer_field(F.col("s"), "max").alias("max"), text("center"), J.integer_field(F.col("s"), "depth").alias("depth"))


