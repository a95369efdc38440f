"""Batches of changes: one table of ordered operations becomes one new graph, or nothing changes.

Operations see the effect of earlier ones. Instead of running them one by one, every entity, relation,
name and placeholder gets a history ordered by operation number, and what an operation sees is the
value just before its number.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.text import iso_time, strip
from graphloom.graph import Graph
from graphloom.operators import validate as V
from graphloom.operators.frontier import union
from graphloom.session import discard, fixed_now, materialize, running, with_position

OP_KINDS = ["add_entity", "add_relation", "update_entity", "delete_entity", "update_relation", "delete_relation"]
ALIAS_STRIDE = 1_000_000
EFIELDS = ("name", "category", "attributes")
RFIELDS = V.RELATION_FIELDS
BAD = "OpenCode操作校验未通过: "
RULE = "RDF校验未通过: "


@dataclass(frozen=True)
class ApplyResult:
    """``error`` is None when the batch was applied; ``applied`` has one row per operation then."""

    graph: Graph
    applied: DataFrame | None
    error: str | None
    high_water: dict


def high_water(g: Graph) -> dict:
    """Highest id ever given per table; the log remembers ids of rows that are gone."""
    snap = F.from_json("snapshot", "struct<entity:struct<id:bigint>,relation:struct<id:bigint>,alias:struct<id:bigint>>")
    logged = g.op_logs.select("id", snap.alias("s")).agg(
        F.max("id").alias("op_logs"), F.max("s.entity.id").alias("entities"), F.max("s.relation.id").alias("relations"),
        F.max("s.alias.id").alias("aliases")).first()
    out = {"op_logs": logged["op_logs"] or 0}
    for t in ("entities", "relations", "aliases"):
        top = getattr(g, t).agg(F.max("id")).first()[0]
        out[t] = max(top or 0, logged[t] or 0)
    return out


def _first_error(errors: DataFrame):
    row = errors.where("message IS NOT NULL").orderBy("op_idx").limit(1).collect()
    return (row[0]["op_idx"], row[0]["op"], row[0]["message"]) if row else None


def _numbered(df: DataFrame, order: list, base: int, name: str, keep=None) -> DataFrame:
    return with_position(df, *order, name="_p", keep=keep).withColumn(name, F.col("_p") + base + 1).drop("_p")


def _join_errors(c):
    return F.when(F.size(c) > 0, F.concat(F.lit(RULE), F.array_join(c, "; ")))


def apply_ops(g: Graph, ops: DataFrame, source: str = "OpenCode", marks: dict | None = None) -> ApplyResult:
    """Apply the OPS table in order of ``op_idx`` (from 1). The first bad operation rejects the batch."""
    marks = dict(marks or high_water(g))
    now = fixed_now()
    have = set(ops.columns)
    ops = materialize(ops.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.OPS.fields]), "ops")
    pick = lambda kind: ops.where(F.col("op") == kind)

    # ---- entities: ids, lifetimes, history ------------------------------------------------------
    adds = materialize(_numbered(pick("add_entity"), ["op_idx"], marks["entities"], "eid"), "adds")
    deaths = pick("delete_entity").groupBy(F.col("id").alias("eid")).agg(F.min("op_idx").alias("death"))
    deaths = materialize(deaths, "deaths")
    births = adds.select("eid", F.col("op_idx").alias("birth"))
    upd = pick("update_entity").withColumnRenamed("id", "eid")
    touched = upd.select("eid").unionByName(deaths.select("eid")).distinct()
    base = g.entities.withColumnRenamed("id", "eid").join(touched, "eid", "left_semi")
    none = F.lit(None).cast("string")
    trim_name = F.when(strip(F.col("name")) != "", strip(F.col("name"))).alias("name")
    attrs = F.coalesce("attributes", F.lit("{}")).alias("attributes")
    hist = (
        base.select("eid", F.lit(0).cast("long").alias("op_idx"), F.lit("base").alias("what"), *EFIELDS)
        .unionByName(adds.select("eid", "op_idx", F.lit("add").alias("what"), trim_name, "category", attrs))
        .unionByName(upd.select("eid", "op_idx", F.lit("update").alias("what"), trim_name, "category", "attributes"))
        .unionByName(pick("delete_entity").select(
            F.col("id").alias("eid"), "op_idx", F.lit("delete").alias("what"), *[none.alias(c) for c in EFIELDS]))
    )
    hist = running(hist, "eid", "op_idx", last=EFIELDS)
    born = births.unionByName(base.select("eid", F.lit(0).cast("long").alias("birth")))
    hist = hist.join(born, "eid", "left").join(deaths, "eid", "left")
    hist = materialize(hist.select("*", *[F.coalesce(c, f"prev_{c}").alias(f"now_{c}") for c in EFIELDS]), "entity_history")

    # ---- aliases given with new entities ---------------------------------------------------------
    tries = adds.select("op_idx", "eid", strip(F.col("name")).alias("own"), F.posexplode("aliases").alias("j", "raw"))
    tries = tries.select("op_idx", "eid", "j", "own", strip(F.coalesce("raw", F.lit(""))).alias("alias")).where(
        "alias <> '' AND length(alias) <= 200 AND alias <> own")
    tries = tries.groupBy("op_idx", "eid", "alias").agg(F.min("j").alias("j"))
    tries = all_tries = materialize(tries.withColumn("idx", F.col("op_idx") * ALIAS_STRIDE + F.col("j")), "tries")
    uses = union([
        pick("add_relation").where(
            F.col(f"{e}_name").isNotNull() & F.col(f"{e}_id").isNull() & F.col(f"{e}_key_ref").isNull()
        ).select("op_idx", F.lit(e).alias("side"), strip(F.col(f"{e}_name")).alias("key")) for e in ("source", "target")])
    uses = materialize(uses, "uses")
    wanted = uses.select("key").unionByName(tries.select(F.col("alias").alias("key"))).distinct()

    # names: stored ones at 0, then additions, renames and deletions
    big = "decimal(38,0)"
    named = g.entities.join(wanted, F.col("name") == F.col("key")).select("key", F.lit(0).cast("long").alias("op_idx"), F.lit(1).alias("n"), F.col("id").cast(big).alias("s"))
    alive = F.col("birth").isNotNull()
    plus = hist.where(alive & (F.col("what").isin("add", "update"))).where(
        "now_name IS NOT NULL AND (prev_name IS NULL OR now_name <> prev_name)").select(
        F.col("now_name").alias("key"), "op_idx", F.lit(1).alias("n"), F.col("eid").cast(big).alias("s"))
    minus = hist.where(alive & (
        ((F.col("what") == "update") & (F.col("now_name") != F.col("prev_name"))) | (F.col("what") == "delete"))).select(
        F.col("prev_name").alias("key"), "op_idx", F.lit(-1).alias("n"), (-F.col("eid")).cast(big).alias("s"))
    name_events = union([named, plus, minus]).join(wanted, "key", "left_semi")
    taken = g.aliases.join(wanted, F.col("alias") == F.col("key")).select("key", F.col("entity_id").alias("eid"))
    taken = taken.join(g.entities.select(F.col("id").alias("eid")), "eid", "left_semi").join(deaths, "eid", "left")
    taken = materialize(taken, "taken")

    asked = tries.select(F.col("alias").alias("key"), "op_idx").distinct().select("key", "op_idx", F.lit(0).alias("n"), F.lit(0).cast(big).alias("s"))
    state = running(
        name_events.unionByName(asked).groupBy("key", "op_idx").agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
        "key", "op_idx", sums=("n",))
    free = state.where("prev_n = 0").select(F.col("key").alias("alias"), "op_idx")
    tries = materialize(tries.join(free, ["alias", "op_idx"], "left_semi").join(deaths, "eid", "left"), "free_tries")
    # the earliest try after the last owner is gone wins; a further round is needed only if that owner dies too
    gone = taken.groupBy(F.col("key").alias("alias")).agg(
        F.max(F.coalesce("death", F.lit(2**62))).alias("until"))
    free_tries, got = tries, []
    while True:
        left = tries.join(gone, "alias", "left").where("until IS NULL OR op_idx > until")
        win = left.groupBy("alias").agg(F.min("idx").alias("idx"))
        win, n = materialize(tries.join(win, ["alias", "idx"], "left_semi"), "won", counted=True)
        if n == 0:
            break
        got.append(win)
        dying = win.where("death IS NOT NULL").select("alias", F.col("death").alias("until"))
        if dying.isEmpty():
            break
        tries = tries.join(dying.select("alias"), "alias", "left_semi")
        gone = dying
    new_aliases = union(got) if got else tries.where(F.lit(False))
    new_aliases = materialize(_numbered(new_aliases.select("op_idx", "eid", "j", "idx", "alias", "death"), ["idx"], marks["aliases"], "id"), "new_aliases")

    # ---- endpoints of new relations --------------------------------------------------------------
    alias_events = union([
        taken.select("key", F.lit(0).cast("long").alias("op_idx"), F.lit(1).alias("n"), F.col("eid").cast(big).alias("s")),
        taken.where("death IS NOT NULL").select("key", F.col("death").alias("op_idx"), F.lit(-1).alias("n"), (-F.col("eid")).cast(big).alias("s")),
        new_aliases.select(F.col("alias").alias("key"), "op_idx", F.lit(1).alias("n"), F.col("eid").cast(big).alias("s")),
        new_aliases.where("death IS NOT NULL").select(
            F.col("alias").alias("key"), F.col("death").alias("op_idx"), F.lit(-1).alias("n"), (-F.col("eid")).cast(big).alias("s")),
    ])
    at_use = uses.select("key", "op_idx").distinct().select("key", "op_idx", F.lit(0).alias("n"), F.lit(0).cast(big).alias("s"))
    seen = running(
        union([name_events, alias_events, at_use]).groupBy("key", "op_idx").agg(F.sum("n").alias("n"), F.sum("s").cast(big).alias("s")),
        "key", "op_idx", sums=("n", "s"))
    by_name = uses.join(seen.select("key", "op_idx", "prev_n", "prev_s"), ["key", "op_idx"])
    refs = adds.where("ref IS NOT NULL").select(strip(F.col("ref")).alias("key"), "op_idx", "eid")
    ref_uses = union([
        pick("add_relation").where(F.col(f"{e}_key_ref").isNotNull()).select(
            strip(F.col(f"{e}_key_ref")).alias("key"), "op_idx") for e in ("source", "target")]).distinct()
    ref_seen = running(refs.unionByName(ref_uses.withColumn("eid", F.lit(None).cast("long"))), "key", "op_idx", last=("eid",))
    new_rel = _numbered(pick("add_relation"), ["op_idx"], marks["relations"], "rid")
    for e in ("source", "target"):
        n = by_name.where(F.col("side") == e).select("op_idx", F.col("prev_n").alias(f"{e}_n"), F.col("prev_s").cast("long").alias(f"{e}_by_name"))
        r = ref_seen.select(F.col("key").alias(f"{e}_k"), "op_idx", F.col("prev_eid").alias(f"{e}_by_ref"))
        new_rel = new_rel.join(n, "op_idx", "left").withColumn(f"{e}_k", strip(F.col(f"{e}_key_ref"))).join(r, ["op_idx", f"{e}_k"], "left")
        new_rel = new_rel.withColumn(f"{e}_end", F.when(F.col(f"{e}_n").isNotNull(), F.when(F.col(f"{e}_n") == 1, F.col(f"{e}_by_name")))
                                     .when(F.col(f"{e}_key_ref").isNotNull(), F.col(f"{e}_by_ref")).otherwise(F.col(f"{e}_id")))
    new_rel = materialize(new_rel, "new_relations")

    # ---- relations: history ----------------------------------------------------------------------
    upd_r = pick("update_relation").select(
        F.col("id").alias("rid"), "op_idx", "source_id", "target_id", trim_name, "category", "confidence", F.col("evidence_ref").alias("source_ref"))
    del_r = pick("delete_relation").select(F.col("id").alias("rid"), "op_idx")
    touched_r = upd_r.select("rid").unionByName(del_r.select("rid")).distinct()
    base_r = g.relations.withColumnRenamed("id", "rid").join(touched_r, "rid", "left_semi")
    zero = F.lit(0).cast("long").alias("op_idx")
    conf = F.when(F.coalesce("confidence", F.lit("")) == "", S.DEFAULT_CONFIDENCE).otherwise(F.col("confidence")).alias("confidence")
    rh = (
        base_r.select("rid", zero, F.lit("base").alias("what"), *RFIELDS)
        .unionByName(new_rel.select("rid", "op_idx", F.lit("add").alias("what"), F.col("source_end").alias("source_id"),
                                    F.col("target_end").alias("target_id"), trim_name, "category", conf,
                                    F.coalesce("evidence_ref", F.lit("")).alias("source_ref")))
        .unionByName(upd_r.withColumn("what", F.lit("update")).withColumn(
            "confidence", F.when(F.col("confidence") == "", S.DEFAULT_CONFIDENCE).otherwise(F.col("confidence"))))
        .unionByName(del_r.select("rid", "op_idx", F.lit("delete").alias("what"),
                                  *[F.lit(None).cast(S.RELATIONS[c].dataType).alias(c) for c in RFIELDS]))
    )
    rh = running(rh, "rid", "op_idx", last=RFIELDS)
    rh = rh.select("*", *[F.coalesce(c, f"prev_{c}").alias(f"now_{c}") for c in RFIELDS])
    upto = running(rh.select("rid", "op_idx", (-F.col("op_idx")).alias("back")), "rid", "back", last=("op_idx",)).select(
        "rid", "op_idx", F.coalesce("prev_op_idx", F.lit(2**62)).alias("next_idx"))
    rh = rh.join(upto, ["rid", "op_idx"])
    born_r = new_rel.select("rid", F.col("op_idx").alias("birth")).unionByName(base_r.select("rid", zero.alias("birth")))
    rh = materialize(rh.join(born_r, "rid", "left"), "relation_history")

    # relations that fall with an entity: untouched ones, and versions in force when the entity goes
    at = lambda c: deaths.select(F.col("eid").alias(c), "death")
    calm = g.relations.withColumnRenamed("id", "rid").join(touched_r, "rid", "left_anti").select("rid", "source_id", "target_id")
    falls = union([calm.join(at(c), c).select("rid", F.col(c).alias("eid"), "death") for c in ("source_id", "target_id")] + [
        rh.where("birth IS NOT NULL AND what <> 'delete'").join(at(f"now_{c}"), f"now_{c}").where(
            "op_idx < death AND death <= next_idx").select("rid", F.col(f"now_{c}").alias("eid"), "death") for c in ("source_id", "target_id")])
    falls = falls.groupBy("rid").agg(F.min("death").alias("fall"), F.min_by("eid", "death").alias("eid"))  # eid: the entity it goes with
    explicit = del_r.groupBy("rid").agg(F.min("op_idx").alias("cut"))
    rdeath = falls.join(explicit, "rid", "full").select("rid", "fall", "cut", F.least("fall", "cut").alias("death"), "eid")
    rdeath = materialize(rdeath, "relation_deaths")

    # ---- errors ----------------------------------------------------------------------------------
    entity_ids = hist.select(F.col("eid").alias("id"), "birth", "death").where("birth IS NOT NULL").distinct()
    ends = rh.select(F.explode(F.array("now_source_id", "now_target_id")).alias("id")).where("id IS NOT NULL").distinct()
    still = ends.join(entity_ids.select("id"), "id", "left_anti").join(g.entities.select("id"), "id", "left_semi")
    life = entity_ids.unionByName(still.select("id", F.lit(0).cast("long").alias("birth"), F.lit(None).cast("long").alias("death")))
    life = materialize(life, "life")
    lives = F.col("birth").isNotNull() & (F.col("birth") < F.col("op_idx")) & (F.col("death").isNull() | (F.col("death") >= F.col("op_idx")))
    gone_e = F.when(~lives, F.concat(F.lit("实体id="), F.col("eid").cast("string"), F.lit(" 不存在")))
    bad_ref = F.when((strip(F.col("ref")) == ""), F.lit(BAD + "ref必须为非空字符串"))
    unknown = F.concat(F.lit(BAD + '未知操作类型"'), F.coalesce("op", F.lit("undefined")), F.lit("\"，仅支持 " + "/".join(OP_KINDS)))
    e1 = ops.where(~F.coalesce(F.col("op").isin(OP_KINDS), F.lit(False))).select("op_idx", F.coalesce("op", F.lit("未知")).alias("op"), unknown.alias("message"))
    e2 = adds.select("op_idx", "op", F.coalesce(_join_errors(V.entity_errors()), bad_ref).alias("message"))
    raw = pick("update_entity").select("op_idx", F.col("name").alias("p_name"), F.col("category").alias("p_category"), F.col("attributes").alias("p_attributes"))
    e3 = hist.where("what = 'update'").join(raw, "op_idx").select(
        "op_idx", F.lit("update_entity").alias("op"), F.coalesce(gone_e, _join_errors(V.entity_patch_errors())).alias("message"))
    first_only = F.col("death") == F.col("op_idx")
    e4 = hist.where("what = 'delete'").select("op_idx", F.lit("delete_entity").alias("op"), F.coalesce(
        gone_e, F.when(~first_only, F.concat(F.lit("实体id="), F.col("eid").cast("string"), F.lit(" 不存在")))).alias("message"))

    def with_life(df, col, flag):
        lf = life.select(F.col("id").alias(col), F.col("birth").alias("_b"), F.col("death").alias("_d"))
        ok = F.col("_b").isNotNull() & (F.col("_b") < F.col("op_idx")) & (F.col("_d").isNull() | (F.col("_d") > F.col("op_idx")))
        return df.join(lf, col, "left").withColumn(flag, ok).drop("_b", "_d")

    def end_error(e):
        key = F.col(f"{e}_name")
        some = F.concat(F.lit(BAD + '实体名 "'), key, F.lit('" 存在'), F.col(f"{e}_n").cast("string"), F.lit("个候选，请改用 source_id/target_id"))
        no = F.concat(F.lit(BAD + '实体 "'), key, F.lit('" 不存在（本批或库中均未找到）'))
        ref = F.concat(F.lit(BAD + 'ref占位符"'), F.col(f"{e}_k"), F.lit('"尚未由任何add_entity定义'))
        return (F.when(F.col(f"{e}_n") > 1, some).when(F.col(f"{e}_n") < 1, no)
                .when(F.col(f"{e}_n").isNull() & F.col(f"{e}_key_ref").isNotNull() & F.col(f"{e}_by_ref").isNull(), ref)
                .when(F.col(f"{e}_n").isNull() & F.col(f"{e}_key_ref").isNull() & ~F.coalesce(F.col(f"{e}_id") > 0, F.lit(False)),
                      F.lit(BAD + "source_id/target_id必须为正整数或使用ref占位符")))

    nr = with_life(with_life(new_rel, "source_end", "has_source"), "target_end", "has_target")
    e5 = nr.select("op_idx", "op", F.coalesce(end_error("source"), end_error("target"), _join_errors(
        V.relation_errors("source_end", "target_end", source_ref="evidence_ref"))).alias("message"))
    patch = pick("update_relation").select(
        "op_idx", F.col("name").alias("p_name"), F.col("category").alias("p_category"), F.col("confidence").alias("p_confidence"),
        F.col("evidence_ref").alias("p_source_ref"), F.col("source_id").alias("p_source_id"), F.col("target_id").alias("p_target_id"))
    ru = rh.where("what = 'update'").drop("next_idx", *RFIELDS).join(patch, "op_idx").join(rdeath.select("rid", F.col("death").alias("rdead")), "rid", "left")
    ru = ru.select("*", *[v.alias(f"m_{c}") for c, v in V.merged_relation().items()])
    ru = with_life(with_life(ru, "m_source_id", "has_source"), "m_target_id", "has_target")
    rlives = F.col("birth").isNotNull() & (F.col("birth") < F.col("op_idx")) & (F.col("rdead").isNull() | (F.col("rdead") > F.col("op_idx")))
    gone_r = F.when(~rlives, F.concat(F.lit("关系id="), F.col("rid").cast("string"), F.lit(" 不存在")))
    e6 = ru.select("op_idx", F.lit("update_relation").alias("op"), F.coalesce(gone_r, _join_errors(F.concat(
        V.relation_patch_errors(), V.relation_errors(*[f"m_{c}" for c in ("source_id", "target_id")], name="m_name", category="m_category",
                                                     confidence="m_confidence", source_ref="m_source_ref")))).alias("message"))
    rd = rh.where("what = 'delete'").join(rdeath.select("rid", F.col("death").alias("rdead")), "rid", "left")
    ok_del = F.col("birth").isNotNull() & (F.col("birth") < F.col("op_idx")) & (F.col("rdead") == F.col("op_idx"))
    e7 = rd.select("op_idx", F.lit("delete_relation").alias("op"), F.when(
        ~F.coalesce(ok_del, F.lit(False)), F.concat(F.lit("关系id="), F.col("rid").cast("string"), F.lit(" 不存在"))).alias("message"))
    bad = _first_error(union([e1, e2, e3, e4, e5, e6, e7]))
    if bad is not None:
        return ApplyResult(g, None, f"第{bad[0]}条操作({bad[1]})失败: {bad[2]}", marks)

    # ---- new tables ------------------------------------------------------------------------------
    end = hist.groupBy("eid").agg(*[F.max_by(f"now_{c}", F.when(F.col(f"now_{c}").isNotNull(), F.col("op_idx"))).alias(c) for c in EFIELDS])
    old_cols = g.entities.select(F.col("id").alias("eid"), "created_at", "source").join(touched, "eid", "left_semi")
    end = end.join(old_cols, "eid", "left").select(
        F.col("eid").alias("id"), *EFIELDS, F.coalesce("created_at", now).alias("created_at"), F.coalesce("source", F.lit(source)).alias("source"))
    end = materialize(end, "entity_end")
    entities = g.entities.join(touched.withColumnRenamed("eid", "id"), "id", "left_anti").select(*S.ENTITIES.fieldNames()).unionByName(
        end.join(deaths.select(F.col("eid").alias("id")), "id", "left_anti").select(*S.ENTITIES.fieldNames()))
    rend = rh.groupBy("rid").agg(*[F.max_by(f"now_{c}", F.when(F.col(f"now_{c}").isNotNull(), F.col("op_idx"))).alias(c) for c in RFIELDS])
    rold = g.relations.select(F.col("id").alias("rid"), "created_at", "source").join(touched_r, "rid", "left_semi")
    rend = rend.join(rold, "rid", "left").select(
        F.col("rid").alias("id"), *RFIELDS, F.coalesce("created_at", now).alias("created_at"), F.coalesce("source", F.lit(source)).alias("source"))
    rend = materialize(rend.select(*S.RELATIONS.fieldNames()), "relation_end")
    dead_r = rdeath.select(F.col("rid").alias("id"))
    relations = g.relations.join(touched_r.withColumnRenamed("rid", "id"), "id", "left_anti").select(*S.RELATIONS.fieldNames()).unionByName(
        rend).join(dead_r, "id", "left_anti").select(*S.RELATIONS.fieldNames())
    dead_e = deaths.select(F.col("eid").alias("entity_id"))
    added = new_aliases.select("id", F.col("eid").alias("entity_id"), "alias", now.alias("created_at"))
    aliases = g.aliases.select(*S.ALIASES.fieldNames()).unionByName(added).join(dead_e, "entity_id", "left_anti").select(*S.ALIASES.fieldNames())
    images = g.entity_images.join(dead_e, "entity_id", "left_anti").select(*S.ENTITY_IMAGES.fieldNames())
    rimages = g.relation_images.join(dead_r.withColumnRenamed("id", "relation_id"), "relation_id", "left_anti").select(*S.RELATION_IMAGES.fieldNames())

    # ---- log rows --------------------------------------------------------------------------------
    stamp = end.select(F.col("id").alias("eid"), "created_at", F.col("source").alias("src"))
    ent = lambda p: F.struct(F.col("eid").alias("id"), *[F.col(f"{p}{c}").alias(c) for c in EFIELDS],
                             iso_time("created_at").alias("created_at"), F.col("src").alias("source"))
    he = hist.where("what <> 'base'").join(stamp, "eid")
    n_img = g.entity_images.join(dead_e, "entity_id", "left_semi").groupBy(F.col("entity_id").alias("eid")).agg(F.count(F.lit(1)).alias("ni"))
    n_fall = rdeath.where("rid IS NOT NULL AND fall = death AND (cut IS NULL OR fall < cut)").select("rid", "death", "eid")
    per_death = n_fall.groupBy("eid").agg(F.count(F.lit(1)).alias("nr"))
    he = he.join(n_img, "eid", "left").join(per_death, "eid", "left")
    count0 = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    log = lambda df, kind, sub, tie, snap: df.select(
        "op_idx", F.lit(sub).alias("sub"), tie.cast("long").alias("tie"), F.lit(kind).alias("op_type"), F.to_json(snap).alias("snapshot"))
    alias_row = F.struct("id", F.col("eid").alias("entity_id"), "alias", iso_time(now).alias("created_at"))
    rel_cols = S.RELATIONS.fieldNames()
    row = lambda: F.struct(*[iso_time("created_at").alias(c) if c == "created_at" else F.col(c) for c in rel_cols])
    rstamp = rend.select(F.col("id").alias("rid"), "created_at", F.col("source").alias("src"))
    rel = lambda p: F.struct(F.col("rid").alias("id"), *[F.col(f"{p}{c}").alias(c) for c in RFIELDS],
                             iso_time("created_at").alias("created_at"), F.col("src").alias("source"))
    hr = rh.where("what <> 'base'").join(rstamp, "rid")
    fallen_rows = g.relations.join(
        touched_r.withColumnRenamed("rid", "id"), "id", "left_anti").select(*rel_cols).unionByName(rend)
    fallen_rows = fallen_rows.join(n_fall.select(F.col("rid").alias("id"), F.col("death").alias("op_idx"), "eid"), "id")
    logs = union([
        log(he.where("what = 'add'"), "ADD_ENTITY", 0, F.col("eid"), F.struct(ent("now_").alias("entity"))),
        log(new_aliases, "ADD_ALIAS", 1, F.col("j"), F.struct(alias_row.alias("alias"))),
        log(he.where("what = 'update'"), "UPDATE_ENTITY", 0, F.col("eid"), F.struct(ent("prev_").alias("before"), ent("now_").alias("after"))),
        log(fallen_rows, "DELETE_RELATION", 0, F.col("id"), F.struct(
            row().alias("relation"), F.concat(F.lit("级联删除(实体id="), F.col("eid").cast("string"), F.lit(")")).alias("reason"))),
        log(he.where("what = 'delete'"), "DELETE_ENTITY", 1, F.col("eid"), F.struct(
            ent("prev_").alias("entity"), count0("nr").alias("cascaded_relations"), count0("ni").alias("cascaded_images"))),
        log(hr.where("what = 'add'"), "ADD_RELATION", 0, F.col("rid"), F.struct(rel("now_").alias("relation"))),
        log(hr.where("what = 'update'"), "UPDATE_RELATION", 0, F.col("rid"), F.struct(rel("prev_").alias("before"), rel("now_").alias("after"))),
        log(hr.where("what = 'delete'"), "DELETE_RELATION", 0, F.col("rid"), F.struct(rel("prev_").alias("relation"))),
    ])
    logs = _numbered(logs, ["op_idx", "sub", "tie"], marks["op_logs"], "id", keep=["op_type", "snapshot"])  # written there, once
    logs = logs.select("id", "op_type", "snapshot", now.alias("created_at"), F.lit(source).alias("source"))
    op_logs = g.op_logs.select(*S.OP_LOGS.fieldNames()).unionByName(logs)

    asked_aliases = adds.select("op_idx", F.greatest(F.size("aliases"), F.lit(0)).cast("long").alias("aliases_added"))
    applied = (
        he.select("op_idx", F.col("eid").alias("id"), F.when(F.col("what") != "delete", F.col("now_name")).alias("name"),
                  F.when(F.col("what") == "delete", count0("nr")).alias("cascaded_relations"))
        .unionByName(hr.select("op_idx", F.col("rid").alias("id"), F.when(F.col("what") != "delete", F.col("now_name")).alias("name"),
                               F.lit(None).cast("long").alias("cascaded_relations")))
        .join(ops.select("op_idx", "op"), "op_idx").join(asked_aliases, "op_idx", "left")
        .select("op_idx", "op", "id", "name", "aliases_added", "cascaded_relations")
    )
    for t, df in (("entities", adds), ("relations", new_rel), ("aliases", new_aliases), ("op_logs", logs)):
        marks[t] += df.count()
    discard(uses, all_tries, free_tries, taken, new_rel, life, *got)  # the new tables and ``applied`` do not read these
    out = g.with_tables(entities=entities, relations=relations, aliases=aliases, op_logs=op_logs, entity_images=images, relation_images=rimages)
    return ApplyResult(out, applied, None, marks)


def apply_report(applied: DataFrame) -> DataFrame:
    """One row: entities added, relations added, other operations."""
    n = lambda test: F.count(F.when(test, 1))
    e, r = F.col("op") == "add_entity", F.col("op") == "add_relation"
    return applied.agg(n(e).alias("entities_added"), n(r).alias("relations_added"), n(~e & ~r).alias("others"))


def ops_table(df: DataFrame, op: str, *order) -> DataFrame:
    """Number the rows of one kind of operation in the given order."""
    return with_position(df.withColumn("op", F.lit(op)), *order, name="op_idx").withColumn("op_idx", F.col("op_idx") + 1)


def delete_entities(g: Graph, ids: DataFrame, source: str = "手工") -> ApplyResult:
    return apply_ops(g, ops_table(ids.select("id").distinct(), "delete_entity", "id"), source)


def reset_graph(g: Graph, confirm: bool = False, source: str = "OpenCode") -> ApplyResult:
    """Delete every entity; needs an explicit confirmation."""
    if confirm is not True:
        raise ValueError("清空图谱是危险操作，必须显式传 confirm:true 执行")
    return apply_ops(g, ops_table(g.entities.select("id"), "delete_entity", "id"), source)


def add_aliases(g: Graph, requests: DataFrame) -> DataFrame:
    """Status of every (req_idx, entity_id, alias): 404 no entity, 400 blank, long or own name, 200 already
    there, 409 taken, 201 new. Of several requests for a free alias the first gets it."""
    r = requests.select("req_idx", "entity_id", strip(F.coalesce("alias", F.lit(""))).alias("alias"))
    r = r.join(g.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("own")), "entity_id", "left")
    wanted = r.select("alias").distinct()
    named = g.entities.select(F.col("name").alias("alias")).join(wanted, "alias", "left_semi").distinct().withColumn("named", F.lit(True))
    held = g.aliases.join(wanted, "alias", "left_semi").select("alias", F.col("entity_id").alias("holder"))
    r = r.join(named, "alias", "left").join(held, "alias", "left")
    bad = (F.when(F.col("own").isNull(), 404).when(F.col("alias") == "", 400).when(F.length("alias") > 200, 400)
           .when(F.col("alias") == F.col("own"), 400).when(F.col("holder") == F.col("entity_id"), 200)
           .when(F.col("named") | F.col("holder").isNotNull(), 409))
    r = materialize(r.withColumn("bad", bad), "alias_requests")
    win = r.where("bad IS NULL").groupBy("alias").agg(F.min("req_idx").alias("won"), F.min_by("entity_id", "req_idx").alias("winner"))
    status = (F.coalesce(F.col("bad"), F.when(F.col("req_idx") == F.col("won"), 201)
                         .when(F.col("entity_id") == F.col("winner"), 200).otherwise(409)))
    return r.join(win, "alias", "left").select("req_idx", "entity_id", "alias", status.alias("status"))


def commit_aliases(g: Graph, statuses: DataFrame, source: str = "手工", marks: dict | None = None) -> Graph:
    """Store the new aliases of :func:`add_aliases` with their log rows."""
    marks = marks or high_water(g)
    now = fixed_now()
    new = materialize(_numbered(statuses.where("status = 201"), ["req_idx"], marks["aliases"], "id"), "aliases")
    rows = new.select("id", "entity_id", "alias", now.alias("created_at"))
    snap = F.to_json(F.struct(F.struct("id", "entity_id", "alias").alias("alias")))
    logs = new.select((F.col("id") - marks["aliases"] + marks["op_logs"]).alias("id"), F.lit("ADD_ALIAS").alias("op_type"),
                      snap.alias("snapshot"), now.alias("created_at"), F.lit(source).alias("source"))
    return g.with_tables(aliases=g.aliases.select(*rows.columns).unionByName(rows), op_logs=g.op_logs.select(*logs.columns).unionByName(logs))


def remove_aliases(g: Graph, ids: DataFrame, source: str = "手工", marks: dict | None = None):
    """(new graph, statuses): rows deleted by id and logged; 404 for ids that are not there."""
    marks = marks or high_water(g)
    want = ids.select("id").distinct()
    found = g.aliases.join(want, "id", "left_semi")
    snap = F.to_json(F.struct(F.struct("id", "entity_id", "alias").alias("alias")))
    logs = _numbered(found.select(F.col("id").alias("alias_id"), snap.alias("snapshot")), ["alias_id"], marks["op_logs"], "id").select(
        "id", F.lit("DELETE_ALIAS").alias("op_type"), "snapshot", fixed_now().alias("created_at"), F.lit(source).alias("source"))
    status = want.join(found.select("id", F.lit(200).alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(404)).alias("status"))
    out = g.with_tables(aliases=g.aliases.join(want, "id", "left_anti").select(*S.ALIASES.fieldNames()),
                        op_logs=g.op_logs.select(*logs.columns).unionByName(logs))
    return out, status


def add_entities_or_merge(g: Graph, requests: DataFrame) -> DataFrame:
    """Route (req_idx, name, category, attributes, merge_into, force) rows: ``insert``, ``merge`` or ``conflict``.

    A name is taken when a stored entity or alias has it, or an earlier row of the batch asks for it.
    """
    r = requests.withColumn("key", strip(F.coalesce("name", F.lit(""))))
    keys = r.select("key").where("key <> ''").distinct()
    taken = keys.join(g.entities.select(F.col("name").alias("key")), "key", "left_semi").unionByName(
        keys.join(g.aliases.select(F.col("alias").alias("key")), "key", "left_semi")).distinct().withColumn("taken", F.lit(True))
    first = r.where("key <> ''").groupBy("key").agg(F.min("req_idx").alias("first"))
    r = r.join(taken, "key", "left").join(first, "key", "left")
    conflict = F.coalesce(F.col("taken"), F.lit(False)) | F.coalesce(F.col("req_idx") > F.col("first"), F.lit(False))
    action = (F.when(~conflict, "insert").when(F.coalesce(F.col("merge_into") > 0, F.lit(False)), "merge")
              .when(F.coalesce("force", F.lit(False)), "insert").otherwise("conflict"))
    return r.select(*requests.columns, action.alias("action"))
