"""The operation log: listing, rendering, searching, field differences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.text import changed_keys, clip, diff_text, flat_map
from graphloom.graph import Graph

_ENTITY = "struct<id:bigint,name:string,category:string,source:string>"
_RELATION = "struct<id:bigint,source_id:bigint,target_id:bigint,name:string,category:string>"
_SNAPSHOT = (
    f"struct<entity:{_ENTITY},relation:{_RELATION},before:string,after:string,reason:string,"
    "cascaded_relations:bigint,restored_to:string,counts:struct<entities:bigint,relations:bigint>,undone_log:bigint>"
)


def list_op_logs(op_logs: DataFrame, limit: int = 200) -> DataFrame:
    return op_logs.orderBy(F.desc("id")).limit(limit)


def parse_snapshot(snapshot):
    return F.from_json(snapshot, _SNAPSHOT)


def with_rendered(op_logs: DataFrame, entities: DataFrame) -> DataFrame:
    """Logs with a readable ``rendered`` text; names of missing entities fall back to ``#id``."""
    s = op_logs.withColumn("s", parse_snapshot("snapshot"))
    name = lambda alias: entities.select(F.col("id").alias(f"_{alias}_id"), F.col("name").alias(f"_{alias}"))
    s = s.join(name("src"), F.col("s.relation.source_id") == F.col("_src_id"), "left")
    s = s.join(name("tgt"), F.col("s.relation.target_id") == F.col("_tgt_id"), "left")
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    end = lambda n, i: F.when(F.col(n).isNotNull(), F.concat(F.lit("「"), F.col(n), F.lit("」"))).otherwise(
        F.concat(F.lit("#"), text(i, "undefined")))
    src, tgt = end("_src", "s.relation.source_id"), end("_tgt", "s.relation.target_id")
    arrow = F.concat(src, F.lit(" —["), text("s.relation.name", "undefined"), F.lit("]→ "), tgt)
    before, after = flat_map(F.col("s.before")), flat_map(F.col("s.after"))
    change = diff_text(before, after)
    change = F.when(change == "", "无字段变化").otherwise(change)
    shown = lambda c: F.when(F.col(c).isNull(), "").otherwise(
        F.concat(F.lit("「"), text(f"{c}.name", "undefined"), F.lit("」("), text(f"{c}.category", "undefined"), F.lit(")")))
    after_shown = F.when(after.isNull(), "").otherwise(F.concat(
        F.lit("「"), F.coalesce(F.element_at(after, "name"), F.lit("undefined")), F.lit("」("),
        F.coalesce(F.element_at(after, "category"), F.lit("undefined")), F.lit(")")))
    of_after = lambda k: F.coalesce(F.element_at(after, k), F.lit("?"))
    op = F.col("op_type")
    cascaded = F.when(F.col("s.cascaded_relations") > 0, F.concat(
        F.lit("，级联删除 "), F.col("s.cascaded_relations").cast("string"), F.lit(" 条关系"))).otherwise("")
    reason = F.when(text("s.reason") != "", F.concat(F.lit("（"), F.col("s.reason"), F.lit("）"))).otherwise("")
    rendered = (
        F.when(op == "ADD_ENTITY", F.concat(F.lit("新增实体 "), shown("s.entity"), F.lit("，来源 "), text("s.entity.source", "—")))
        .when(op == "UPDATE_ENTITY", F.concat(F.lit("更新实体 "), after_shown, F.lit("："), change))
        .when(op == "DELETE_ENTITY", F.concat(F.lit("删除实体 "), shown("s.entity"), cascaded))
        .when(op == "ADD_RELATION", F.concat(F.lit("新增关系 "), arrow, F.lit("（"), text("s.relation.category", "—"), F.lit("）")))
        .when(op == "UPDATE_RELATION", F.concat(
            F.lit("更新关系 #"), of_after("id"), F.lit(" ["), of_after("name"), F.lit("]："), change))
        .when(op == "DELETE_RELATION", F.concat(F.lit("删除关系 "), arrow, reason))
        .when(op == "RESTORE", F.concat(
            F.lit("版本回溯至 "), text("s.restored_to", "?"), F.lit("，回溯后 实体 "), text("s.counts.entities", "?"),
            F.lit(" / 关系 "), text("s.counts.relations", "?")))
        .otherwise(clip(F.col("snapshot"), 160))
    )
    return s.withColumn("rendered", rendered).drop("s", "_src_id", "_src", "_tgt_id", "_tgt")


def search_op_logs(g: Graph, op_type: str = "", keyword: str = "") -> DataFrame:
    """Logs of one type whose rendered text, source or label contains the keyword, without case."""
    logs = g.op_logs if not op_type else g.op_logs.where(F.col("op_type") == op_type)
    out = with_rendered(logs, g.entities)
    kw = keyword.strip().lower()
    if kw:
        label = F.lit("")
        for k, v in S.LOG_LABELS.items():
            label = F.when(F.col("op_type") == k, v).otherwise(label)
        label = F.when(label == "", F.col("op_type")).otherwise(label)
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "rendered", "source", label)), F.lit(kw)))
    return out


def diff_fields(op_logs: DataFrame) -> DataFrame:
    """(log id, field, before, after) for every changed field of an update log."""
    s = op_logs.where(F.col("op_type").isin("UPDATE_ENTITY", "UPDATE_RELATION"))
    s = s.withColumn("s", parse_snapshot("snapshot")).select(
        "id", flat_map(F.col("s.before")).alias("b"), flat_map(F.col("s.after")).alias("a"))
    s = s.select("id", "a", "b", F.explode(changed_keys(F.col("b"), F.col("a"))).alias("field"))
    return s.select("id", "field", F.element_at("b", F.col("field")).alias("before"),
                    F.element_at("a", F.col("field")).alias("after"))
