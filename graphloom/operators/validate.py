"""Columnar validation: every rule adds its message to one error array."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.jsontext import json_value, let
from graphloom.functions.text import strip


def rules(*checks) -> Column:
    """Messages of the (bad, message) checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks]))


def _blank(c) -> Column:
    return F.col(c).isNull() | (strip(F.col(c)) == "")


def attribute_errors(c: str = "attributes") -> Column:
    """Errors of a JSON attribute text; NULL counts as an empty object."""
    text = F.coalesce(F.col(c), F.lit("{}"))

    def key_errors(fields, k):
        kind = F.schema_of_variant(F.element_at(fields, k))
        return F.array_compact(F.array(
            F.when(strip(k) == "", F.concat(F.lit('属性键"'), k, F.lit('"必须为非空字符串'))),
            F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.concat(
                F.lit('属性"'), k, F.lit('"的值必须为字符串/数值/布尔/空值(扁平三元组结构)，禁止嵌套对象或数组'))),
        ))

    def object_errors(value):
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        keys = F.json_object_keys(text)
        many = F.array_compact(F.array(F.when(F.size(keys) > 100, F.lit("属性键数量不得超过100"))))
        per_key = let(fields, lambda m: F.flatten(F.transform(keys, lambda k: key_errors(m, k))))
        good = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return F.when(good, F.concat(per_key, many)).otherwise(F.array(F.lit("属性(attributes)必须为JSON对象")))

    return let(json_value(text), object_errors)


def entity_errors(name="name", category="category", attributes="attributes") -> Column:
    head = rules(
        (_blank(name), "实体名称必须为非空字符串"),
        (F.length(name) > 200, "实体名称长度不得超过200字符"),
        (~F.coalesce(F.col(category).isin(S.ENTITY_CATEGORIES), F.lit(False)),
         "实体大类必须为以下4类之一: " + " / ".join(S.ENTITY_CATEGORIES)),
    )
    return F.concat(head, attribute_errors(attributes))


def entity_patch_errors() -> Column:
    """Errors of patch columns p_name, p_category, p_attributes over prev_name, prev_category.

    The whole row is checked again only when attributes are patched, so a long new name passes alone.
    """
    head = rules(
        (F.col("p_name").isNotNull() & (strip(F.col("p_name")) == ""), "实体名称必须为非空字符串"),
        (F.col("p_category").isNotNull() & ~F.col("p_category").isin(S.ENTITY_CATEGORIES),
         "实体大类必须为: " + " / ".join(S.ENTITY_CATEGORIES)),
    )
    merged = F.when(F.col("p_name").isNull() | (strip(F.col("p_name")) == ""), F.col("prev_name")).otherwise(strip(F.col("p_name")))
    again = F.concat(
        rules((merged == "", "实体名称必须为非空字符串"), (F.length(merged) > 200, "实体名称长度不得超过200字符"),
              (~F.coalesce(F.when(F.col("p_category").isin(S.ENTITY_CATEGORIES), F.col("p_category")).otherwise(
                  F.col("prev_category")).isin(S.ENTITY_CATEGORIES), F.lit(False)),
               "实体大类必须为以下4类之一: " + " / ".join(S.ENTITY_CATEGORIES))),
        attribute_errors("p_attributes"))
    none = F.array().cast("array<string>")
    return F.concat(head, F.when(F.col("p_attributes").isNotNull(), again).otherwise(none))


def relation_errors(source="source_id", target="target_id", has_source="has_source", has_target="has_target", name="name",
                    category="category", confidence="confidence", source_ref="source_ref") -> Column:
    """Errors of relation columns; ``has_*`` tell whether the ends exist."""
    s, t = F.col(source), F.col(target)
    s_ok, t_ok = F.coalesce(s > 0, F.lit(False)), F.coalesce(t > 0, F.lit(False))
    both = s_ok & t_ok
    conf = F.when(F.coalesce(F.col(confidence), F.lit("")) == "", F.lit(S.DEFAULT_CONFIDENCE)).otherwise(F.col(confidence))
    return rules(
        (~s_ok, "起点实体id必须为正整数"),
        (~t_ok, "终点实体id必须为正整数"),
        (both & ~F.col(has_source), F.concat(F.lit("起点实体id="), s.cast("string"), F.lit(" 不存在"))),
        (both & ~F.col(has_target), F.concat(F.lit("终点实体id="), t.cast("string"), F.lit(" 不存在"))),
        (both & (s == t), "起点与终点不能为同一实体"),
        (_blank(name), "关系名称必须为非空字符串"),
        (F.length(name) > 200, "关系名称长度不得超过200字符"),
        (~F.coalesce(F.col(category).isin(S.RELATION_CATEGORIES), F.lit(False)),
         "关系大类必须为以下5类之一: " + " / ".join(S.RELATION_CATEGORIES)),
        (~conf.isin(S.CONFIDENCES), "置信度必须为以下3档之一: " + " / ".join(S.CONFIDENCES)),
        (F.length(source_ref) > 500, "来源引用长度不得超过500字符"),
    )


def relation_patch_errors() -> Column:
    """Errors of the patch columns themselves; the merged row is checked by :func:`relation_errors`."""
    return rules(
        (F.col("p_name").isNotNull() & (strip(F.col("p_name")) == ""), "关系名称必须为非空字符串"),
        (F.col("p_category").isNotNull() & ~F.col("p_category").isin(S.RELATION_CATEGORIES),
         "关系大类必须为: " + " / ".join(S.RELATION_CATEGORIES)),
        (F.col("p_confidence").isNotNull() & ~F.col("p_confidence").isin([*S.CONFIDENCES, ""]),
         "置信度必须为: " + " / ".join(S.CONFIDENCES)),
        (F.length("p_source_ref") > 500, "来源引用长度不得超过500字符"),
    )


def has_entity(df: DataFrame, entities: DataFrame, key: str, flag: str) -> DataFrame:
    ids = entities.select(F.col("id").alias(key), F.lit(True).alias(flag))
    return df.join(ids, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validate_entities(df: DataFrame) -> DataFrame:
    """Adds ``errors`` and the trimmed ``value_name`` to (name, category, attributes) rows."""
    return df.withColumn("errors", entity_errors()).withColumn(
        "value_name", F.when(F.size("errors") == 0, strip(F.col("name"))))


def validate_entity_patches(patches: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, p_name, p_category, p_attributes) over the stored rows: merged columns and ``errors``."""
    old = entities.select("id", F.col("name").alias("prev_name"), F.col("category").alias("prev_category"),
                          F.col("attributes").alias("prev_attributes"), F.lit(True).alias("known"))
    df = patches.join(old, "id", "left")
    missing = F.array(F.concat(F.lit("实体id="), F.col("id").cast("string"), F.lit(" 不存在")))
    return df.withColumn("errors", F.when(F.col("known"), entity_patch_errors()).otherwise(missing)).select(
        "*", F.coalesce(strip(F.col("p_name")), "prev_name").alias("name"),
        F.coalesce("p_category", "prev_category").alias("category"),
        F.coalesce("p_attributes", "prev_attributes").alias("attributes"))


def validate_relations(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``errors`` to (source_id, target_id, name, category, confidence, source_ref) rows."""
    df = has_entity(has_entity(df, entities, "source_id", "has_source"), entities, "target_id", "has_target")
    return df.withColumn("errors", relation_errors()).drop("has_source", "has_target")


RELATION_FIELDS = ("source_id", "target_id", "name", "category", "confidence", "source_ref")


def merged_relation(prefix: str = "prev_"):
    """Patched value where given and well formed, else the earlier one."""
    p = lambda c: F.col(f"p_{c}")
    old = lambda c: F.col(f"{prefix}{c}")
    name = F.when(p("name").isNull() | (strip(p("name")) == ""), old("name")).otherwise(strip(p("name")))
    category = F.when(p("category").isin(S.RELATION_CATEGORIES), p("category")).otherwise(old("category"))
    conf = (F.when(p("confidence") == "", S.DEFAULT_CONFIDENCE).when(p("confidence").isin(S.CONFIDENCES), p("confidence"))
            .otherwise(F.coalesce(old("confidence"), F.lit(S.DEFAULT_CONFIDENCE))))
    ref = F.when(F.length(p("source_ref")) <= 500, p("source_ref")).otherwise(F.coalesce(old("source_ref"), F.lit("")))
    ends = [F.coalesce(p(c), old(c)) for c in ("source_id", "target_id")]
    return dict(zip(RELATION_FIELDS, [*ends, name, category, conf, ref]))


def validate_relation_patches(patches: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, p_<field> ...) over the stored rows: merged columns and ``errors``."""
    old = relations.select("id", F.lit(True).alias("known"), *[F.col(c).alias(f"prev_{c}") for c in RELATION_FIELDS])
    df = patches.join(old, "id", "left").select("*", *[v.alias(c) for c, v in merged_relation().items()])
    df = has_entity(has_entity(df, entities, "source_id", "has_source"), entities, "target_id", "has_target")
    missing = F.array(F.concat(F.lit("关系id="), F.col("id").cast("string"), F.lit(" 不存在")))
    return df.withColumn("errors", F.when(
        F.col("known"), F.concat(relation_patch_errors(), relation_errors())).otherwise(missing)).drop("has_source", "has_target")


def source_errors(df: DataFrame, is_log: bool = False) -> DataFrame:
    """Rows whose ``source`` is not allowed."""
    return df.where(~F.coalesce(F.col("source").isin(S.LOG_SOURCES if is_log else S.GRAPH_SOURCES), F.lit(False)))
