"""Table schemas and the fixed values of the data contract."""

from pyspark.sql import types as T

# Enums, defaults and labels that stored data must match byte for byte.
ENTITY_CATEGORIES = ["物理实体", "抽象实体", "数值实体", "时间实体"]
RELATION_CATEGORIES = ["空间", "互动", "归属", "时间", "属性"]
CONFIDENCES = ["确证", "推测", "存疑"]
GRAPH_SOURCES = ["手工", "OpenCode", "文档"]
LOG_SOURCES = ["手工", "OpenCode", "系统", "文档"]
DEFAULT_CONFIDENCE = "确证"
GUESSED_CONFIDENCE = "推测"
DEFAULT_CANDIDATE_ENTITY_CATEGORY = "抽象实体"
DEFAULT_CANDIDATE_RELATION_CATEGORY = "属性"
RDF_ENTITY_CLASSES = {
    "物理实体": "PhysicalEntity",
    "抽象实体": "AbstractEntity",
    "数值实体": "NumericEntity",
    "时间实体": "TemporalEntity",
}
RDF_RELATION_CLASSES = {
    "空间": "SpatialRelation",
    "互动": "InteractionRelation",
    "归属": "BelongingRelation",
    "时间": "TemporalRelation",
    "属性": "AttributeRelation",
}
LOG_LABELS = {
    "ADD_ENTITY": "新增实体",
    "UPDATE_ENTITY": "更新实体",
    "DELETE_ENTITY": "删除实体",
    "ADD_RELATION": "新增关系",
    "UPDATE_RELATION": "更新关系",
    "DELETE_RELATION": "删除关系",
    "RESTORE": "版本回溯",
}
TRANSITIVE_NAMES = ["位于", "在", "包含", "包括", "属于", "下辖于", "隶属于", "统治", "管辖", "发源于", "流入"]
SYMMETRIC_NAMES = ["挚友", "夫妻", "同学", "同事", "结为兄弟", "相邻", "同义词"]
INVERSE_NAMES = [("父子", "子父"), ("包含", "属于"), ("创建", "创建者"), ("师从", "学生为")]

LONG, STR, TS = T.LongType(), T.StringType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


ENTITIES = _struct(
    ("id", LONG), ("name", STR), ("category", STR), ("attributes", STR), ("created_at", TS), ("source", STR)
)
RELATIONS = _struct(
    ("id", LONG), ("source_id", LONG), ("target_id", LONG), ("name", STR), ("category", STR),
    ("confidence", STR), ("source_ref", STR), ("created_at", TS), ("source", STR),
)
ALIASES = _struct(("id", LONG), ("entity_id", LONG), ("alias", STR), ("created_at", TS))
OP_LOGS = _struct(("id", LONG), ("op_type", STR), ("snapshot", STR), ("created_at", TS), ("source", STR))
VECTORS = _struct(("entity_id", LONG), ("text", STR), ("vector", T.ArrayType(T.FloatType())), ("updated_at", TS))
ENTITY_IMAGES = _struct(
    ("id", LONG), ("entity_id", LONG), ("filename", STR), ("stored_path", STR), ("thumb_path", STR),
    ("caption", STR), ("created_at", TS),
)
RELATION_IMAGES = _struct(
    ("id", LONG), ("relation_id", LONG), ("filename", STR), ("stored_path", STR), ("thumb_path", STR),
    ("caption", STR), ("created_at", TS),
)
SAVEPOINTS = _struct(
    ("version", LONG), ("title", STR), ("source", STR), ("log_from", LONG), ("log_to", LONG), ("created_at", TS)
)
OPS = _struct(
    ("op_idx", LONG), ("op", STR), ("id", LONG), ("ref", STR), ("name", STR), ("category", STR),
    ("attributes", STR), ("aliases", T.ArrayType(STR)), ("source_id", LONG), ("target_id", LONG),
    ("source_key_ref", STR), ("target_key_ref", STR), ("source_name", STR), ("target_name", STR),
    ("confidence", STR), ("evidence_ref", STR),
)

TABLES = {
    "entities": ENTITIES,
    "relations": RELATIONS,
    "aliases": ALIASES,
    "op_logs": OP_LOGS,
    "vectors": VECTORS,
    "entity_images": ENTITY_IMAGES,
    "relation_images": RELATION_IMAGES,
}
