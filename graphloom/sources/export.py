"""Triples, Turtle, JSON and table export; import with a contract check; raw documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions.text import flat_map, iso_time
from graphloom.graph import Graph

# Prefixes and required columns of the formats.
DEFAULT_IRI = "urn:kg:"
INLINE_ALIASES = 1000
REQUIRED = {
    "entities": ["id", "name", "category", "attributes", "source", "created_at"],
    "relations": ["id", "source_id", "target_id", "name", "category", "source", "created_at"],
    "op_logs": ["id", "op_type", "snapshot", "source", "created_at"],
}
ADDED = {
    "relations": {"confidence": S.DEFAULT_CONFIDENCE, "source_ref": ""},
    "entity_images": {"thumb_path": ""},
    "relation_images": {"thumb_path": ""},
}


def header(iri: str = DEFAULT_IRI) -> str:
    return (
        f"@prefix kg: <{iri}> .\n"
        "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
        "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
        "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
    )


def escape(c):
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _class(column, classes: dict, other: str):
    out = F.lit(other)
    for k, v in classes.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def typed_attributes(entities: DataFrame) -> DataFrame:
    """(id, pos, key, value, datatype) rows of the attribute objects, in stored order."""
    e = entities.select("id", flat_map(F.col("attributes")).alias("m"), F.try_parse_json("attributes").alias("v"), F.json_object_keys("attributes").alias("k"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    e = e.withColumn("f", fields).select("id", "m", "f", F.posexplode("k").alias("pos", "key"))
    kind = F.schema_of_variant(F.element_at("f", F.col("key")))
    text = F.element_at("m", F.col("key"))
    number = text.try_cast("double")
    whole = number == F.floor(number)
    datatype = (F.when(kind == "BOOLEAN", "xsd:boolean").when(kind.isNull() | (kind == "VOID"), "rdf:nil").when(kind == "STRING", "string")
                .when(whole, "xsd:integer").otherwise("xsd:decimal"))
    value = F.when(datatype == "rdf:nil", "").when(datatype == "xsd:integer", number.cast("long").cast("string")).otherwise(text)
    return e.select("id", "pos", "key", value.alias("value"), datatype.alias("datatype"))


def literal(value, datatype):
    quoted = F.concat(F.lit('"'), escape(value), F.lit('"'))
    return F.when(datatype == "string", quoted).otherwise(F.concat(quoted, F.lit("^^"), datatype))


def export_triples(g: Graph) -> DataFrame:
    """(subject, predicate, object, datatype) rows of the whole graph."""
    e = g.entities.withColumn("s", F.concat(F.lit("kg:e"), F.col("id").cast("string")))
    r = g.relations.withColumn("s", F.concat(F.lit("kg:r"), F.col("id").cast("string")))
    ref = lambda c: F.concat(F.lit("kg:e"), F.col(c).cast("string"))
    cls = lambda classes, other: F.concat(F.lit("kg:"), _class("category", classes, other))

    def rows(df, *items):
        item = lambda p, o, d: F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit(d).alias("datatype"))
        return df.select(F.col("s").alias("subject"), F.explode(F.array(*[item(*i) for i in items])).alias("t")).select("subject", "t.*")

    c = F.col
    parts = [
        rows(e, ("rdf:type", cls(S.RDF_ENTITY_CLASSES, "Entity"), "iri"), ("rdfs:label", c("name"), "@zh"), ("kg:category", c("category"), "string"),
             ("kg:createdAt", iso_time("created_at"), "xsd:dateTime"), ("kg:source", c("source"), "string")),
        rows(r, ("rdf:type", cls(S.RDF_RELATION_CLASSES, "Relation"), "iri"), ("rdfs:label", c("name"), "@zh"), ("kg:category", c("category"), "string"),
             ("kg:subject", ref("source_id"), "iri"), ("kg:object", ref("target_id"), "iri"),
             ("kg:confidence", F.coalesce("confidence", F.lit(S.DEFAULT_CONFIDENCE)), "string"),
             ("kg:sourceRef", F.coalesce("source_ref", F.lit("")), "string"), ("kg:createdAt", iso_time("created_at"), "xsd:dateTime"),
             ("kg:source", c("source"), "string")),
        g.aliases.join(g.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select(
            ref("entity_id").alias("subject"), F.lit("kg:alias").alias("predicate"), F.col("alias").alias("object"), F.lit("string").alias("datatype")),
    ]
    a = typed_attributes(g.entities).withColumn("node", F.concat(F.lit("_:a"), F.col("id").cast("string"), F.lit("_"), F.col("pos").cast("string")))
    item = lambda s, p, o, d: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), d.alias("datatype"))
    parts.append(a.select(F.explode(F.array(
        item(ref("id"), "kg:attribute", c("node"), F.lit("iri")), item(c("node"), "kg:key", c("key"), F.lit("string")),
        item(c("node"), "kg:value", c("value"), c("datatype")))).alias("t")).select("t.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def turtle_blocks(g: Graph) -> DataFrame:
    """(kind, id, block): one Turtle block per entity and per relation.

    Aliases stand inside the block of their entity; an entity with more than a thousand gets them as
    statements of their own instead, so no block grows without bound.
    """
    q = lambda c: F.concat(F.lit('"'), escape(c), F.lit('"'))
    t = lambda s: F.lit(s)
    cls = lambda classes, other: _class("category", classes, other)
    attr = typed_attributes(g.entities).select("id", "pos", F.concat(
        t("    kg:attribute [ kg:key "), q(F.col("key")), t(" ; kg:value "), literal(F.col("value"), F.col("datatype")), t(" ]")).alias("line"))
    # attribute objects hold at most 100 keys
    attr = attr.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("attrs"))
    many = g.aliases.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > INLINE_ALIASES).select("entity_id")
    few = g.aliases.join(many, "entity_id", "left_anti").groupBy(F.col("entity_id").alias("id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("id", "alias"))), lambda x: F.concat(t("    kg:alias "), q(x["alias"]))).alias("als"))
    none = F.array().cast("array<string>")
    e = g.entities.join(attr, "id", "left").join(few, "id", "left").withColumn(
        "chunks", F.concat(F.coalesce("attrs", none), F.coalesce("als", none)))
    head = F.concat(
        t("kg:e"), F.col("id").cast("string"), t(" rdf:type kg:"), cls(S.RDF_ENTITY_CLASSES, "Entity"), t(" ;\n    rdfs:label "), q(F.col("name")),
        t("@zh ;\n    kg:category "), q(F.col("category")), t(" ;\n    kg:createdAt "), q(iso_time("created_at")),
        t("^^xsd:dateTime ;\n    kg:source "), q(F.col("source")))
    entity = e.select(t("entity").alias("kind"), "id", F.when(F.size("chunks") > 0, F.concat(
        head, t(" ;\n"), F.array_join("chunks", " ;\n"), t(" .\n"))).otherwise(F.concat(head, t(" .\n"))).alias("block"))
    apart = g.aliases.join(many, "entity_id", "left_semi").select(t("alias").alias("kind"), "id", F.concat(
        t("kg:e"), F.col("entity_id").cast("string"), t(" kg:alias "), q(F.col("alias")), t(" .\n")).alias("block"))
    relation = g.relations.select(t("relation").alias("kind"), "id", F.concat(
        t("kg:r"), F.col("id").cast("string"), t(" rdf:type kg:"), cls(S.RDF_RELATION_CLASSES, "Relation"), t(" ;\n    rdfs:label "), q(F.col("name")),
        t("@zh ;\n    kg:category "), q(F.col("category")), t(" ;\n    kg:subject kg:e"), F.col("source_id").cast("string"),
        t(" ;\n    kg:object kg:e"), F.col("target_id").cast("string"), t(" ;\n    kg:confidence "),
        q(F.coalesce("confidence", t(S.DEFAULT_CONFIDENCE))), t(" ;\n    kg:sourceRef "), q(F.coalesce("source_ref", t(""))),
        t(" ;\n    kg:createdAt "), q(iso_time("created_at")), t("^^xsd:dateTime ;\n    kg:source "), q(F.col("source")), t(" .\n")).alias("block"))
    return entity.unionByName(relation).unionByName(apart)


def export_turtle(g: Graph, path: str, iri: str = DEFAULT_IRI) -> None:
    """Text parts under ``path/blocks`` in id order, and the prefixes under ``path/header``."""
    g.spark.createDataFrame([(header(iri),)], "value string").coalesce(1).write.text(f"{path}/header")
    turtle_blocks(g).sort("kind", "id").select(F.col("block").alias("value")).write.text(f"{path}/blocks")


def export_graph_json(g: Graph, path: str) -> None:
    g.entities.write.json(f"{path}/entities")
    g.relations.write.json(f"{path}/relations")


def graph_json_rows(g: Graph) -> DataFrame:
    """(kind, id, json) rows of the JSON payload."""
    row = lambda df, k: df.select(F.lit(k).alias("kind"), "id", F.to_json(F.struct(*[
        iso_time(c).alias(c) if c == "created_at" else F.col(c) for c in df.columns])).alias("json"))
    return row(g.entities, "entity").unionByName(row(g.relations, "relation"))


def check_import(tables: dict[str, DataFrame]) -> str | None:
    """First broken rule of the import contract, or None."""
    for name, cols in REQUIRED.items():
        if name not in tables:
            return f"缺少必需的数据表 {name}"
    for name, cols in REQUIRED.items():
        missing = [c for c in cols if c not in tables[name].columns]
        if missing:
            return f"表 {name} 缺少必需字段: {', '.join(missing)}"
    return None


def upgrade_legacy(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fill columns that older tables lack; running it twice changes nothing."""
    out = dict(tables)
    for name, defaults in ADDED.items():
        if name not in out:
            continue
        for c, value in defaults.items():
            old = F.col(c) if c in out[name].columns else F.lit(None).cast("string")
            out[name] = out[name].withColumn(c, F.coalesce(old, F.lit(value)))
    return out


def import_graph(spark: SparkSession, tables: dict[str, DataFrame], current: Graph | None = None, versions=None):
    """(graph, report): checked, upgraded tables; the current graph is saved first when a store is given."""
    from graphloom.graph import make_graph
    from graphloom.operators.aggregates import graph_counts, graph_version

    error = check_import(tables)
    if error:
        raise ValueError(error)
    if current is not None and versions is not None:
        versions.savepoint(current, "导入前自动备份", "系统")
    full = upgrade_legacy(tables)
    g = make_graph(spark, **{n: full[n].select(*[F.col(f.name).cast(f.dataType) for f in s.fields]) for n, s in S.TABLES.items() if n in full})
    one = F.lit(1).alias("one")
    return g, graph_counts(g).select("*", one).join(graph_version(g.op_logs).select("*", one), "one").drop("one")


def read_documents(spark: SparkSession, path: str, extensions=("md", "markdown", "txt"), max_bytes: int | None = None) -> DataFrame:
    """(path, filename, text, status) of all files: ``ok`` with the whole text, or without it ``type`` or, above
    ``max_bytes``, ``size``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.substring_index("path", ".", -1))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    status = F.when(~ext.isin(list(extensions)), "type").when(large, "size").otherwise("ok")
    return files.select("path", F.substring_index("path", "/", -1).alias("filename"), F.when(status == "ok", F.decode("content", "UTF-8")).alias("text"), status.alias("status"))
