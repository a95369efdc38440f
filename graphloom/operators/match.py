"""Edge patterns, key resolution, details and name conflicts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.session import at_least

EDGE_COLUMNS = ["source", "relation", "category", "target", "source_id", "target_id", "relation_id"]
FIELDS = {"name", "category", "source"}
OPS = {"=", "contains", "~"}


def with_endpoint_names(relations: DataFrame, entities: DataFrame, how: str = "left") -> DataFrame:
    """Relations with the endpoint entities as ``a`` and ``b`` struct columns."""
    node = F.struct("name", "category", "source")
    a = entities.select(F.col("id").alias("source_id"), node.alias("a"))
    b = entities.select(F.col("id").alias("target_id"), node.alias("b"))
    return relations.join(a, "source_id", how).join(b, "target_id", how)


def _type_predicate(rel_types):
    wanted = [t.strip().lower() for t in rel_types]
    return F.lower("category").isin(wanted) | F.lower("name").isin(wanted)


def _field_predicate(var, field, op, value):
    if field not in FIELDS or op not in OPS:
        raise ValueError(f"unsupported condition: {var}.{field} {op}")
    col = {"source": F.col(f"a.{field}"), "target": F.col(f"b.{field}"), "relation": F.col(field)}[var]
    test = (col == value) if op == "=" else F.contains(col, F.lit(value))
    return F.coalesce(test, F.lit(False))


def _edges(g: Graph, rel_types, where):
    rel = g.relations
    if rel_types:
        rel = rel.where(_type_predicate(rel_types))
    df = with_endpoint_names(rel, g.entities)
    for cond in where:
        df = df.where(_field_predicate(*cond))
    name = lambda s, i: F.coalesce(F.col(f"{s}.name"), F.concat(F.lit("#"), F.col(i).cast("string")))
    return df.select(
        name("a", "source_id").alias("source"), F.col("name").alias("relation"), "category",
        name("b", "target_id").alias("target"), "source_id", "target_id", F.col("id").alias("relation_id"),
    )


def match_edges(g: Graph, rel_types=(), where=(), limit: int | None = 100) -> DataFrame:
    """Edges (a)-[r]->(b). ``rel_types`` match category or name without case; ``where`` holds
    (source|target|relation, name|category|source, =|contains|~, value) and all must hold.
    ``limit=None`` keeps every match; otherwise the first by relation id, 100 by default."""
    df = _edges(g, rel_types, where)
    return df if limit is None else df.orderBy("relation_id").limit(at_least(limit, 1, "limit"))


def match_edges_count(g: Graph, rel_types=(), where=(), limit: int | None = 100) -> DataFrame:
    """Number of matches, capped at the limit; uncapped with ``limit=None``."""
    n = F.count(F.lit(1))
    if limit is not None:
        n = F.least(n, F.lit(at_least(limit, 1, "limit")).cast("long"))
    return _edges(g, rel_types, where).agg(n.alias("count"))


def match_edges_ci(g: Graph, rel_type: str = "", where=(), limit: int | None = 50) -> DataFrame:
    """Search variant: exact type, ``contains`` without case, edges with a missing endpoint dropped.
    ``where`` holds (a|b, name|category|source_id|target_id, =|contains, value)."""
    rel = g.relations
    if rel_type.strip():
        rel = rel.where((F.col("category") == rel_type.strip()) | (F.col("name") == rel_type.strip()))
    df = with_endpoint_names(rel, g.entities, "inner")
    for var, field, op, value in where:
        if var not in ("a", "b") or field not in FIELDS - {"source"} | {"source_id", "target_id"} or op not in ("=", "contains"):
            df = df.where(F.lit(False))
            continue
        # entities carry no endpoint ids, so those fields compare as empty text
        col = F.col(f"{var}.{field}") if field in FIELDS else F.lit("")
        df = df.where((col == value) if op == "=" else F.contains(F.lower(col), F.lit(value.lower())))
    df = df.select(
        F.col("a.name").alias("source"), F.col("name").alias("relation"), "category",
        F.col("b.name").alias("target"), "source_id", "target_id", F.col("id").alias("relation_id"),
    )
    return df if limit is None else df.orderBy("relation_id").limit(at_least(limit, 1, "limit"))


def incident(relations: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """(key, relation row) for relations at either end of a key; a self loop counts once."""
    k = keys.select(F.col(key).alias("key")).distinct()
    out = relations.join(k, F.col("source_id") == F.col("key"))
    into = relations.where("source_id <> target_id").join(k, F.col("target_id") == F.col("key"))
    return out.unionByName(into)


def induced(relations: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Relations with both ends in the id set."""
    s = ids.select(F.col(key).alias("source_id")).distinct()
    t = ids.select(F.col(key).alias("target_id")).distinct()
    return relations.join(s, "source_id", "left_semi").join(t, "target_id", "left_semi")


def alias_owner(g: Graph) -> DataFrame:
    owner = g.entities.select(F.col("id").alias("entity_id"), "name", "category")
    return g.aliases.select("entity_id", "alias").join(owner, "entity_id")


def key_candidates(g: Graph, keys: DataFrame, mode: str = "http") -> DataFrame:
    """One row per (key, way, entity) a text key may stand for; way is ``id``, ``name`` or ``alias``.

    Mode ``http`` tries id then name; ``tool`` tries only the id for digit keys, else name then alias;
    ``cli`` tries id, name, alias. Only the first way that hits is kept.
    """
    k = keys.select("key").distinct()
    k = k.withColumn("k", F.col("key") if mode == "tool" else F.trim("key"))
    k = k.withColumn("num", F.when(F.col("k").rlike(r"^\d+$"), F.try_to_number("k", F.lit("9" * 18)).cast("long")))
    ent = g.entities.select("id", "name", "category")
    by_id = k.join(ent, F.col("num") == F.col("id")).withColumn("way", F.lit("id"))
    text = k.where("num IS NULL") if mode == "tool" else k
    by_name = text.join(ent, F.col("k") == F.col("name")).withColumn("way", F.lit("name"))
    out = by_id.unionByName(by_name)
    if mode != "http":
        own = alias_owner(g).withColumnRenamed("entity_id", "id")
        by_alias = text.join(own, F.col("k") == F.col("alias")).drop("alias").withColumn("way", F.lit("alias"))
        out = out.unionByName(by_alias)
    rank = F.expr("CASE way WHEN 'id' THEN 1 WHEN 'name' THEN 2 ELSE 3 END")
    out = out.withColumn("rank", rank)
    first = out.groupBy("key").agg(F.min("rank").alias("rank"))
    return out.join(first, ["key", "rank"]).select("key", "way", "id", "name", "category")


def resolve_keys(g: Graph, keys: DataFrame, mode: str = "http") -> DataFrame:
    """(key, status, id, n_candidates); status is found, not_found, ambiguous or empty."""
    hits = key_candidates(g, keys, mode).groupBy("key").agg(
        F.countDistinct("id").alias("n"), F.min("id").alias("first")
    )
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.trim("key") == "", "empty").when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous")
    )
    return keys.select("key").distinct().join(hits, "key", "left").select(
        "key", status.alias("status"), F.when(n == 1, F.col("first")).alias("id"), n.cast("long").alias("n_candidates")
    )


def find_entities(g: Graph, names: DataFrame) -> DataFrame:
    """Exact name first, then alias: (key, found, id, n_candidates, via)."""
    k = names.select(F.trim("key").alias("key")).distinct()
    by_name = k.join(g.entities.select("id", "name"), F.col("key") == F.col("name")).select("key", "id", F.lit("name").alias("via"))
    by_alias = k.join(alias_owner(g), F.col("key") == F.col("alias")).select(
        "key", F.col("entity_id").alias("id"), F.lit("alias").alias("via"))
    hits = by_name.unionByName(by_alias).groupBy("key", "via").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    wide = hits.groupBy("key").agg(F.max_by(F.struct("n", "id", "via"), "via").alias("h"))  # 'name' > 'alias'
    n = F.coalesce("h.n", F.lit(0))
    return k.join(wide, "key", "left").select(
        "key", (n == 1).alias("found"), F.when(n == 1, F.col("h.id")).alias("id"), n.cast("long").alias("n_candidates"),
        F.col("h.via").alias("via"),
    )


def name_conflicts(g: Graph, names: DataFrame) -> DataFrame:
    """Every entity whose main name or alias equals the trimmed ``key``."""
    k = names.select(F.trim("key").alias("key")).where("key <> ''").distinct()
    main = k.join(g.entities, F.col("key") == F.col("name")).select("key", "id", "name", "category", F.lit("主名").alias("via"))
    other = k.join(alias_owner(g), F.col("key") == F.col("alias")).select(
        "key", F.col("entity_id").alias("id"), "name", "category",
        F.concat(F.lit("别名("), F.col("alias"), F.lit(")")).alias("via"),
    )
    return main.unionByName(other)


def alias_conflicts(g: Graph, requests: DataFrame) -> DataFrame:
    """First conflicting owner of each requested (entity_id, alias), the entity itself left out."""
    r = requests.select("entity_id", F.trim("alias").alias("alias")).where("alias <> ''").distinct()
    wanted = r.select("alias").distinct()
    first = g.entities.join(wanted, F.col("name") == F.col("alias"), "left_semi").groupBy(F.col("name").alias("alias")).agg(
        F.min("id").alias("name_id"))
    held = g.aliases.select("alias", F.col("entity_id").alias("alias_id"))
    both = r.join(first, "alias", "left").join(held, "alias", "left")
    by_name = F.col("name_id") != F.col("entity_id")
    by_alias = F.col("alias_id") != F.col("entity_id")
    owner = F.when(by_name, F.col("name_id")).when(by_alias, F.col("alias_id"))
    via = F.when(by_name, "主名").when(by_alias, F.concat(F.lit("别名("), F.col("alias"), F.lit(")")))
    return both.select("entity_id", "alias", owner.alias("conflict_id"), via.alias("via")).where("conflict_id IS NOT NULL")


def by_confidence(relations: DataFrame, level: str) -> DataFrame:
    return relations.where(F.coalesce("confidence", F.lit("确证")) == level)


def touching(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Rows with source_id or target_id among the centers."""
    c = centers.select(F.col("id").alias("center")).distinct()
    src = rows.join(c, F.col("source_id") == F.col("center"), "left_semi")
    tgt = rows.join(c, F.col("target_id") == F.col("center"), "left_semi").join(
        c, F.col("source_id") == F.col("center"), "left_anti")
    return src.unionByName(tgt)
