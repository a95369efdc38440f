"""Scans, pages, counts, degrees and the graph digest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.graph import Graph, neighbor_pairs
from graphloom.session import at_least, with_position


def alias_rows(aliases: DataFrame) -> DataFrame:
    """(entity_id, id, alias) rows: the form to use where an entity may have any number of aliases."""
    return aliases.select("entity_id", "id", "alias")


def alias_map(aliases: DataFrame) -> DataFrame:
    """One row per entity with its alias list in alias id order; ``alias_rows`` has no lists."""
    listed = F.sort_array(F.collect_list(F.struct("id", "alias")))
    return aliases.groupBy("entity_id").agg(F.transform(listed, lambda a: a["alias"]).alias("aliases"))


def graph_counts(g: Graph) -> DataFrame:
    """One row: entities, relations, logs."""
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    rows = one(g.entities, "entities").unionAll(one(g.relations, "relations")).unionAll(one(g.op_logs, "logs"))
    pick = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
    return rows.agg(pick("entities"), pick("relations"), pick("logs"))


def graph_version(op_logs: DataFrame) -> DataFrame:
    return op_logs.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("version"))


def list_entities(g: Graph, category=None, limit=100, offset=0) -> DataFrame:
    """A page of entities by id with alias lists and ``total`` before paging."""
    limit, offset = at_least(limit, 1, "limit"), at_least(offset, 0, "offset")
    e = g.entities if category is None else g.entities.where(F.col("category") == category)
    page = e.orderBy("id").offset(offset).limit(limit)
    total = e.agg(F.count(F.lit(1)).alias("total")).withColumn("one", F.lit(1))
    lists = alias_map(g.aliases.join(page.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))
    return (
        page.withColumn("one", F.lit(1)).join(total, "one").drop("one")
        .join(lists, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )


def graph_payload(g: Graph, entity_limit=300, relation_limit=1000):
    """First entities and relations by id, and one row of totals with the ``truncated`` flag."""
    ne, nr = at_least(entity_limit, 1, "entity_limit"), at_least(relation_limit, 1, "relation_limit")
    totals = graph_counts(g).select(
        F.col("entities").alias("total_entities"), F.col("relations").alias("total_relations"),
        ((F.col("entities") > ne) | (F.col("relations") > nr)).alias("truncated"),
    )
    return g.entities.orderBy("id").limit(ne), g.relations.orderBy("id").limit(nr), totals


def image_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("entity_id").agg(F.count(F.lit(1)).alias("count"))


def relation_name_freq(relations: DataFrame, k: int | None = 20) -> DataFrame:
    """Relation names by count; equal counts in order of first appearance."""
    freq = relations.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("first_id"))
    return freq if k is None else freq.orderBy(F.desc("count"), "first_id").limit(k)


def degrees(relations: DataFrame) -> DataFrame:
    """Edge ends per node; parallel edges count, a self loop counts twice."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def incident_counts(relations: DataFrame) -> DataFrame:
    """Relations touching a node; a self loop counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("hit_relations"))


def neighbor_counts(relations: DataFrame) -> DataFrame:
    """Distinct-neighbor degree."""
    return neighbor_pairs(relations).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def distinct_categories(g: Graph) -> DataFrame:
    """(kind, category) with the id of first appearance."""
    one = lambda df, kind: df.groupBy("category").agg(F.min("id").alias("first_id")).select(
        F.lit(kind).alias("kind"), "category", "first_id")
    return one(g.entities, "entity").unionByName(one(g.relations, "relation"))


def category_counts(g: Graph) -> DataFrame:
    """Enum metadata: rows per category."""
    one = lambda df, kind: df.groupBy("category").agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(kind).alias("kind"), "category", "count")
    return one(g.entities, "entity").unionByName(one(g.relations, "relation"))


def digest_samples(g: Graph) -> DataFrame:
    """At most 15 sample entities: the 8 of highest degree (at least 2), then 7 at an even stride."""
    ent = g.entities.select("id", "name")
    high = (
        degrees(g.relations).where("degree >= 2").join(ent, "id").orderBy(F.desc("degree"), "id").limit(8)
        .select("id", "name", F.struct(F.lit(1).alias("part"), (-F.col("degree")).alias("k"), "id").alias("ord"))
    )
    pos = with_position(ent, "id")
    n = ent.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("one"), F.greatest(F.lit(1), F.floor(F.col("n") / 8)).alias("step"))
    spread = (
        pos.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").where("pos % step = 0 AND pos < 7 * step")
        .select("id", "name", F.struct(F.lit(2).alias("part"), F.col("pos").alias("k"), "id").alias("ord"))
    )
    both = high.unionByName(spread).groupBy("id", "name").agg(F.min("ord").alias("ord"))
    return both.orderBy("ord").limit(15)


def graph_digest(g: Graph, max_chars: int | None = None) -> DataFrame:
    """One row of text: categories, frequent relation names, samples, sizes; cut to ``max_chars`` if given."""
    def line(df, text, order):
        # inputs are enum categories, 20 names or 15 samples
        rows = F.sort_array(F.collect_list(F.struct(*order, F.expr(text).alias("_t"))))
        return df.agg(rows.alias("r"))
    cats = distinct_categories(g)
    joined = lambda sep: F.array_join(F.transform("r", lambda x: x["_t"]), sep)
    none = lambda c: F.when(c == "", "（暂无）").otherwise(c)
    part = lambda no, head, df, order, text, sep, empty: line(df, text, order).select(
        F.lit(no).alias("no"),
        F.concat(F.lit(head), none(joined(sep)) if empty else joined(sep)).alias("t"))
    sizes = graph_counts(g).select(F.lit(5).alias("no"), F.concat(
        F.lit("规模: 实体"), F.col("entities").cast("string"), F.lit(" 关系"), F.col("relations").cast("string")).alias("t"))
    top = relation_name_freq(g.relations).withColumn("neg", -F.col("count"))
    lines = (
        part(1, "实体大类: ", cats.where("kind = 'entity'"), ["first_id"], "category", "/", False)
        .unionByName(part(2, "关系大类: ", cats.where("kind = 'relation'"), ["first_id"], "category", "/", False))
        .unionByName(part(3, "高频关系名: ", top, ["neg", "first_id"], "concat(name, '(', count, ')')", ", ", True))
        .unionByName(part(4, "样例实体: ", digest_samples(g), ["ord"], "concat(name, '(id', id, ')')", ", ", True))
        .unionByName(sizes)
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "t"))), lambda x: x["t"]), "\n")
    return lines.agg((text if max_chars is None else F.substring(text, 1, max_chars)).alias("digest"))


def graph_stats(g: Graph, ontology=None) -> DataFrame:
    """One row: entities, relations, logs, version, relations that the rules infer, and indexed vectors."""
    from graphloom.operators.infer import DEFAULT_ONTOLOGY, infer_all

    one = F.lit(1).alias("one")
    inferred = infer_all(g, ontology or DEFAULT_ONTOLOGY).agg(F.count(F.lit(1)).alias("inferred_relations"))
    vectors = g.vectors.agg(F.count(F.lit(1)).alias("indexed_vectors"))
    out = graph_counts(g).select("*", one)
    for part in (graph_version(g.op_logs), inferred, vectors):
        out = out.join(part.select("*", one), "one")  # one row each
    return out.drop("one")


def entity_details(g: Graph, keys: DataFrame) -> DataFrame:
    """Entities of the key table with alias lists and the number of incident relations.

    The relations themselves come as rows from :func:`graphloom.operators.match.incident`.
    """
    from graphloom.operators.match import incident

    k = keys.select("id").distinct()
    ent = g.entities.join(k, "id", "left_semi")
    lists = alias_map(g.aliases.join(k.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))
    n = incident(g.relations, k).groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("n_relations"))
    return (
        ent.join(n, "id", "left").join(lists, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
        .withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))
        .withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    )
