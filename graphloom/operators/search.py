"""Keyword, vector and fused search; vector upkeep."""

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import entity_text
from graphloom.functions.vectors import cosine
from graphloom.graph import Graph
from graphloom.operators.aggregates import incident_counts
from graphloom.operators.match import incident
from graphloom.session import at_least, batch_by_bytes, broadcast_bounded, fixed_now, materialize, ship_package, with_position

RRF_K = 60
SEARCH_MIN = 0.15
SIMILAR_MIN = 0.1
PACK_ROWS = 2048
QUERY_ROWS = 8 * PACK_ROWS
GRAMS = (1, 2, 4, 8, 16)  # lengths of grams by which terms are filed
GRAM_PIECE = 200
EMBED_BATCH = 32


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, times) from (qid, text): trimmed, lower-cased, split on whitespace."""
    q = queries.select("qid", F.trim(F.lower("text")).alias("t")).where("t <> ''")
    return q.select("qid", F.explode(F.split("t", r"\s+")).alias("term")).where("term <> ''").groupBy("qid", "term").agg(
        F.count(F.lit(1)).alias("times"))


def _gram_length(text):
    """Length of the grams by which a term is looked for: the longest of GRAMS that it has room for."""
    fits = [F.when(F.length(text) >= g, F.lit(g)) for g in sorted(GRAMS, reverse=True)]
    return F.coalesce(*fits)


def _grams(rows: DataFrame, column: str, lengths: list[int], *keep: str) -> DataFrame:
    """(keep, gram): the grams of every row, once a piece. Long texts are cut into overlapping pieces, since reaching a place in a
    text takes longer the later it comes."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(column), F.lit(1)), F.lit(GRAM_PIECE))
    pieces = rows.where(F.length(column) > 0).select(*keep, F.explode(F.transform(starts, lambda i: F.substring(column, i, F.lit(GRAM_PIECE + max(lengths) - 1)))).alias("_p"))
    places = lambda g: F.when(F.length("_p") >= g, F.transform(F.sequence(F.lit(1), F.length("_p") - g + 1), lambda i: F.substring("_p", i, F.lit(g))))
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(*[F.coalesce(places(g), none) for g in lengths]))
    return pieces.select(*keep, F.explode(found).alias("gram"))


def contained_terms(texts: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """Rows of ``texts`` times the distinct ``term`` values found inside ``column``.

    A gram index: texts post the grams that some term has, and every term is filed under the one of its grams that fewest texts
    hold, so it meets only these; ``contains`` then decides. The same joins serve three terms and many millions; Spark splits
    the rows of a gram that very many texts hold. A term with a gram that no text holds meets none. Null and empty terms are
    found nowhere.
    """
    own = materialize(terms.select("term").where("term <> ''").distinct().withColumn("_g", _gram_length(F.col("term"))), "terms")
    lengths = sorted(r["_g"] for r in own.select("_g").distinct().collect())  # at most len(GRAMS)
    if not lengths:
        return texts.withColumn("term", F.lit(None).cast("string")).where(F.lit(False))
    places = F.transform(F.sequence(F.lit(1), F.length("term") - F.col("_g") + 1), lambda i: F.substring("term", i, F.col("_g")))
    filed = materialize(own.select("term", F.explode(F.array_distinct(places)).alias("gram")), "grams")
    rows = materialize(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    posted = _grams(rows, column, lengths, "_row").join(broadcast_bounded(filed.select("gram").distinct()), "gram", "left_semi")
    posted = materialize(posted.select("gram", "_row").distinct(), "posted")
    held = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    best = filed.join(held, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_b"))
    best = best.where("_b.n > 0").select("term", F.col("_b.gram").alias("gram"))
    met = posted.join(best, "gram").select("_row", "term")
    return rows.join(met, "_row").where(F.contains(F.col(column), F.col("term"))).select(*texts.columns, "term")


def term_scores(g: Graph, terms: DataFrame, with_aliases: bool = True) -> DataFrame:
    """(id, term, score) for every entity a term hits: name equal 10, name contains 5, alias equal 6,
    alias contains 3, other text contains 1; the first of these that holds. Aliases stay rows, so an
    entity with very many of them is not one value."""
    text = F.lower(entity_text()) if with_aliases else F.lower(F.concat_ws("\n", "name", "attributes"))
    ent = g.entities.select("id", F.lower("name").alias("n"), text.alias("t"))
    own = contained_terms(ent, "t", terms)
    kind = F.when(F.col("n") == F.col("term"), 10).when(F.contains("n", F.col("term")), 5).otherwise(1)
    none = F.lit(None).cast("int")
    rows = own.select("id", "term", kind.alias("own"), none.alias("alias"))
    if with_aliases:
        al = contained_terms(g.aliases.select(F.col("entity_id").alias("id"), F.lower("alias").alias("a")), "a", terms)
        by_alias = F.when(F.col("a") == F.col("term"), 6).otherwise(3)
        known = g.entities.select("id")
        rows = rows.unionByName(al.select("id", "term", none.alias("own"), by_alias.alias("alias")).join(known, "id", "left_semi"))
    best = rows.groupBy("id", "term").agg(F.max("own").alias("own"), F.max("alias").alias("alias"))
    return best.select("id", "term", F.when(F.col("own") >= 5, F.col("own")).otherwise(F.coalesce("alias", "own")).alias("score"))


def keyword_search(g: Graph, queries: DataFrame, with_aliases: bool = True) -> DataFrame:
    """(qid, id, score) for every entity with a positive keyword score."""
    terms = materialize(query_terms(queries), "terms")
    hits = term_scores(g, terms, with_aliases).join(terms, "term")
    return hits.groupBy("qid", "id").agg(F.sum(F.col("score") * F.col("times")).cast("long").alias("score"))


def rank_scores(scores: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` best per query with their rank; all of them for None."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def keyword_topk(g: Graph, queries: DataFrame, k: int = 10, with_aliases: bool = False) -> DataFrame:
    """Ranked keyword hits with entity columns; names and attribute JSON only unless asked otherwise."""
    k = at_least(k, 1, "k")
    return rank_scores(keyword_search(g, queries, with_aliases), k).join(g.entities.drop("created_at", "source"), "id")


def hit_relation_texts(g: Graph, hits: DataFrame) -> DataFrame:
    """(id, relation_id, text) rows: the rendered relations of every hit entity."""
    rel = incident(g.relations, hits)
    name = lambda c, out: g.entities.select(F.col("id").alias(c), F.col("name").alias(out))
    rel = rel.join(name("source_id", "s"), "source_id", "left").join(name("target_id", "t"), "target_id", "left")
    shown = lambda n, i: F.coalesce(n, F.concat(F.lit("#"), F.col(i).cast("string")))
    return rel.select(F.col("key").alias("id"), F.col("id").alias("relation_id"), F.concat(
        shown("s", "source_id"), F.lit(" —["), F.col("name"), F.lit("]→ "), shown("t", "target_id")).alias("text"))


def _packs(df: DataFrame, id_col: str, vec_col: str, name: str, size: int) -> DataFrame:
    """Vectors packed into rows of at most ``size`` vectors: (pack, rows)."""
    pos = with_position(df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")), "i")
    return pos.groupBy(F.floor(F.col("pos") / size).alias(name)).agg(F.collect_list(F.struct("i", "v")).alias("rows"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, above: float, skip_self: bool = False) -> DataFrame:
    """(qid, id, score): the k highest cosines above a bound for (qid, vector) against (entity_id, vector).

    Both sides are packed; a pack of vectors meets every pack of queries through a join on the query
    pack number, and each meeting is matrix products that keep only k rows per query. Query packs are the larger ones, as vectors
    move once per query pack; where they are few, each is dealt to several tasks.
    """
    spark = queries.sparkSession
    batch_by_bytes(spark)
    q = materialize(_packs(queries.where("vector IS NOT NULL"), "qid", "vector", "qpack", QUERY_ROWS), "qpacks")
    n = q.count()
    empty = spark.createDataFrame([], "qid long, id long, score double")
    if n == 0:
        return empty
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = materialize(_packs(vectors, "entity_id", "vector", "vpack", PACK_ROWS).withColumnRenamed("rows", "vrows"), "vpacks")
    shares = max(1, min(v.count(), -(-2 * tasks // n)))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    v = v.withColumn("share", F.pmod("vpack", F.lit(shares))).withColumn("qpack", each(n)).repartition(tasks, "qpack", "share")
    q = q.withColumn("share", each(shares)).repartition(tasks, "qpack", "share")

    def meet(batches):
        for b in batches:
            for qrows, vrows in zip(b.column("rows"), b.column("vrows")):
                for lo in range(0, len(qrows.values), PACK_ROWS):
                    yield from _meet(qrows.values.slice(lo, PACK_ROWS), vrows.values, k, above, skip_self)

    ship_package(spark)
    part = v.join(q.hint("shuffle_merge"), ["qpack", "share"]).select("rows", "vrows").mapInArrow(meet, "qid long, id long, score double")
    return rank_scores(part, k).drop("rank")


def _unit(rows, width):
    """Ids and unit vectors of packed rows; shorter vectors are filled up with zeros, longer ones cut."""
    ids, vectors = rows.field("i").to_numpy(zero_copy_only=False), rows.field("v")
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == width).all():
        m = flat.reshape(len(size), width)
    else:
        m = np.zeros((len(size), width))
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        keep = at < width
        m[np.repeat(np.arange(len(size)), size)[keep], at[keep]] = flat[keep]
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return ids, np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _meet(qrows, vrows, k, above, skip_self):
    """The k best of a pack of vectors for every query; of equal ones the smaller ids."""
    width = max(qrows.field("v").value_lengths().to_pylist())
    qid, q = _unit(qrows, width)
    vid, v = _unit(vrows, width)
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    s = q @ v.T
    s[np.isnan(s)] = -2.0
    if skip_self:
        s[qid[:, None] == vid[None, :]] = -2.0
    ok = s > above
    if s.shape[1] > k:
        ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        for row in np.flatnonzero(ok.sum(axis=1) > k):  # ties with the k-th
            found = np.flatnonzero(ok[row])
            ok[row] = False
            ok[row, found[np.argsort(-s[row, found], kind="stable")[:k]]] = True
    r, c = np.nonzero(ok)
    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(vid[c]), pa.array(s[r, c])], ["qid", "id", "score"])


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return vector_topk(queries, vectors, k, SEARCH_MIN)


def hybrid_search(g: Graph, queries: DataFrame, limit: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Keyword and vector rankings fused by reciprocal rank for (qid, text, vector) queries.

    (qid, rank, id, name, rrf_score, semantic_score, keyword_score, hit_relations, mode).
    """
    limit = at_least(limit, 1, "limit")
    queries = materialize(queries, "queries")
    kw_all = materialize(keyword_search(g, queries), "kw")
    kw = rank_scores(kw_all, limit * 3).select("qid", "id", F.col("rank").alias("kw_rank"))
    sem = rank_scores(semantic_search(queries, g.vectors, limit * 3), limit * 3).select("qid", "id", F.col("rank").alias("sem_rank"))
    one = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    fused = kw.join(sem, ["qid", "id"], "full").withColumn("rrf", one("kw_rank") + one("sem_rank"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.asc_nulls_last("kw_rank"), "sem_rank")
    top = materialize(fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit), "fused")
    vec = g.vectors.select(F.col("entity_id").alias("id"), "vector").join(top.select("id").distinct(), "id", "left_semi")
    close = top.select("qid", "id").join(vec, "id").join(
        queries.select("qid", F.col("vector").alias("q")).where("q IS NOT NULL"), "qid")
    close = close.select("qid", "id", cosine(F.col("q"), F.col("vector")).alias("c")).where(F.col("c") > SEARCH_MIN)
    rel = incident_counts(_touching(g.relations, top))
    out = (
        top.join(close, ["qid", "id"], "left")
        .join(kw_all.select("qid", "id", F.col("score").alias("keyword_score")), ["qid", "id"], "left")
        .join(g.entities.select("id", "name"), "id", "left").join(rel, "id", "left")
        .join(queries.select("qid", F.col("vector").isNotNull().alias("v")), "qid")
    )
    return out.select(
        "qid", "rank", "id", "name", F.round("rrf", 5).alias("rrf_score"), F.round("c", 4).alias("semantic_score"),
        "keyword_score", F.coalesce("hit_relations", F.lit(0)).cast("long").alias("hit_relations"),
        F.when(F.col("v"), "hybrid").otherwise("keyword_only").alias("mode"))


def _touching(relations: DataFrame, hits: DataFrame) -> DataFrame:
    """Relations with an end among the hits, once each."""
    return incident(relations, hits).dropDuplicates(["id"]).drop("key")


def similar_entities(g: Graph, targets: DataFrame, k: int = 8) -> DataFrame:
    """(target, mode, id, score, rank): by vector where the target has one with a close match, else by structure."""
    from graphloom.operators.recommend import similar_by_structure

    k = at_least(k, 1, "k")
    t = targets.select("id").distinct().join(g.entities.select("id"), "id", "left_semi")
    t = materialize(t, "targets")
    q = t.join(g.vectors, F.col("id") == F.col("entity_id")).select(F.col("id").alias("qid"), "vector")
    # the reference list is cut to k before entities that are gone drop out
    sem = materialize(rank_scores(vector_topk(q, g.vectors, k, SIMILAR_MIN, skip_self=True), k), "similar")
    rest = t.join(sem.select(F.col("qid").alias("id")), "id", "left_anti")
    struct = similar_by_structure(g, rest, k).select("target", F.lit("structure").alias("mode"), "id", "score", "rank")
    sem = sem.join(g.entities.select("id"), "id", "left_semi").select(
        F.col("qid").alias("target"), F.lit("semantic").alias("mode"), "id", F.round("score", 4).alias("score"), "rank")
    return sem.unionByName(struct)


def stale_vectors(g: Graph) -> DataFrame:
    """(id, text, state) of entities without a vector or with a changed text."""
    now = g.entities.select("id", entity_text().alias("text"))
    old = g.vectors.select(F.col("entity_id").alias("id"), F.col("text").alias("old"), F.lit(True).alias("has"))
    return now.join(old, "id", "left").where("has IS NULL OR NOT (old <=> text)").select(
        "id", "text", F.when(F.col("has"), "changed").otherwise("missing").alias("state"))


def orphan_vectors(g: Graph) -> DataFrame:
    return g.vectors.join(g.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")


def prune_orphan_vectors(g: Graph) -> Graph:
    live = g.vectors.join(g.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return g.with_tables(vectors=live)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by entity; of several new rows for an entity the latest wins."""
    cols = vectors.columns
    latest = new.groupBy("entity_id").agg(F.max_by(F.struct(*cols), "updated_at").alias("r")).select("r.*")
    return vectors.join(latest.select("entity_id"), "entity_id", "left_anti").select(*cols).unionByName(latest.select(*cols))


def embed_table(stale: DataFrame, fn: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors for (id, text) rows from ``fn``, called with batches of 32 texts inside the tasks."""

    def embed(batches):
        for pdf in batches:
            for i in range(0, len(pdf), EMBED_BATCH):
                part = pdf.iloc[i : i + EMBED_BATCH]
                vecs = fn(part["text"].tolist())
                if len(vecs) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vecs)} vectors")
                yield pd.DataFrame({"entity_id": part["id"].to_numpy(), "text": part["text"].to_numpy(), "vector": list(vecs)})

    ship_package(stale.sparkSession)
    out = stale.select("id", "text").mapInPandas(embed, "entity_id long, text string, vector array<float>")
    return out.withColumn("updated_at", fixed_now())


def embedding_status(g: Graph, configured: bool = True) -> DataFrame:
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c)).withColumn("one", F.lit(1))
    return one(g.vectors, "indexed").join(one(g.entities, "total_entities"), "one").select(
        F.lit(configured).alias("configured"), "indexed", "total_entities")


def mentions(questions: DataFrame, entities: DataFrame, cap: int | None = None, min_chars: int = 2) -> DataFrame:
    """(qid, id, name, rank): entities whose name (at least two characters) stands in the question text.

    The pieces of each question that have the length of some name join on the name, so questions and
    entities are not paired. ``cap`` keeps the first by id.
    """
    names = entities.select("id", "name").where(F.length("name") >= min_chars)
    lengths = [r[0] for r in names.select(F.length("name")).distinct().collect()]  # one value per name length
    if not lengths:
        return questions.select("qid").where(F.lit(False)).select(
            "qid", F.lit(0).cast("long").alias("id"), F.lit("").alias("name"), F.lit(0).alias("rank"))
    size = F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]))
    q = questions.select("qid", "text", size.alias("n")).where(F.length("text") >= F.col("n"))
    starts = F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)
    pieces = q.select("qid", F.explode(F.array_distinct(F.transform(starts, lambda p: F.col("text").substr(p, F.col("n"))))).alias("name"))
    hits = pieces.join(names, "name").select("qid", "id", "name")
    if cap is None:
        return hits.withColumn("rank", F.lit(0))
    w = Window.partitionBy("qid").orderBy("id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
