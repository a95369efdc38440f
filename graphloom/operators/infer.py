"""Virtual relations by transitive, symmetric and inverse rules."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.graph import Graph
from graphloom.operators.frontier import HUB_ROWS, union
from graphloom.operators.match import touching
from graphloom.session import broadcast_bounded, materialize

WASTE = 4.0  # rows that a round of the closure may join, per chain known; decides how far it reaches, not what is found
COLUMNS = ["source_id", "target_id", "name", "category", "rule", "via"]


@dataclass(frozen=True)
class Ontology:
    """Rule names; held as plain lists since a rule table is written by hand."""

    transitive: tuple
    symmetric: tuple
    inverse: tuple


def normalize_ontology(raw: dict | None) -> Ontology:
    """Trimmed rule lists; blank names and inverse entries that are not two texts are dropped."""
    raw = raw if isinstance(raw, dict) else {}
    names = lambda v: tuple(x.strip() for x in v if isinstance(x, str) and x.strip()) if isinstance(v, (list, tuple)) else ()
    pairs = raw.get("inverse") if isinstance(raw.get("inverse"), (list, tuple)) else ()
    good = [p for p in pairs if isinstance(p, (list, tuple)) and len(p) == 2 and len(names(p)) == 2]
    return Ontology(names(raw.get("transitive")), names(raw.get("symmetric")), tuple(names(p) for p in good))


DEFAULT_ONTOLOGY = normalize_ontology(
    {"transitive": S.TRANSITIVE_NAMES, "symmetric": S.SYMMETRIC_NAMES, "inverse": S.INVERSE_NAMES})


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "source_id long, target_id long, name string, category string, rule string, via array<bigint>")


def _salted(left: DataFrame, right: DataFrame, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of chains with a column ``salt``: the right halves of a middle with over ``hub_rows`` of them are spread."""
    hubs = materialize(right.groupBy("code", F.col("s").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / hub_rows).cast("int").alias("salts"))
                       .where("salts > 1"), "hubs")
    if hubs.isEmpty():
        return left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    at = lambda df, node: df.join(broadcast_bounded(hubs.withColumnRenamed("hub", node)), ["code", node], "left")
    salts = F.coalesce("salts", F.lit(1))
    return (at(left, "t").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"),
            at(right, "s").withColumn("salt", F.pmod(F.xxhash64("t"), salts).cast("int")).drop("salts"))


def _reach(left: DataFrame, right: DataFrame, m: int, known: int) -> int:
    """How long right halves may be: the largest power of two up to ``m`` at which the join stays within ``WASTE`` times the
    chains known, one at least. In trees and long chains that is ``m``; where nodes lie close together, joining whole halves would
    mostly find known pairs again."""
    step = F.pow(F.lit(2.0), F.ceil(F.log2("d"))).cast("long")
    ends = left.groupBy("code", F.col("t").alias("s")).agg(F.count(F.lit(1)).alias("a"))
    starts = right.groupBy("code", "s", step.alias("step")).agg(F.count(F.lit(1)).alias("b"))
    sizes = ends.join(starts, ["code", "s"]).groupBy("step").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("n"))
    total, best = 0.0, 1
    for r in sizes.orderBy("step").collect():  # a row for each power of two
        total += r["n"]
        if r["step"] <= m and total <= WASTE * known:
            best = r["step"]
    return best


def chains(rel: DataFrame, hub_rows: int = HUB_ROWS) -> DataFrame | None:
    """(code, s, t, d, via) for all pairs two or more steps apart, of edges (code, s, t, id): the smallest shortest chain of ids.

    Knowing all pairs up to distance m, a round joins those at distance m to those up to distance b and so gets all up to m + b:
    the first m steps and the rest of a smallest shortest chain are themselves smallest and shortest. With b = m distances
    double, so a chain of n edges takes about log2(n) rounds. A self-loop is no step; None if no pair is that far apart.
    """
    first = rel.where("s <> t").groupBy("code", "s", "t").agg(F.min("id").alias("id"))
    part, known = materialize(first.select("code", "s", "t", F.lit(1).cast("long").alias("d"), F.array("id").alias("via")), "chains", counted=True)
    parts, m = [part], 1
    while True:
        rows = union(parts)
        left = part.where(F.col("d") == m)
        b = _reach(left, rows, m, known)
        left, right = _salted(left, rows.where(F.col("d") <= b), hub_rows)
        rest = right.select("code", "salt", F.col("s").alias("t"), F.col("t").alias("end"), F.col("d").alias("more"), F.col("via").alias("rest"))
        met = left.join(rest, ["code", "salt", "t"]).where("s <> end")
        best = F.min(F.struct((F.col("d") + F.col("more")).alias("d"), F.concat("via", "rest").alias("via"))).alias("x")
        found = met.groupBy("code", "s", F.col("end").alias("t")).agg(best).select("code", "s", "t", "x.d", "x.via")
        part, n = materialize(found.join(rows, ["code", "s", "t"], "left_anti"), "chains", counted=True)
        if n == 0:
            break
        parts.append(part)
        m, known = m + b, known + n
        if part.where(F.col("d") == m).isEmpty():
            break
    return union(parts[1:]) if len(parts) > 1 else None


def infer_transitive(g: Graph, ont: Ontology = DEFAULT_ONTOLOGY, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Closure per transitive name without the explicit triples; ``via`` is the smallest shortest chain."""
    if not ont.transitive:
        return _empty(g.spark)
    rel = g.relations.where(F.col("name").isin(list(ont.transitive)))
    # one integer per name keeps the edge key numeric and the search within one name
    code = F.array_position(F.array(*[F.lit(n) for n in ont.transitive]), F.col("name")).cast("long")
    rel = materialize(rel.select("id", F.col("source_id").alias("s"), F.col("target_id").alias("t"), "name", "category", code.alias("code")), "rules")
    far = chains(rel, hub_rows)
    if far is None:
        return _empty(g.spark)
    first = rel.select(F.col("id").alias("first"), "name", "category")
    rows = far.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "via", F.element_at("via", 1).alias("first"))
    return rows.join(first, "first").select(
        "source_id", "target_id", "name", "category", F.concat(F.lit("传递性("), "name", F.lit(")")).alias("rule"), "via")


def _explicit(g: Graph) -> DataFrame:
    return g.relations.select("source_id", "target_id", "name")


def _first(rows: DataFrame) -> DataFrame:
    """One row per triple: the lowest rule order, then the lowest relation id."""
    best = rows.groupBy("source_id", "target_id", "name").agg(
        F.min(F.struct("ord", "id", "category", "rule")).alias("m"))
    return best.select("source_id", "target_id", "name", "m.category", "m.rule", F.array("m.id").alias("via"))


def infer_symmetric(g: Graph, ont: Ontology = DEFAULT_ONTOLOGY) -> DataFrame:
    """Reverse edge of every symmetric relation unless it is explicit."""
    rel = g.relations.where(F.col("name").isin(list(ont.symmetric)) & (F.col("source_id") != F.col("target_id")))
    rows = rel.select(
        F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "name", "category",
        F.concat(F.lit("对称性("), "name", F.lit(")")).alias("rule"), F.lit(0).alias("ord"), "id")
    return _first(rows.join(_explicit(g), ["source_id", "target_id", "name"], "left_anti"))


def infer_inverse(g: Graph, ont: Ontology = DEFAULT_ONTOLOGY) -> DataFrame:
    """For a rule (p, q) an edge p gives the reverse edge q, in this direction only."""
    if not ont.inverse:
        return _empty(g.spark)
    rules = g.spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(ont.inverse)], "ord int, p string, q string")
    rel = g.relations.join(broadcast_bounded(rules), F.col("name") == F.col("p"))
    rows = rel.select(
        F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("q").alias("name"), "category",
        F.concat(F.lit("逆关系("), "p", F.lit(" ↔ "), "q", F.lit(")")).alias("rule"), "ord", "id")
    return _first(rows.join(_explicit(g), ["source_id", "target_id", "name"], "left_anti"))


def infer_all(g: Graph, ont: Ontology = DEFAULT_ONTOLOGY, centers: DataFrame | None = None) -> DataFrame:
    """Transitive, then symmetric, then inverse results; a triple keeps its first rule. Names joined."""
    key = ["source_id", "target_id", "name"]
    t = infer_transitive(g, ont)
    s = infer_symmetric(g, ont).join(t.select(*key), key, "left_anti")
    ts = t.select(*COLUMNS).unionByName(s.select(*COLUMNS))
    i = infer_inverse(g, ont).join(ts.select(*key), key, "left_anti")
    rows = ts.unionByName(i.select(*COLUMNS))
    if centers is not None:
        rows = touching(rows, centers)
    name = lambda c, out: g.entities.select(F.col("id").alias(c), F.col("name").alias(out))
    return rows.join(name("source_id", "source"), "source_id", "left").join(name("target_id", "target"), "target_id", "left")


def inferred_entities(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
