"""Ego subgraphs, shortest paths, path enumeration, evidence paths."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, undirected_edges
from graphloom.operators.frontier import HUB_ROWS, build_adjacency, first_level, levels_from, next_level, union, with_level
from graphloom.session import at_least, broadcast_bounded, materialize, with_position

LONGS = "array<bigint>"
BITS = 63  # centers that walk together, a bit each


def ego_levels(g: Graph, centers: DataFrame, depth: int | None = None, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(center, id, level) by undirected breadth-first search; depth None or 0 means all levels.

    Up to 63 centers walk together: a level holds a node once, with a bit for every center that gets there, so edges are met
    once a level and not once for each center.
    """
    known = centers.select("id").distinct().join(g.entities.select("id"), "id", "left_semi")
    adj = build_adjacency(undirected_edges(g.relations), hub_rows)
    at = with_position(known, "id").select(
        F.col("id").alias("center"), F.floor(F.col("pos") / BITS).alias("pack"), F.pmod("pos", F.lit(BITS)).cast("int").alias("bit"))
    at = materialize(at, "centers")
    levels = [materialize(at.select("pack", F.col("center").alias("node"), F.expr("shiftleft(1L, bit)").alias("mask")), "level")]
    while not depth or len(levels) <= depth:
        step = adj.expand(levels[-1]).select("pack", F.col("dst").alias("node"), F.col("mask").alias("new"), F.lit(0).cast("long").alias("old"))
        # edges lead both ways, so the last two levels tell new nodes from old ones
        old = union([lv.select("pack", "node", F.lit(0).cast("long").alias("new"), F.col("mask").alias("old")) for lv in levels[-2:]])
        step = step.unionByName(old).groupBy("pack", "node").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        step = step.select("pack", "node", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask")).where("mask <> 0")
        step, rows = materialize(step, "level", counted=True)
        if rows == 0:
            break
        levels.append(step)
    set_bits = F.expr(f"filter(sequence(0, {BITS - 1}), i -> (shiftright(mask, i) & 1) = 1)")
    return with_level(levels).select("pack", "node", "level", F.explode(set_bits).alias("bit")).join(broadcast_bounded(at), ["pack", "bit"]).select(
        "center", F.col("node").alias("id"), F.col("level").cast("int").alias("level"))


def unknown_centers(g: Graph, centers: DataFrame) -> DataFrame:
    return centers.select("id").distinct().join(g.entities.select("id"), "id", "left_anti")


def ego(g: Graph, centers: DataFrame, depth: int | None = None):
    """Entities with their level and the induced relations, each with the center they belong to."""
    lv = materialize(ego_levels(g, centers, depth), "ego")
    nodes = lv.join(g.entities, "id")
    s = lv.select("center", F.col("id").alias("source_id"))
    t = lv.select("center", F.col("id").alias("target_id"))
    return nodes, g.relations.join(s, "source_id").join(t, ["center", "target_id"], "left_semi")


def shortest_paths(g: Graph, pairs: DataFrame, max_hops: int = 6, hub_rows: int = HUB_ROWS, rows_seen: list | None = None) -> DataFrame:
    """(source_id, target_id, found, hops, path, nodes) per pair; ``path`` holds relation ids in order.

    Among shortest paths the smallest relation-id sequence wins. Every distinct source and every distinct target searches on its
    own, one level of all sources or of all targets at a time, whichever frontier is smaller; a pair is done when a node of the
    last levels of both ends is the same. ``rows_seen`` gets the number of rows of every level grown.
    """
    pairs = materialize(pairs.select("source_id", "target_id").distinct(), "pairs")
    open_pairs, n_open = materialize(pairs.where("source_id <> target_id"), "open", counted=True)
    adj = build_adjacency(undirected_edges(g.relations), hub_rows)
    ends = ["source_id", "target_id"]
    sides = {c: [first_level(open_pairs.select(F.col(c).alias("key"), F.col(c).alias("node")), ["key"])] for c in ends}
    size = {c: s[0].count() for c, s in sides.items()}
    met: list[tuple[int, int, DataFrame]] = []
    while n_open and sum(len(s) - 1 for s in sides.values()) < max_hops:
        side = min(ends, key=lambda c: (size[c], c == "source_id"))  # of equal ones the targets, whose links lead back by themselves
        live = sides[side][-1].join(open_pairs.select(F.col(side).alias("key")).distinct(), "key", "left_semi")
        level, size[side] = next_level(adj, sides[side], ["key"], live)
        sides[side].append(level)
        if rows_seen is not None:
            rows_seen.append(size[side])
        if size[side] == 0:
            break  # no open pair is connected
        hit, hits = materialize(_meetings(open_pairs, sides), "met", counted=True)
        if hits:
            met.append((len(sides["source_id"]) - 1, len(sides["target_id"]) - 1, hit))
            open_pairs, n_open = materialize(open_pairs.join(hit.select(*ends).distinct(), ends, "left_anti"), "open", counted=True)
    empty = F.array().cast(LONGS)
    done = [_smallest(adj, sides, *m) for m in met]
    self_pairs = pairs.where("source_id = target_id").join(
        g.entities.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    done.append(self_pairs.select(*ends, empty.alias("path"), F.array("source_id").alias("nodes")))
    return pairs.join(union(done), ends, "left").select(
        *ends, F.col("path").isNotNull().alias("found"), F.when(F.col("path").isNotNull(), F.size("path")).alias("hops"), "path", "nodes")


def _meetings(open_pairs: DataFrame, sides: dict) -> DataFrame:
    """(source_id, target_id, node): nodes that the last levels of both ends of an open pair share."""
    last = {c: s[-1].select(F.col("key").alias(c), "node") for c, s in sides.items()}
    return open_pairs.join(last["source_id"], "source_id").join(last["target_id"], ["target_id", "node"], "left_semi").select("source_id", "target_id", "node")


def _smallest(adj, sides: dict, ahead: int, behind: int, met: DataFrame) -> DataFrame:
    """(source_id, target_id, path, nodes) of the pairs that meet ``ahead`` levels from their source and ``behind`` from their target.

    Edges between the source and a meeting node are collected level by level from there; from the source, the smallest of them
    is taken at every step. Behind the meeting node the levels of the target tell the way.
    """
    key = ["source_id", "target_id"]
    links, now = [], met
    for depth in range(ahead, 0, -1):
        before = sides["source_id"][depth - 1].select(F.col("key").alias("source_id"), "node").join(now.select("source_id").distinct(), "source_id", "left_semi")
        step = adj.expand(before).join(now.select(*key, F.col("node").alias("dst")), ["source_id", "dst"])
        links.append(materialize(step.select(*key, "node", "rel_id", F.col("dst").alias("to")), "links"))
        now = links[-1].select(*key, "node").distinct()
    walk = met.select(*key).distinct().select(*key, F.col("source_id").alias("node"), F.array().cast(LONGS).alias("path"), F.array("source_id").alias("nodes"))
    for step in reversed(links):
        best = step.groupBy(*key, "node").agg(F.min(F.struct("rel_id", "to")).alias("m"))
        walk = walk.join(best, [*key, "node"]).select(
            *key, F.col("m.to").alias("node"), F.concat("path", F.array("m.rel_id")).alias("path"), F.concat("nodes", F.array("m.to")).alias("nodes"))
    for depth in range(behind, 0, -1):
        step = sides["target_id"][depth].select(F.col("key").alias("target_id"), "node", "next_rel", "next_node")
        walk = walk.join(step, ["target_id", "node"]).select(
            *key, F.col("next_node").alias("node"), F.concat("path", F.array("next_rel")).alias("path"), F.concat("nodes", F.array("next_node")).alias("nodes"))
    return walk.drop("node")


def all_paths(g: Graph, pairs: DataFrame, max_hops: int = 4, limit: int = 5, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Simple undirected paths per pair, by hops then relation-id sequence, at most ``limit`` each.

    (source_id, target_id, rank, hops, path, nodes). At a node with an edge to the target, edges after
    the first such edge are not followed. A partial path lives only while the target can still be
    reached within the hops left, which a search from the target tells. That search grows by a level only when its last one has no
    more rows than there are partial paths to drop; until it reaches as far as the hops left, all of them live.
    """
    max_hops, limit = at_least(max_hops, 1, "max_hops"), at_least(limit, 1, "limit")
    ids = g.entities.select("id")
    pairs = pairs.select("source_id", "target_id").distinct()
    pairs = pairs.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")
    pairs = materialize(pairs, "pairs")
    adj = build_adjacency(undirected_edges(g.relations), hub_rows)
    key = ["source_id", "target_id"]
    seeds = pairs.where("source_id <> target_id").select(F.col("target_id").alias("key"), F.col("target_id").alias("node"))
    levels = levels_from(adj, seeds, ["key"], 1)
    stop, size = None, 0
    if len(levels) > 1:
        size = levels[1].count()
        stop = levels[1].select(F.col("key").alias("target_id"), "node", F.col("next_rel").alias("stop"))

    def near(df, left):
        if left == 0:
            return df.where("node = target_id")
        reach = with_level(levels[:left + 1]).select(F.col("key").alias("target_id"), "node")
        return df.join(reach, ["target_id", "node"], "left_semi").select(df.columns)

    empty = F.array().cast(LONGS)
    zero = pairs.where("source_id = target_id").select(*key, F.lit(0).alias("hops"), empty.alias("path"), F.array("source_id").alias("nodes"))
    found = [zero]
    part = pairs.where("source_id <> target_id").select(
        *key, F.col("source_id").alias("node"), empty.alias("path"), F.array("source_id").alias("nodes"))
    for depth in range(1, max_hops + 1):
        if stop is None:
            break
        grown = adj.expand(part).where(~F.array_contains("nodes", F.col("dst")))
        grown = grown.join(stop, ["target_id", "node"], "left").where("stop IS NULL OR rel_id <= stop")
        grown = grown.where("dst <> target_id OR rel_id = stop").select(
            *key, F.col("dst").alias("node"), F.concat("path", F.array("rel_id")).alias("path"),
            F.concat("nodes", F.array("dst")).alias("nodes"))
        left = max_hops - depth
        if len(levels) > left or size == 0:
            grown, n = materialize(near(grown, left), "paths", counted=True)
        else:
            grown, n = materialize(grown, "paths", counted=True)
            while len(levels) <= left and 0 < size <= n:
                level, size = next_level(adj, levels, ["key"], levels[-1])
                levels.append(level)
            if len(levels) > left or size == 0:
                grown, n = materialize(near(grown, left), "paths", counted=True)
        if n == 0:
            break
        found.append(grown.where("node = target_id").select(*key, F.lit(depth).alias("hops"), "path", "nodes"))
        full = union(found).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
        part = grown.where("node <> target_id").join(full, key, "left_anti")
    w = Window.partitionBy(*key).orderBy("hops", "path")
    return union(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        *key, "rank", "hops", "path", "nodes")


def evidence_paths(members: DataFrame, set_relations: DataFrame, answers: DataFrame | None = None, cap: int = 6) -> DataFrame:
    """Up to ``cap`` evidence paths of 1 to 3 hops inside each entity set.

    ``members`` (set_id, pos, id, name), ``set_relations`` (set_id, rpos, rel_id, source_id, target_id),
    ``answers`` (set_id, text). Seeds are the members named in the answer when there are at least two,
    else all. Single edges come first in relation order, then paths seed by seed without repeating a set
    of relations. A set with ``cap`` or more inner edges is complete after the first step, so longer
    paths are only walked in sets with fewer edges than that.
    """
    seeds = members
    if answers is not None:
        named = members.join(answers.where("text IS NOT NULL"), "set_id").where(
            (F.col("name") != "") & F.contains("text", F.col("name"))).drop("text")
        enough = named.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("set_id")
        seeds = named.join(enough, "set_id", "left_semi").unionByName(members.join(enough, "set_id", "left_anti"))
    several = seeds.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("set_id")
    seeds = materialize(seeds.join(several, "set_id", "left_semi").select("set_id", "pos", "id"), "seeds")
    src = seeds.select("set_id", F.col("id").alias("source_id"))
    tgt = seeds.select("set_id", F.col("id").alias("target_id"))
    inner = set_relations.join(src, ["set_id", "source_id"], "left_semi").join(tgt, ["set_id", "target_id"], "left_semi")
    inner = inner.groupBy("set_id", "rel_id", "source_id", "target_id").agg(F.min("rpos").alias("rpos"))
    inner = materialize(inner, "inner")
    one = inner.select(
        "set_id", F.array(F.lit(-1).cast("long"), F.lit(1).cast("long"), "rpos").alias("ord"), F.array("rel_id").alias("path"))
    small = inner.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < cap).select("set_id")
    edges = inner.join(small, "set_id", "left_semi")
    both = edges.select("set_id", F.col("source_id").alias("node"), F.col("target_id").alias("dst"), "rel_id", "rpos").unionByName(
        edges.where("source_id <> target_id").select(
            "set_id", F.col("target_id").alias("node"), F.col("source_id").alias("dst"), "rel_id", "rpos"))
    part = seeds.join(small, "set_id", "left_semi").select(
        "set_id", "pos", F.col("id").alias("node"), F.array().cast(LONGS).alias("path"), F.array().cast(LONGS).alias("steps"), F.array("id").alias("nodes"))
    out = [one]
    for hops in (1, 2, 3):
        part = part.join(both, ["set_id", "node"]).where(~F.array_contains("nodes", F.col("dst"))).select(
            "set_id", "pos", F.col("dst").alias("node"), F.concat("path", F.array("rel_id")).alias("path"),
            F.concat("steps", F.array("rpos")).alias("steps"), F.concat("nodes", F.array("dst")).alias("nodes"))
        if hops > 1:
            head = F.array(F.col("pos").cast("long"), F.lit(hops).cast("long"))
            out.append(part.select("set_id", F.concat(head, "steps").alias("ord"), "path"))
    every = union(out).withColumn("rels", F.array_sort("path"))
    first = every.groupBy("set_id", "rels").agg(F.min(F.struct("ord", "path")).alias("m"))
    w = Window.partitionBy("set_id").orderBy("m.ord")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select(
        "set_id", "rank", F.size("m.path").alias("hops"), F.col("m.path").alias("path"))
