"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, split until no list holds much more than its share, and form an in-memory
graph that is searched greedily to store. Every vector is stored in its nearest list and, near a border, in further ones.
A query visits all lists whose centroids are about as near as the nearest one, however many these are. How near that is follows
the data: a bounded second sample tells at which ratio the lists hold the wanted share of true neighbours. Nearness is the inner product;
vectors get one more component that gives all the same length, so that it agrees with distance.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, materialize

SAMPLE = 20_000  # vectors that centroids are fitted on, at most
LIST_ROWS = 500  # wanted vectors a list
MAX_LISTS = 2_048  # lists at most; beyond, lists grow and are cut into blocks
BLOCK_ROWS = 4_096  # vectors of a list compared by one task at a time
REPLICAS, BORDER = 2, 1.02  # a vector is in lists up to this ratio of its distance to the nearest, in so many at most
RATIO, LEAST_LISTS = 1.13, 8  # a query visits lists up to this ratio or the fitted one, if larger, and at least so many
PROBE_ROWS, PROBES, SHARE = 10_000, 512, 0.95  # vectors the ratio is fitted on, queries among them, share of neighbours wanted
DEGREE, STORE_BEAM = 24, 16  # neighbours of a centroid in the graph; width of a search to store
SEED = 7


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2.0 * (x @ c.T), axis=1)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """About ``lists`` centroids of a sample: clusters above their share are split again and again."""
    rng = np.random.default_rng(seed)
    share = max(1, -(-len(x) // max(1, lists)))
    open_, done = [np.arange(len(x))], []
    while open_:
        rows = open_.pop()
        part = x[rows]
        k = min(16, -(-len(rows) // share))
        if k <= 1 or (part == part[0]).all():
            done.append(part.mean(0))
            continue
        c = part[rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            near = _nearest(part, c)
            c = np.stack([part[near == i].mean(0) if (near == i).any() else part[rng.integers(len(rows))] for i in range(k)])
        near = _nearest(part, c)
        groups = [rows[near == i] for i in range(k) if (near == i).any()]
        if len(groups) == 1:  # cannot be told apart: halve it
            groups = [rows[: len(rows) // 2], rows[len(rows) // 2:]]
        open_ += groups
    return np.stack(done)


class Centroids:
    """Centroids and their neighbour graph; ``search`` walks the graph for many vectors at once."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        n = len(points)
        sq = (self.points ** 2).sum(1)
        d = sq[:, None] + sq[None, :] - 2.0 * self.points @ self.points.T
        np.fill_diagonal(d, np.inf)
        self.graph = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, max(n - 1, 1))] if n > 1 else np.zeros((1, 1), dtype=np.int64)
        # entries far from each other, so that every region of the graph is reached
        far = [int(np.argmin(((self.points - self.points.mean(0)) ** 2).sum(1)))]
        gap = np.where(np.isfinite(d[far[0]]), d[far[0]], 0.0)
        while len(far) < min(n, 16):
            far.append(int(np.argmax(gap)))
            gap = np.minimum(gap, np.where(np.isfinite(d[far[-1]]), d[far[-1]], 0.0))
        self.entries = np.array(sorted(set(far)))

    def search(self, q: np.ndarray, beam: int = STORE_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of the nearest centroids found for every row of ``q``, nearest first; -1 fills up."""
        n, width = len(self.points), min(beam, len(self.points))
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        opened = np.zeros((len(q), n + 1), dtype=bool)
        opened[:, n] = True

        def distance(r, c):
            return np.sqrt(((q[r] - self.points[c]) ** 2).sum(-1))

        ids = np.full((len(q), width + len(self.entries)), n)
        dist = np.full(ids.shape, np.inf)
        ids[:, : len(self.entries)] = self.entries
        dist[:, : len(self.entries)] = distance(rows[:, None], self.entries[None, :])
        seen[:, self.entries] = True
        order = np.lexsort((ids, dist))[:, :width]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        while True:
            waiting = ~np.take_along_axis(opened, ids, 1)
            live = np.flatnonzero(waiting.any(1))
            if not len(live):
                break
            at = ids[live, waiting[live].argmax(1)]  # the nearest one not yet opened
            opened[live, at] = True
            near = self.graph[at]
            known = np.take_along_axis(seen[live], near, 1)
            d = distance(live[:, None], near)
            d[known] = np.inf
            seen[live[:, None], near] = True
            both_i = np.concatenate([ids[live], np.where(known, n, near)], axis=1)
            both_d = np.concatenate([dist[live], d], axis=1)
            order = np.argsort(both_d, axis=1, kind="stable")[:, :width]
            ids[live], dist[live] = np.take_along_axis(both_i, order, 1), np.take_along_axis(both_d, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def ranked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``search``, but with all centroids: no width ends the visit of a query, and none is out of the graph's reach."""
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (self.points ** 2).sum(1)[None, :] - 2.0 * (q @ self.points.T), 0.0))
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.take_along_axis(d, ids, 1)


def usable(vector):
    """Whether a vector takes part: not null, not all zero, every component a finite number."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


def on_sphere(x: np.ndarray, top: float) -> np.ndarray:
    """Stored vectors with the component that brings them all to length ``top``."""
    return np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))[:, None]], axis=1)


def query_on_sphere(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x * (top / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))], axis=1)


def fitted_ratio(x: np.ndarray, centroids: Centroids, top: float, rows: int, k: int) -> float:
    """Smallest ratio of distances at which a query's lists hold ``SHARE`` of its nearest vectors, read off the sample ``x``.

    The first ``PROBES`` vectors are the queries. Of ``rows`` vectors in all the sample has a part, and so has every query's
    neighbourhood: the nearest ``k`` times that part, one at least, stand for its ``k`` nearest. Where one stands for fewer
    than one, it lies farther than the true ones and the ratio errs to the large side.
    """
    if len(x) < 2:
        return RATIO
    ids = []
    for lo in range(0, len(x), 512):
        i, d = centroids.search(on_sphere(x[lo:lo + 512], top), STORE_BEAM)
        take = (i[:, :REPLICAS] >= 0) & (d[:, :REPLICAS] <= BORDER * d[:, :1] + 1e-12)
        ids.append(np.where(take, i[:, :REPLICAS], i[:, :1]))
    ids = np.concatenate(ids)
    n = min(max(1, -(-k * len(x) // max(rows, 1))), k, len(x) - 1)
    q = x[:PROBES]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argpartition(-score, n - 1, axis=1)[:, :n]
    order, dist = centroids.ranked(query_on_sphere(q, top))
    to = np.empty_like(dist)
    np.put_along_axis(to, order, dist, 1)
    least = to[np.arange(len(q))[:, None, None], ids[near]].min(2)
    apart = dist[:, 0] > 0  # a query that is a centroid has no ratio; it goes by the number of vectors its lists hold
    needed = least[apart] / dist[apart, :1]
    return max(RATIO, float(np.quantile(needed, SHARE, method="higher"))) if apart.any() else RATIO


def _lists(df: DataFrame, centroids, top: float, replicas: int | None, ratio: float, sizes: dict | None, k: int, carry: str) -> DataFrame:
    """Rows (key, v, list) of (key, v): stored vectors to at most ``replicas`` lists, queries (sizes given) to all within the ratio."""
    def make():
        def run(batches):
            c = centroids.value
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    x = np.stack([np.asarray(v, dtype=np.float64) for v in part.column(1).to_pylist()])
                    ids, dist = c.search(on_sphere(x, top), STORE_BEAM) if sizes is None else c.ranked(query_on_sphere(x, top))
                    take = (ids >= 0) & (dist <= ratio * dist[:, :1] + 1e-12)
                    if sizes is None:
                        take[:, replicas:] = False
                    else:
                        held = np.array([sizes.get(i, 0) for i in range(len(c.points))] + [0])[ids]
                        # enough lists that k different vectors are in them, each of which is in at most REPLICAS
                        short = np.concatenate([np.zeros((len(x), 1)), held.cumsum(1)[:, :-1]], axis=1) < k * REPLICAS
                        take |= (ids >= 0) & short
                        take[:, :LEAST_LISTS] |= ids[:, :LEAST_LISTS] >= 0
                    row, at = np.nonzero(take)
                    yield [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), ids[row, at].astype(np.int32)]

        return run

    return map_batches(df, make, f"{carry} bigint, v {dict(df.dtypes)['v']}, list int")


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``queries`` among the rows of ``df``
    with another id, by inner product in double precision; ties go to the smaller id. Fewer if there are fewer.

    Null, zero and non-finite vectors, null ids, and vectors whose length is not the most frequent one take no part.
    Copies of a vector are all found: of equal vectors only the k + 1 smallest ids can matter, so no more are
    stored, and equal queries are answered once. Repeated rows with one id count as one. Other columns are ignored.
    """
    spark: SparkSession = df.sparkSession

    def read(t):
        v = F.col(f"`{vector_col}`")
        return t.where(usable(v) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))

    stored = read(df).dropDuplicates(["id"])
    dims = stored.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    stored = stored.where(F.size("v") == dims["d"])
    copies = Window.partitionBy("v").orderBy("id")
    stored = materialize(stored.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k + 1).drop("_c"), "vectors")
    facts = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    top = float(np.sqrt(facts["top"]))

    # bounded: at most SAMPLE + PROBE_ROWS vectors come to the driver, at most MAX_LISTS centroids go out
    sample = stored.orderBy(F.xxhash64("id"), "id").limit(SAMPLE + PROBE_ROWS).collect()
    sample = np.array([r["v"] for r in sample], dtype=np.float64)
    lists = min(MAX_LISTS, -(-facts["n"] // list_rows))
    index = Centroids(balanced_centroids(on_sphere(sample[:SAMPLE], top), lists))
    ratio = fitted_ratio(sample[-PROBE_ROWS:], index, top, facts["n"], k)
    centroids = spark.sparkContext.broadcast(index)

    posted = materialize(_lists(stored, centroids, top, REPLICAS, BORDER, None, k, "id"), "postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    blocks = spark.createDataFrame([(i, -(-n // BLOCK_ROWS)) for i, n in sizes.items()], "list int, blocks int")
    dealt = posted.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    asked = materialize(read(queries).where(F.size("v") == dims["d"]).dropDuplicates(["id", "v"]), "queries")
    distinct = asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    visits = _lists(distinct, centroids, top, None, ratio, sizes, k + 1, "id").join(F.broadcast(blocks), "list")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    cols = ["list", "block", "role", "id", "v"]
    rows = dealt.withColumn("role", F.lit(0)).select(cols).union(visits.withColumn("role", F.lit(1)).select(cols))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", "block").sortWithinPartitions("list", "block", "role", "id")

    def make():
        def run(batches):
            name, ids, vectors, block = None, [], [], None
            for b in batches:
                out = ([], [], [], [])
                for lst, blk, role, key, v in zip(*(c.to_pylist() for c in b.columns)):
                    if (lst, blk) != name:
                        name, ids, vectors, block = (lst, blk), [], [], None
                    if role == 0:
                        ids.append(key)
                        vectors.append(v)
                        continue
                    if block is None:
                        block, known = np.array(vectors, dtype=np.float64), np.array(ids)
                    if not len(block):
                        continue
                    score = (block * np.array(v, dtype=np.float64)).sum(1)  # row by row, so equal vectors score alike
                    best = np.lexsort((known, -score))[: k + 1]
                    for column, x in zip(out, (key, lst, known[best], score[best])):
                        column.append(x)
                if out[0]:
                    yield list(out)

        return run

    found = map_batches(rows, make, "q bigint, list int, ids array<bigint>, scores array<double>")  # a row for each query and block
    each = F.zip_with("ids", "scores", lambda i, x: F.struct((-x).alias("low"), i.alias("vec_id")))
    # first the blocks of a list, then the lists, of which a query visits at most all; a vector in two lists counts once
    merged = lambda x, n: F.slice(F.sort_array(F.flatten(F.collect_list(x))), 1, n)
    whole = F.slice(F.array_distinct(merged("best", (k + 1) * REPLICAS)), 1, k + 1)
    top = found.groupBy("q", "list").agg(merged(each, k + 1).alias("best")).groupBy("q").agg(whole.alias("best"))
    heads = distinct.select(F.col("id").alias("q"), "v")
    mine = asked.select(F.col("id").alias("query_id"), "v").join(heads, "v").select("query_id", "q").join(top, "q")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.low")).alias("score"))
