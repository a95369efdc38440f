"""Product codes of vectors by Lloyd's rounds over partition-local cover trees, in exact integer arithmetic.

1. Vectors become integers, are cut into equal parts and stay where they are: a task builds one cover tree a part over each
   block of its vectors. A node holds a centre, the radius of its points around it, their number and their sum.
2. In every round the entries of a codebook (a few numbers) go to the tasks. If, by the triangle inequality, one entry is
   nearest to all points of a node, the whole subtree is assigned to it by its sum. Only ambiguous nodes descend, with the
   entries that are left, and only points of ambiguous leaves are compared exactly.
3. Sums per part, entry and component come back, at most parts x entries x width numbers, whatever the table.
"""

import hashlib
import math
import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, materialize
from graphloom.session import broadcast_bounded

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096  # vectors of one tree
LEAF = 12  # points that are not divided further
LARGEST = 10 ** 25  # scaled components beyond are taken as this, so that sums fit 38 digits
_LONG = (1 << 63) - 1


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: 64-bit integers, or Python integers where squares would not fit."""
    if not values.size or np.abs(values).max() < 1 << 14:
        return np.floor(values * SCALE).astype(np.int64)
    clip = lambda v: max(-LARGEST, min(LARGEST, v))
    big = [clip(math.floor(x * SCALE) if abs(x) < 1 << 40 else int(x) * SCALE) for x in values.ravel().tolist()]
    out = np.empty(values.size, dtype=object)
    out[:] = big
    return out.reshape(values.shape)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (points x entries), exact."""
    if points.dtype == object or entries.dtype == object or points.shape[1] > 1 << 7:
        points, entries = points.astype(object), entries.astype(object)
    d = points[:, None, :] - entries[None, :, :]
    return (d * d).sum(axis=2) if d.shape[2] else np.zeros(d.shape[:2], dtype=np.int64)


def nearest(points: np.ndarray, entries: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest of the entries that are left for each point (at least one), ties to the lower index; and how many were tried."""
    at, entry = np.nonzero(left)
    p, e = points[at], entries[entry]
    if p.dtype == object or e.dtype == object or p.shape[1] > 1 << 7:
        p, e = p.astype(object), e.astype(object)
    d = p - e
    d = (d * d).sum(axis=1) if d.shape[1] else np.zeros(len(at), dtype=np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    low = np.minimum.reduceat(d, first)
    hit = np.flatnonzero(d == np.repeat(low, np.diff(np.r_[first, len(at)])))
    out = np.empty(len(points), dtype=np.int64)
    out[at[hit[::-1]]] = entry[hit[::-1]]  # the lowest index is written last
    return out, len(at)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


@dataclass
class CoverTree:
    """Nodes level by level. Points are in tree order, a node's in one range, its centre first; children are a range of nodes."""

    order: np.ndarray  # position of every point in the block
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # first child; the next node's first child ends the range
    sums: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> "CoverTree":
        """Children cover their node within half its radius or less, and their centres lie further apart than that."""
        n = len(points)
        order = np.arange(n)
        start, end, radius, child = [0], [n], [0.0], []
        at = 0
        while at < len(start):
            lo, hi = start[at], end[at]
            own = points[order[lo:hi]]
            far = _root(squares(own, own[:1])[:, 0])
            radius[at] = float(far.max())
            child.append(len(start))
            if hi - lo > LEAF and radius[at] > 0:
                reach = 2.0 ** (math.ceil(math.log2(radius[at])) - 1)
                left, pieces = np.arange(hi - lo), []
                near = far <= reach
                while True:
                    pieces.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
                    near = _root(squares(own[left], own[left[:1]])[:, 0]) <= reach
                order[lo:hi] = order[lo:hi][np.concatenate(pieces)]
                for piece in pieces:
                    start.append(lo)
                    lo += len(piece)
                    end.append(lo)
                    radius.append(0.0)
            at += 1
        child.append(len(start))
        start, end = np.array(start), np.array(end)
        points = points[order]
        total = np.zeros((n + 1, points.shape[1]), dtype=points.dtype)
        np.cumsum(points, axis=0, out=total[1:])
        return cls(order, points, start, end, np.array(radius), np.array(child), total[end] - total[start])

    def assign(self, entries: np.ndarray, each: bool = False):
        """(sums, counts) of the points nearest to every entry, ties to the lower index; with ``each``, also the entry of every
        point in tree order. Third comes the number of exact comparisons."""
        k = len(entries)
        sums = np.zeros((k, self.points.shape[1]), dtype=object if self.points.dtype == object else np.int64)
        counts = np.zeros(k, dtype=np.int64)
        chosen = np.zeros(len(self.points), dtype=np.int64) if each else None
        nodes, left = np.array([0]), np.ones((1, k), dtype=bool)
        exact = 0
        while len(nodes):
            d = np.where(left, _root(squares(self.points[self.start[nodes]], entries)), np.inf)
            exact += int(left.sum())
            low, r = d.min(axis=1), self.radius[nodes]
            # a margin far above the error of the roots
            left = d <= (low + 2 * r + 1e-9 * (low + r + 1))[:, None]
            one = left.sum(axis=1) == 1
            whole, entry = nodes[one], np.argmax(left[one], axis=1)
            np.add.at(sums, entry, self.sums[whole])
            np.add.at(counts, entry, self.end[whole] - self.start[whole])
            if each:
                for s, e, x in zip(self.start[whole], self.end[whole], entry):
                    chosen[s:e] = x
            nodes, left = nodes[~one], left[~one]
            leaf = self.child[nodes] == self.child[nodes + 1]
            size = self.end[nodes[leaf]] - self.start[nodes[leaf]]
            points = _ranges(self.start[nodes[leaf]], self.end[nodes[leaf]])
            if len(points):
                near, tried = nearest(self.points[points], entries, np.repeat(left[leaf], size, axis=0))
                exact += tried
                np.add.at(sums, near, self.points[points])
                counts += np.bincount(near, minlength=k)
                if each:
                    chosen[points] = near
            inner, left = nodes[~leaf], left[~leaf]
            nodes = _ranges(self.child[inner], self.child[inner + 1])
            left = np.repeat(left, self.child[inner + 1] - self.child[inner], axis=0)
        return sums, counts, exact, chosen


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite components, of the most frequent length (the larger of
    two that are)."""
    x = F.col(f"`{vector_col}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = df.where(x.isNotNull() & F.coalesce(fine, F.lit(False)))
    common = kept.groupBy(F.size(x).alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).first()
    return kept.where(F.size(x) == (common["_d"] if common else 0))


def plant(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(ids, labels, trees): a row per block of vectors, with a cover tree for every part."""
    kinds = dict(df.dtypes)

    def make():
        def block(ids, labels, rows):
            values = scaled(np.array(rows, dtype=np.float64))
            trees = [pickle.dumps(CoverTree.build(np.ascontiguousarray(v))) for v in np.array_split(values, parts, axis=1)]
            return [[ids], [labels], [trees]]

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    yield block(*(c.to_pylist() for c in b.slice(lo, BLOCK).columns))

        return run

    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"))
    return map_batches(rows, make, f"ids array<{kinds[id_col]}>, labels array<{kinds[label_col]}>, trees array<binary>")


def better(planted: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floor of the mean of what is nearest to an entry; an entry without parts stays."""
    def make():
        def run(batches):
            total, count = [0] * len(books), [0] * len(books)
            for b in batches:
                for trees in b.column(0):
                    for p, data in enumerate(trees):
                        sums, counts, _, _ = pickle.loads(data.as_py()).assign(books[p])
                        total[p], count[p] = total[p] + sums.astype(object), count[p] + counts
            rows = [(p, e, i, str(s), int(count[p][e])) for p in range(len(books)) if isinstance(total[p], np.ndarray)
                    for e in range(len(books[p])) if count[p][e] for i, s in enumerate(total[p][e])]
            if rows:
                yield list(zip(*rows))

        return run

    found = map_batches(planted.select("trees"), make, "part int, entry int, at int, s string, n bigint")
    found = found.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out = [b.astype(object) for b in books]
    for r in found:  # at most parts x entries x width rows
        out[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return [_tight(b) for b in out]


def _tight(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or max(abs(int(x)) for x in book.ravel()) <= SCALE << 14 else book


def encode(planted: DataFrame, books: list[np.ndarray], id_col: str, id_kind: str, label_kind: str) -> DataFrame:
    """(id, label, code, error): nearest entry of every part as two hex digits, and the squared distances summed."""
    def make():
        def run(batches):
            for b in batches:
                for ids, labels, trees in zip(*b.columns):
                    ids, labels = ids.as_py(), labels.as_py()
                    codes, errors = np.zeros((len(ids), len(books)), dtype=np.int64), np.zeros(len(ids), dtype=object)
                    for p, data in enumerate(trees):
                        tree = pickle.loads(data.as_py())
                        near = tree.assign(books[p], each=True)[3]
                        codes[tree.order, p] = near
                        d = tree.points.astype(object) - books[p].astype(object)[near]
                        errors[tree.order] += (d * d).sum(axis=1) if d.shape[1] else 0
                    yield [ids, labels, ["".join(f"{x:02x}" for x in c) for c in codes.tolist()], [min(int(e), _LONG) for e in errors]]

        return run

    return map_batches(planted, make, f"`{id_col}` {id_kind}, label {label_kind}, code string, error bigint")


def first_entries(df: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids (null ids last, equal ids by vector), as codebooks."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(v.alias("v"), F.col(f"`{id_col}`").alias("i")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return []
    return [_tight(b.astype(object)) for b in np.array_split(scaled(np.array([r["v"] for r in rows], dtype=np.float64)), parts, axis=1)]


def codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Product codes (id, label, code, error) of the usable vectors, and the codebooks (one array of integers a part).

    Null vectors, vectors with null or non-finite components and vectors of another length than the most frequent one take no
    part. Lengths that ``parts`` does not divide give parts that differ by one. Fewer vectors than ``entries`` give fewer
    entries. Null ids are coded like others; repeated rows give a row each. Scaled components beyond LARGEST count as that, and
    errors beyond a long as the largest one. An empty table gives no rows and no codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is two hex digits")
    kinds = dict(df.dtypes)
    kept = usable(df, vector_col)
    books = first_entries(kept, id_col, vector_col, parts, entries)
    if not books:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint"), []
    planted = materialize(plant(kept, id_col, vector_col, label_col, parts), "trees")
    for _ in range(rounds):
        books = better(planted, books)
    return materialize(encode(planted, books, id_col, kinds[id_col], kinds[label_col]), "codes"), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def label_errors(coded: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``coded`` with the sum of errors of its label, nulls being one label. Few labels are sent to the tasks; many are
    sorted and merged, where Spark splits frequent ones."""
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long").alias("label_error"))
    total = broadcast_bounded(total.select(F.col("label").alias("_label"), "label_error"), max_rows)
    return coded.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
