"""Document fingerprints by SpotSigs.

After every occurrence of a common word (an anchor, "spot") the next content words form a chain; the hashed
chains are the signatures of a text. Signature sets are compared by Jaccard, pruned by their lengths: sets
whose lengths differ too much cannot be similar, so documents are partitioned by set length and only
neighbouring partitions meet.
"""

import hashlib
import math
import re

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Hashes, map_batches, materialize, mix, only
from graphloom.llm.ngram_join import BUCKETS, bucket_counts, counter_rows

CHAIN = 2  # content words in a chain
SKETCH = 128  # signatures kept in a fingerprint: the smallest; a set of no more is kept whole
CELL_ROWS = 256  # sets of one signature that meet in one task, on either side
#: Anchors: frequent function words of English, German, Spanish and French.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his if in into is it its no not of on or she so that the their then there they "
    "this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch "
    "oder sich sie sind über um und von war was wie wir zu zum zur "
    "al como con de del e el en era es esta este fue ha la las le lo los más no o para pero por que se si sin son su sus un una y ya "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses "
    "son sont sur un une vous".split())
WORD = re.compile(r"\w+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Spots(Hashes):
    """Hash of a word; the lowest bit tells an anchor."""

    def __missing__(self, word):
        value = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1) | (word in ANCHORS)
        if len(self) < 200_000:
            self[word] = value
        return value


def signatures(text: str, spots: Spots, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text.

    An anchor with fewer than ``chain`` content words after it gives none. A text without any signature gets one made
    of its whole wording, or none if it is empty.
    """
    if not text:
        return np.empty(0, dtype=np.uint32)
    h = spots.array(WORD.findall(text.lower()))
    anchor = (h & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    first = np.searchsorted(content, at)
    keep = first + chain <= len(content)
    at, first = at[keep], first[keep]
    if not len(at):
        return np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 32], dtype=np.uint32)
    value = mix(h[at])
    for k in range(chain):
        value = mix(value * _A + h[content[first + k]] + _B)
    return np.unique((value >> np.uint64(32)).astype(np.uint32))


def set_hash(sigs: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sigs.astype(">u4").tobytes())


def fingerprint(sigs: np.ndarray, size: int = SKETCH) -> str:
    """Fingerprint text: number of signatures, then the smallest ``size`` of them and, if that is not all, a 128-bit
    hash of the whole set, all in hex. Different sets have different fingerprints."""
    return f"{len(sigs):08x}" + sigs[:size].astype(">u4").tobytes().hex() + (set_hash(sigs).hex() if len(sigs) > size else "")


def parse(fp: str, size: int = SKETCH) -> tuple[int, np.ndarray]:
    raw = bytes.fromhex(fp)
    n = int.from_bytes(raw[:4], "big")
    return n, np.frombuffer(raw[4:4 + 4 * min(n, size)], dtype=">u4").astype(np.uint32)


def likeness(a: str, b: str, at_least: float = 0.0, size: int = SKETCH) -> float:
    """Jaccard of two fingerprints, pruned: 0 as soon as the set lengths rule out ``at_least``.

    Exact while the sets are kept whole; else estimated from the ``size`` smallest signatures of the union.
    ``near_pairs`` does not use this but the whole sets.
    """
    if a == b:
        return 1.0
    (n, x), (m, y) = parse(a, size), parse(b, size)
    if not n or not m or min(n, m) < at_least * max(n, m):
        return 0.0
    common = np.intersect1d(x, y, assume_unique=True)
    if n <= size and m <= size:
        return len(common) / (n + m - len(common))
    union = np.union1d(x, y)
    # beyond the largest signature that a cut sketch keeps, nothing is known
    known = min([v[-1] for v, k in ((x, n), (y, m)) if k > size])
    union = union[union <= known][:size]
    most = min(n, m) / max(n, m) if n != m else (n - 1) / (n + 1)  # of different sets
    return min(most, float(np.isin(union, common, assume_unique=True).mean()))


def set_likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard of two whole signature sets, exact; two empty sets are alike (1)."""
    if len(x) == len(y) and (x == y).all():
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SKETCH) -> DataFrame:
    """(id, n_signatures, fingerprint) of every text; null texts count as empty. Rows are kept as they come."""
    def make():
        spots = Spots()

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    sets = [signatures(t or "", spots) for t in part.column(1).to_pylist()]
                    yield [part.column(0), [len(s) for s in sets], [fingerprint(s, size) for s in sets]]

        return run

    kind = dict(df.dtypes)[id_col]
    return map_batches(only(df, id_col, text_col), make, f"`{id_col}` {kind}, n_signatures bigint, fingerprint string")


def whole_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, sigs): the different non-empty signature sets of the texts, whole, under their 128-bit hash."""
    def make():
        spots = Spots()

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    sets = {set_hash(x): x for t in b.column(0).slice(lo, 256).to_pylist() if len(x := signatures(t or "", spots))}
                    yield [list(sets), [len(x) for x in sets.values()], [x.astype(">u4").tobytes() for x in sets.values()]]

        return run

    return map_batches(only(df, text_col), make, "key binary, n bigint, sigs binary").dropDuplicates(["key"])


def near_pairs(df: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, near_fingerprint, similarity) between different fingerprints of similarity ``at_least`` or more.

    Equal fingerprints are one class; join ``fingerprints`` to get its members. Classes are partitioned by set
    length in steps of 1/at_least, so a partner lies in the same or the next partition. Within these, classes
    meet on a signature of the prefix that a partner must share, rarest signatures first, if the signatures behind
    suffice; sets of a frequent signature meet in cells of CELL_ROWS by CELL_ROWS. Whole sets are compared, however
    long they are: the result is exact. Empty texts have no partners.
    """
    spark = df.sparkSession
    sets = materialize(whole_sets(df, id_col, text_col), "spots")

    def tally():
        def run(batches):
            counts = np.zeros(BUCKETS, dtype=np.uint32)
            for b in batches:
                for raw in b.column(0).to_pylist():
                    np.add.at(counts, np.frombuffer(raw, dtype=">u4").astype(np.int64) & (BUCKETS - 1), np.uint32(1))
            if counts.any():
                yield list(zip(*counter_rows(counts)))

        return run

    counts = spark.sparkContext.broadcast(bucket_counts(map_batches(sets.select("sigs"), tally, "chunk int, data binary"), BUCKETS))

    def post():
        def run(batches):
            often = counts.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    keys, ns, parts, sigs, at = [], [], [], [], []
                    for key, n, raw in zip(*(c.slice(lo, 256).to_pylist() for c in b.columns)):
                        x = np.frombuffer(raw, dtype=">u4").astype(np.int64)
                        size = n - math.ceil(n * at_least - 1e-9) + 1
                        x = x[np.lexsort((x, often[x & (BUCKETS - 1)]))][:size]  # any one order of all signatures is right
                        # a step is a little wider than 1/at_least, so that rounding never puts a partner two away
                        part = n if at_least >= 1 else int(math.log(n) / (math.log(1 / at_least) * (1 + 1e-9)))
                        keys += [key] * len(x)
                        ns += [n] * len(x)
                        parts += [part] * len(x)
                        sigs += x.tolist()
                        at += range(len(x))
                    yield [sigs, parts, keys, ns, at]

        return run

    prefix = materialize(map_batches(sets, post, "sig bigint, part int, key binary, n bigint, at int"), "prefixes")
    met = prefix.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("_rows"))
    near = F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part")
    lefts = met.select("sig", near, F.col("_rows").alias("_l"), F.lit(0).cast("long").alias("_r"))
    sides = lefts.union(met.select("sig", "part", F.lit(0).cast("long"), F.col("_rows"))).groupBy("sig", "part").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    cells = lambda c: F.ceil(F.col(c) / CELL_ROWS).cast("int")
    # signatures with two sets at least that can meet
    sides = materialize(sides.where("_r > 0 and _l > 1").select("sig", "part", cells("_l").alias("_a"), cells("_r").alias("_b")), "sides")
    own = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = prefix.select("sig", near, "key", "n", "at").join(sides, ["sig", "part"]).withColumn("_x", own("_a")).withColumn("_y", every("_b"))
    right = prefix.join(sides, ["sig", "part"]).withColumn("_y", own("_b")).withColumn("_x", every("_a"))
    right = right.select("sig", "part", "_x", "_y", F.col("key").alias("near_key"), F.col("n").alias("m"), F.col("at").alias("near_at"))
    rest = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("near_at"))  # common at most, if this is the first common one
    enough = rest >= F.ceil((F.col("n") + F.col("m")) * (at_least / (1 + at_least)) - 1e-6)
    shorter = F.struct("n", "key") < F.struct("m", "near_key")
    pairs = left.join(right, ["sig", "part", "_x", "_y"]).where(shorter & (F.col("n") >= F.col("m") * at_least - 1e-9) & enough).select("key", "near_key").distinct()

    def make():
        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    out = []
                    for one, two in zip(*(c.slice(lo, 256).to_pylist() for c in b.columns)):
                        x, y = (np.frombuffer(raw, dtype=">u4").astype(np.uint32) for raw in (one, two))
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if (alike := common / (len(x) + len(y) - common)) >= at_least:
                            out.append((fingerprint(x), fingerprint(y), alike))
                    if out:
                        yield list(zip(*out))

        return run

    facts = sets.select("key", "sigs")
    both = pairs.join(facts, "key").join(facts.select(F.col("key").alias("near_key"), F.col("sigs").alias("near_sigs")), "near_key")
    return map_batches(both.select("sigs", "near_sigs"), make, "fingerprint string, near_fingerprint string, similarity double")


def with_next(df: DataFrame, make, ddl: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Walk the documents in descending order of their ids, each with its successor (the first after the last).

    ``make()`` gives fn(id, text, next_text) -> row of ``ddl``. Ids are cut into ranges by quantiles; a range is one
    partition, sorted there, and gets a copy of the head of the next range. Texts travel compressed, once. Null ids
    come last; equal ids are ordered by their texts. An empty table gives no rows.
    """
    spark = df.sparkSession
    key = F.col(f"`{id_col}`").cast("long")
    docs = df.select(key.alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted({int(q) for q in docs.where("k is not null").approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)}), dtype=np.int64)

    def place(ids):  # descending: the largest ids are in range 0, null ids in the last
        arr = np.array([0 if v is None else v for v in ids], dtype=np.int64)
        where = len(cuts) - np.searchsorted(cuts, arr, side="right")
        where[[v is None for v in ids]] = len(cuts)
        return where

    def heads():
        def run(batches):
            for b in batches:
                ids = b.column(0).to_pylist()
                best: dict[int, int | None] = {}
                for p, v in zip(place(ids).tolist(), ids):
                    best[p] = v if best.get(p) is None else max(best[p], best[p] if v is None else v)
                yield [list(best), list(best.values())]

        return run

    found = map_batches(docs.select("k"), heads, "part int, head bigint").groupBy("part").agg(F.max("head").alias("head")).orderBy("part").collect()  # a row per range
    used = [r["part"] for r in found]
    ahead = {r["head"]: used[i - 1] for i, r in enumerate(found)}  # the range that this head follows

    def deal():
        zip_ = zstandard.ZstdCompressor(level=1)

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    ids = part.column(0).to_pylist()
                    rows = []
                    for p, k, t in zip(place(ids).tolist(), ids, part.column(1).to_pylist()):
                        data = zip_.compress((t or "").encode("utf-8", "surrogatepass"))
                        rows.append((p, 0, k, data))
                        if k in ahead:
                            rows.append((ahead[k], 1, k, data))
                    yield list(zip(*rows))

        return run

    ordered = map_batches(docs, deal, "part int, guest int, k bigint, data binary").repartitionById(len(cuts) + 1, F.col("part"))
    ordered = ordered.sortWithinPartitions("part", "guest", F.col("k").desc_nulls_last(), "data")

    def walk():
        each, unzip = make(), zstandard.ZstdDecompressor()

        def run(batches):
            held = None  # the document that waits for its successor
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    rows = []
                    for guest, k, data in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns[1:])):
                        text = unzip.decompress(data).decode("utf-8", "surrogatepass")
                        if held is not None:
                            rows.append(each(*held, text))
                        held = None if guest else (k, text)
                    if rows:
                        yield list(zip(*rows))

        return run

    return map_batches(ordered, walk, ddl)


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by the first as many code points of the other."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SKETCH) -> DataFrame:
    """Fingerprint of every text and of its edited text (see ``edited``; the other is the next document).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_signatures. Both likenesses are those of the whole sets, which are in hand here. Null texts count as empty; two empty
    texts are alike (1).
    """
    def make():
        spots = Spots()
        last: list = [None, None, None]  # the walk gives each text twice: as successor, then itself

        def known(text):
            if last[0] != text:
                sigs = signatures(text, spots)
                last[:] = text, sigs, fingerprint(sigs, size)
            return last[1], last[2]

        def each(k, text, other):
            own, fp = known(text)
            changed = edited(text, other)
            new = own if changed == text else signatures(changed, spots)
            new_fp = fp if new is own else fingerprint(new, size)
            beyond, _ = known(other)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return k, len(text), sha, fp, new_fp, set_likeness(own, new), set_likeness(own, beyond), len(own)

        return each

    ddl = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures bigint"
    return with_next(df, make, ddl, id_col, text_col)
