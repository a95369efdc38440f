"""Exact deduplication with an index of live digests: cuckoo filters over bucketed keys and contents.

Documents are equal when their texts are, after lower-casing A-Z. The index holds, per bucket of digests, a cuckoo filter
of the live digests and the stored keys with their contents. A digest that the filter does not know is new; a hit is
looked up among the bucket's keys and verified against the stored content. Digests leave the filter when their last document
is deleted. A filter that overflows is rebuilt at twice the size from the stored keys.

A task first combines the copies it meets itself, by the same filter, so that a text of very many copies reaches its bucket
once a task, and its ids stay in rows of at most ``CHUNK_IDS``.
"""

import hashlib
from array import array
from dataclasses import dataclass

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import distribute, map_batches, materialize, only

CHUNK_IDS = 1000  # ids in one row of members
TASK_BYTES = 48 << 20  # compressed contents that a task holds before it passes them on
TASK_IDS = 500_000
BUCKET_BYTES = 16 << 20  # compressed contents of a bucket of the index, about
START_SLOTS = 64  # a filter begins so small and grows by overflow
KICKS = 200


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; every digest has two buckets. Inserts are all kept, so a delete takes
    out exactly one."""

    WAYS = 4

    def __init__(self, slots: int = START_SLOTS, data: bytes | None = None):
        self.slots = array("H", data if data is not None else bytes(2 * slots))
        self.mask = len(self.slots) // self.WAYS - 1
        if (self.mask + 1) & self.mask:
            raise ValueError("the number of buckets must be a power of two")

    @staticmethod
    def _hash(digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little"), (int.from_bytes(digest[8:10], "little") or 1)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _put(self, at: int, mark: int) -> bool:
        for i in range(at * self.WAYS, (at + 1) * self.WAYS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False on overflow; some fingerprint is then without a place, and the filter must be rebuilt."""
        h, mark = self._hash(digest)
        at = h & self.mask
        if self._put(at, mark):
            return True
        at = self._other(at, mark)
        for kick in range(KICKS):
            if self._put(at, mark):
                return True
            i = at * self.WAYS + kick % self.WAYS
            mark, self.slots[i] = self.slots[i], mark
            at = self._other(at, mark)
        return False

    def _find(self, digest: bytes) -> int:
        h, mark = self._hash(digest)
        at = h & self.mask
        for bucket in (at, self._other(at, mark)):
            for i in range(bucket * self.WAYS, (bucket + 1) * self.WAYS):
                if self.slots[i] == mark:
                    return i
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) >= 0

    def delete(self, digest: bytes) -> bool:
        """Take out one fingerprint of a digest that was inserted."""
        i = self._find(digest)
        if i < 0:
            return False
        self.slots[i] = 0
        return True

    def tobytes(self) -> bytes:
        return self.slots.tobytes()


class Live:
    """A filter with its stored keys: digest -> entry, whose first item is the compressed content."""

    def __init__(self, data: bytes | None = None):
        self.filter = CuckooFilter(data=data) if data is not None else CuckooFilter()
        self.keys: dict[bytes, list] = {}
        self.unzip = zstandard.ZstdDecompressor()

    def stored(self, digest: bytes, entry: list) -> None:
        """A key that the filter knows already."""
        self.keys[digest] = entry

    def find(self, digest: bytes, content: bytes) -> list | None:
        """The entry of this content, or None where it is new."""
        if digest not in self.filter:
            return None
        entry = self.keys.get(digest)
        if entry is None:
            return None  # another digest's fingerprint
        if self.unzip.decompress(entry[0]) != content:
            raise RuntimeError("two contents with one SHA-256")
        return entry

    def add(self, digest: bytes, entry: list) -> None:
        self.keys[digest] = entry
        if not self.filter.insert(digest):
            self.resize()

    def remove(self, digest: bytes) -> None:
        if self.keys.pop(digest, None) is not None and not self.filter.delete(digest):
            raise RuntimeError("a live digest is missing in its filter")

    def resize(self) -> None:
        """Twice the slots, or more, until all stored keys have a place."""
        slots = len(self.filter.slots)
        while True:
            slots *= 2
            self.filter = CuckooFilter(slots)
            if all(map(self.filter.insert, self.keys)):
                return


@dataclass
class DigestIndex:
    """filters (bucket, slots), keys (bucket, digest, content, n, keep_id, e, keep_at) and members (digest, e, ids)."""

    filters: DataFrame
    keys: DataFrame
    members: DataFrame
    buckets: int
    id_col: str
    kind: str


def _better(a, b) -> bool:
    """Whether the keeper a (id, e, at) goes before b: larger id, then the earlier row. Null ids come last."""
    x, y = (a[0] is not None, a[0]), (b[0] is not None, b[0])
    return x > y if x[0] != y[0] or (x[0] and a[0] != b[0]) else a[1:] < b[1:]


def entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, e, ids, content, size, n, keep_id, keep_e, keep_at): the documents of a task by content.

    Rows hold up to CHUNK_IDS ids; the first row of a content also holds the content, the number of documents and the keeper.
    """
    kind = dict(df.dtypes)[id_col]

    def make():
        def run(batches):
            number = TaskContext.get().partitionId() << 40
            zip_ = zstandard.ZstdCompressor(level=3)
            live, size, held = Live(), 0, 0

            def out():
                nonlocal number
                rows = []
                for digest, (content, ids) in live.keys.items():
                    keeper, first = None, len(rows)
                    for lo in range(0, len(ids), CHUNK_IDS):
                        part = ids[lo:lo + CHUNK_IDS]
                        best = max((x for x in part if x is not None), default=None)
                        own = (best, number, part.index(best))
                        if keeper is None or _better(own, keeper):
                            keeper = own
                        rows.append([digest, number, part, None, None, None, None, None, None])
                        number += 1
                    rows[first][3:] = [content, len(content), len(ids), *keeper]
                for lo in range(0, len(rows), 2000):
                    yield list(zip(*rows[lo:lo + 2000]))

            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        raw = (text or "").encode("utf-8", "surrogatepass").lower()
                        digest = hashlib.sha256(raw).digest()
                        entry = live.find(digest, raw)
                        if entry is None:
                            entry = [zip_.compress(raw), []]
                            live.add(digest, entry)
                            size += len(entry[0])
                        entry[1].append(key)
                        held += 1
                    if size > TASK_BYTES or held > TASK_IDS:
                        yield from out()
                        live, size, held = Live(), 0, 0
            yield from out()

        return run

    ddl = f"digest binary, e bigint, ids array<{kind}>, content binary, size bigint, n bigint, keep_id {kind}, keep_e bigint, keep_at int"
    return map_batches(only(df, id_col, text_col), make, ddl)


KEY = ("digest", "content", "n", "keep_id", "keep_e", "keep_at")


def _apply(index: DigestIndex, dead: DataFrame | None, new: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Filters and keys after the digests ``dead`` have left and the entries ``new`` have come; only their buckets are read."""
    spark = index.keys.sparkSession
    bucket = F.pmod(F.xxhash64("digest"), F.lit(index.buckets)).cast("int").alias("bucket")
    null = lambda cols: [F.lit(None).cast(dict(index.keys.dtypes)[c]).alias(c) for c in cols]
    coming = []
    if dead is not None:
        coming.append(dead.select(bucket, F.lit(2).alias("role"), "digest", *null(KEY[1:]), F.lit(None).cast("binary").alias("slots")))
    if new is not None:
        coming.append(new.select(bucket, F.lit(3).alias("role"), *KEY, F.lit(None).cast("binary").alias("slots")))
    coming = coming[0] if len(coming) == 1 else coming[0].union(coming[1])
    touched = materialize(coming.select("bucket").distinct(), "touched")
    rows = coming.union(index.filters.join(touched, "bucket", "left_semi").select("bucket", F.lit(0).alias("role"), *null(KEY), "slots"))
    rows = rows.union(index.keys.join(touched, "bucket", "left_semi").select("bucket", F.lit(1).alias("role"), *KEY, F.lit(None).cast("binary").alias("slots")))
    rows = rows.repartition(distribute(index.keys), "bucket").sortWithinPartitions("bucket", "role", "keep_e", "digest")

    def make():
        def out(bucket, live):
            items = [(bucket, d, *v, None) for d, v in live.keys.items()]
            for lo in range(0, len(items), 1000):
                yield list(zip(*items[lo:lo + 1000]))
            yield [[bucket], [None], [None], [None], [None], [None], [None], [live.filter.tobytes()]]

        def run(batches):
            now, live, unzip = None, None, zstandard.ZstdDecompressor()
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    columns = [c.to_pylist() for c in b.slice(lo, 500).columns]
                    for bucket, role, digest, content, n, keep, e, at, slots in zip(*columns):
                        if bucket != now:
                            if live is not None:
                                yield from out(now, live)
                            now, live = bucket, Live(slots)
                        if role == 1:
                            live.stored(digest, [content, n, keep, e, at])
                        elif role == 2:
                            live.remove(digest)
                        elif role == 3:
                            entry = live.find(digest, unzip.decompress(content))
                            if entry is None:
                                live.add(digest, [content, n, keep, e, at])
                            else:
                                entry[1] += n
                                if _better((keep, e, at), tuple(entry[2:])):
                                    entry[2:] = [keep, e, at]
            if live is not None:
                yield from out(now, live)

        return run

    ddl = f"bucket int, digest binary, content binary, n bigint, keep_id {index.kind}, keep_e bigint, keep_at int, slots binary"
    found = materialize(map_batches(rows, make, ddl), "index")
    filters = index.filters.join(touched, "bucket", "left_anti").union(found.where("slots is not null").select("bucket", "slots"))
    keys = index.keys.join(touched, "bucket", "left_anti").select("bucket", *KEY).union(found.where("slots is null").select("bucket", *KEY))
    return filters, keys


def insert(index: DigestIndex, df: DataFrame, text_col: str = "text") -> DigestIndex:
    """The index with the documents of ``df`` added. Ids may repeat; every row is a document."""
    found = materialize(entries(df, index.id_col, text_col), "entries")
    # numbers of rows that are already there stay apart from new ones
    shift = index.members.agg(F.max("e")).first()[0]
    if shift is not None:
        up = lambda c: (F.col(c) + F.lit(shift + 1)).alias(c)
        found = found.select("digest", up("e"), "ids", "content", "size", "n", "keep_id", up("keep_e"), "keep_at")
    filters, keys = _apply(index, None, found.where("content is not null").select(*KEY))
    return DigestIndex(filters, keys, index.members.union(found.select("digest", "e", "ids")), index.buckets, index.id_col, index.kind)


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
    """Index of all documents of ``df``, with as many buckets as their contents need."""
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    found = materialize(entries(df, id_col, text_col), "entries")
    held = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    empty = lambda ddl: spark.createDataFrame([], ddl)
    start = DigestIndex(
        empty("bucket int, slots binary"), empty(f"bucket int, digest binary, content binary, n bigint, keep_id {kind}, keep_e bigint, keep_at int"),
        found.select("digest", "e", "ids"), max(distribute(df), held // BUCKET_BYTES + 1), id_col, kind)
    filters, keys = _apply(start, None, found.where("content is not null").select(*KEY))
    return DigestIndex(filters, keys, start.members, start.buckets, id_col, kind)


def delete(index: DigestIndex, ids: DataFrame) -> DigestIndex:
    """The index without the documents of these ids (first column of ``ids``); null and unknown ids change nothing.

    Contents without a document left leave keys and filter; of the others the keeper is found anew.
    """
    gone = ids.select(F.col(ids.columns[0]).cast(index.kind).alias("_id")).where("_id is not null").distinct()
    flat = index.members.select("digest", "e", F.posexplode("ids").alias("at", "_id"))
    hit = materialize(flat.join(gone, "_id", "left_semi").select("digest", "e").distinct(), "hit")
    changed = index.members.join(hit, ["digest", "e"], "left_semi").select("digest", "e", F.posexplode("ids").alias("at", "_id"))
    left = changed.join(gone, "_id", "left_anti").groupBy("digest", "e").agg(F.sort_array(F.collect_list(F.struct("at", "_id"))).alias("l"))
    left = left.select("digest", "e", F.col("l")["_id"].alias("ids"))  # at most CHUNK_IDS
    members = materialize(index.members.join(hit, ["digest", "e"], "left_anti").union(left), "members")
    touched = hit.select("digest").distinct()
    best = F.array_max("ids")
    each = members.join(touched, "digest", "left_semi").select("digest", F.size("ids").alias("n"), F.struct(best.alias("i"), (-F.col("e")).alias("e"), F.coalesce(F.array_position("ids", best) - 1, F.lit(0)).cast("int").alias("at")).alias("k"))
    now = materialize(each.groupBy("digest").agg(F.sum("n").alias("_n"), F.max("k").alias("_k")), "now")
    dead = touched.join(now, "digest", "left_anti")
    keys = index.keys.join(now, "digest", "left").select(
        "bucket", "digest", "content", F.coalesce("_n", "n").alias("n"), F.when(F.col("_n").isNull(), F.col("keep_id")).otherwise(F.col("_k.i")).alias("keep_id"),
        F.coalesce(-F.col("_k.e"), "keep_e").alias("keep_e"), F.coalesce("_k.at", "keep_at").alias("keep_at"))
    moved = DigestIndex(index.filters, materialize(keys, "moved"), members, index.buckets, index.id_col, index.kind)
    filters, keys = _apply(moved, dead, None)
    return DigestIndex(filters, keys, members, index.buckets, index.id_col, index.kind)


def verdicts(index: DigestIndex) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every document in the index.

    Of equal texts the row of the largest id stays; of several rows of that id, the one read first. Null ids go before all
    others; where all ids of a text are null, one row stays and keep_id is null. Null texts are equal to empty ones.
    """
    keys = index.keys.select("digest", F.col("n").alias("group_size"), "keep_id", "keep_e", "keep_at")
    rows = index.members.join(keys, "digest")
    flat = rows.select("digest", "group_size", "keep_id", (F.col("e") == F.col("keep_e")).alias("_own"), "keep_at", F.posexplode("ids").alias("_at", index.id_col))
    return flat.select(index.id_col, "keep_id", "group_size", (F.col("_own") & (F.col("_at") == F.col("keep_at"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``verdicts`` of an index built of ``df``. Other columns are ignored, whatever their names; an empty table gives no rows."""
    return verdicts(build(df, id_col, text_col))
