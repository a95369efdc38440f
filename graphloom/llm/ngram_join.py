"""Exact Jaccard join of documents on sets of word n-grams, by prefixes under several global token orders.

1. Documents with equal sets are one class. The same scan counts hashed tokens over all documents.
2. A class posts the tokens of its prefix under the first order (rare buckets first). Similar sets share one.
3. Per token, every class is compared with the most typical class of the posting, if sizes and the tokens that it
   shares with nobody allow a link. Classes so linked are one component; only classes of different components that
   share a token are compared further, so a large group of near copies costs one comparison each, not one a pair.
4. Classes of candidate pairs give digests of their prefixes under the further orders. Pairs whose prefixes do not meet under
   every order are dropped before any text moves; the others are verified on whole sets.

All of it is exact: orders and filters only save work.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Hashes, map_batches, materialize, mix, only, words
from graphloom.llm.components import components
from graphloom.session import discard

WORDS = 5  # words in an n-gram
SIMILARITY = (80, 100)  # at least 80 of 100
BUCKETS = 1 << 20  # counters of the first order (8 MB on the driver and in every worker, at any size of the input)
CHUNK = 1 << 14  # counters in a row while they are added up
SALT_ROWS = 200  # classes compared with one leader in one task
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))  # seeds of the further orders


def shingles(text, hashes: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit tokens of a text: its runs of ``n`` words, A-Z lower-cased, or all its words if fewer."""
    ws = words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = hashes.array(ws)
    width = min(n, len(ws))
    runs = len(ws) - width + 1
    value = np.full(runs, width, dtype=np.uint64)
    for i in range(width):
        value = mix(value * _STEP + h[i:i + runs])
    return np.unique(value)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_size(n: int, similarity=SIMILARITY) -> int:
    a, b = similarity
    return n - -(-a * n // b) + 1


def first_prefix(tokens: np.ndarray, counts: np.ndarray, similarity=SIMILARITY) -> tuple[np.ndarray, int]:
    """Prefix under the first order (tokens of rare buckets first), and where in that order it ends.

    Of two prefixes, the one with the smaller end ends first; equal ends tell nothing.
    """
    c = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]
    at = np.lexsort((tokens, c))[:prefix_size(len(tokens), similarity)]
    last = at[-1]
    return tokens[at], (min(int(c[last]), (1 << 31) - 1) << 32) | (int(tokens[last]) >> 32)


def further_prefixes(tokens: np.ndarray, similarity=SIMILARITY) -> list[np.ndarray]:
    """Prefixes under the further orders, as 32-bit digests: equal tokens have equal digests, so none that meets is missed."""
    p = prefix_size(len(tokens), similarity)
    return [np.partition(mix(tokens ^ seed), p - 1)[:p].astype(np.uint32).view(np.int32) for seed in _ORDERS]


def linked(a: np.ndarray, b: np.ndarray, similarity=SIMILARITY) -> bool:
    """Whether two token sets have Jaccard of at least the similarity."""
    low, high = sorted((len(a), len(b)))
    num, den = similarity
    if not low or den * low < num * high:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Sum of the counter rows (chunk, data): at most ``buckets`` numbers come to the driver, whatever the input."""
    def add():
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(zstandard.decompress(d), dtype=np.uint32)
                    total[c] = total.get(c, 0) + x.astype(np.int64)
            yield [list(total), [x.tobytes() for x in total.values()]]

        return run

    # a task holds some of the buckets // CHUNK chunks
    parts = min(buckets // CHUNK, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = map_batches(rows.select("chunk", "data").repartition(parts, "chunk"), add, "chunk int, data binary").collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], dtype=np.int64)
    return out


def counter_rows(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The filled chunks of a task's counters, compressed."""
    parts = counts.reshape(-1, CHUNK)
    return [(k, zstandard.compress(x.tobytes())) for k, x in enumerate(parts) if x.any()]


def key_documents(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Rows of documents (id, n_shingles, set_key and its first half k; null for empty sets) and, with chunk set, counter rows."""
    kind = dict(df.dtypes)[id_col]

    def make():
        hashes = Hashes()

        def run(batches):
            counts = np.zeros(BUCKETS, dtype=np.uint32)
            for b in batches:
                sizes, keys = [], []
                for t in b.column(1).to_pylist():
                    tokens = shingles(t, hashes, n)
                    np.add.at(counts, (tokens & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
                    sizes.append(len(tokens))
                    keys.append(set_key(tokens) if len(tokens) else None)
                none = [None] * len(sizes)
                yield [b.column(0), sizes, keys, [None if k is None else short_key(k) for k in keys], none, none]
            if counts.any():
                rows = counter_rows(counts)
                none = [None] * len(rows)
                yield [none, none, none, none, [c for c, _ in rows], [d for _, d in rows]]

        return run

    return map_batches(only(df, id_col, text_col), make, f"`{id_col}` {kind}, n_shingles bigint, set_key binary, k bigint, chunk int, data binary")


def prefixes(df: DataFrame, text_col: str, n: int, counts, copied) -> DataFrame:
    """(c, k, twin, ends, tokens) of every set: a number for the row, the short key, whether the set may come from several
    documents (a counter per bucket tells), and the tokens of its first prefix."""
    def make():
        hashes = Hashes()

        def run(batches):
            table, twins = counts.value, copied.value
            c = TaskContext.get().partitionId() << 40  # near numbers for near rows, which shuffles well
            for b in batches:
                seen: set[bytes] = set()
                rows, tokens, at = [], [], [0]

                def out():
                    return [*zip(*rows), pa.ListArray.from_arrays(np.array(at, dtype=np.int32), np.concatenate(tokens))]

                for t in b.column(0).to_pylist():
                    s = shingles(t, hashes, n)
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    prefix, end = first_prefix(s, table)
                    k = short_key(key)
                    rows.append((c, k, bool(twins[k & (len(twins) - 1)]), end))
                    c += 1
                    tokens.append(prefix.view(np.int64))
                    at.append(at[-1] + len(prefix))
                    if at[-1] > 500_000:
                        yield out()
                        rows, tokens, at = [], [], [0]
                if rows:
                    yield out()

        return run

    return map_batches(only(df, text_col), make, "c bigint, k bigint, twin boolean, ends bigint, tokens array<bigint>")


def texts_of(df: DataFrame, id_col: str, text_col: str, n: int, wanted) -> DataFrame:
    """(id, set_key, data, second, third): compressed texts whose key may be wanted (a counter per bucket tells), and digests of
    their prefixes under the further orders."""
    kind = dict(df.dtypes)[id_col]

    def make():
        hashes = Hashes()

        def run(batches):
            counts, zip_ = wanted.value, zstandard.ZstdCompressor(level=3)
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows = []
                    for key_of_row, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        s = shingles(t, hashes, n)
                        if len(s) and counts[short_key(key := set_key(s)) & (len(counts) - 1)]:
                            rows.append((key_of_row, key, zip_.compress(t.encode("utf-8", "surrogatepass")), *further_prefixes(s)))
                    if rows:
                        yield list(zip(*rows))

        return run

    return map_batches(only(df, id_col, text_col), make, f"`{id_col}` {kind}, set_key binary, data binary, second array<int>, third array<int>")


def repeated(rows: DataFrame) -> DataFrame:
    """Rows (token, c) whose token several rows hold. Rows are sorted by token and passed through, however many share one."""
    def make():
        def run(batches):
            token, c = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)  # the last row, and whether it repeats
            met = False
            for b in batches:
                token, c = np.concatenate([token, b.column(0).to_numpy()]), np.concatenate([c, b.column(1).to_numpy()])
                if not len(token):
                    continue
                same = token[1:] == token[:-1]
                keep = np.r_[met, same] | np.r_[same, False]
                yield [pa.array(token[:-1][keep[:-1]]), pa.array(c[:-1][keep[:-1]])]
                met = bool(keep[-1])
                token, c = token[-1:], c[-1:]
            if met:
                yield [pa.array(token), pa.array(c)]

        return run

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(rows.select("token", "c").repartition(parts, "token").sortWithinPartitions("token"), make, "token bigint, c bigint")


def met_under_all(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (leader, member) whose prefixes meet under the further orders, too; no text is read."""
    own = lambda name: texts.select(F.col("set_key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("second", "third")])
    both = pairs.join(own("member"), "member").join(own("leader"), "leader")
    meet = [F.arrays_overlap(f"leader_{c}", f"member_{c}") for c in ("second", "third")]
    return both.where(meet[0] & meet[1]).select("leader", "member")


def mark(keys: DataFrame) -> DataFrame:
    """Counter rows that tell which buckets the short keys (column k) fall into."""
    def make():
        def run(batches):
            counts = np.zeros(BUCKETS, dtype=np.uint32)
            for b in batches:
                counts[b.column(0).to_numpy().astype(np.int64) & (BUCKETS - 1)] = 1
            if counts.any():
                yield list(zip(*counter_rows(counts)))

        return run

    return map_batches(keys.select("k"), make, "chunk int, data binary")


def verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Those of the pairs (leader, member) of set keys that are linked.

    Texts of members travel to their leader; a leader of many members is repeated over salts. A task reads one
    leader and then its members one by one.
    """
    spark = pairs.sparkSession
    pairs = materialize(met_under_all(pairs, texts), "met")
    texts = texts.select("set_key", "data")
    many = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("_m"))
    dealt = pairs.join(many, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("_m") / SALT_ROWS)).cast("int"))
    dealt = materialize(dealt.select("leader", "member", "salt"), "pairs")
    members = dealt.join(texts, dealt["member"] == texts["set_key"]).select("leader", "salt", F.lit(1).alias("role"), "member", "data")
    leaders = dealt.select("leader", "salt").distinct()
    leaders = leaders.join(texts, leaders["leader"] == texts["set_key"]).select("leader", "salt", F.lit(0).alias("role"), F.col("leader").alias("member"), "data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.union(members).repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", "role", "member")

    def make():
        hashes, unzip = Hashes(), zstandard.ZstdDecompressor()

        def run(batches):
            head, own = None, None
            for b in batches:
                out = []
                for leader, role, member, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                    s = shingles(unzip.decompress(data).decode("utf-8", "surrogatepass"), hashes, n)
                    if role == 0:
                        head, own = leader, s
                        continue
                    if head != leader:
                        raise RuntimeError("a leader's text is missing")
                    if linked(own, s):
                        out.append((leader, member))
                if out:
                    yield list(zip(*out))

        return run

    return map_batches(rows, make, "a binary, b binary")


def feasible(a: str = "", b: str = "o_", similarity=SIMILARITY):
    """Whether two classes (columns n, own, ends with the given name prefixes) can be similar.

    Their sizes must allow it. And of two classes, all prefix tokens of the one whose prefix ends first that no other
    class posts (``own``) are missing in the other one, which bounds what they share.
    """
    num, den = similarity
    n, m, u, v, e, f = (F.col(x + c) for c in ("n", "own", "ends") for x in (a, b))

    def reach(x, mine, y):
        common = F.least(x - mine, y)
        return common * den >= (x + y - common) * num

    return (F.least(n, m) * den >= F.greatest(n, m) * num) & F.when(e < f, reach(n, u, m)).when(e > f, reach(m, v, n)).otherwise(reach(n, u, m) | reach(m, v, n))


FACTS = ("c", "n", "own", "ends")


def fewer_tokens(rows: DataFrame, similarity=SIMILARITY) -> DataFrame:
    """Those rows (token, FACTS, ...) that are needed to meet every partner.

    Two similar classes share all prefix tokens but those that the sizes allow to miss, so at least ``least`` of them. For the
    sizes that a class meets, it then shares one of its first (number of tokens - least + 1) with each partner.
    """
    num, den = similarity
    span = rows.groupBy("token").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    met = rows.join(span, "token").groupBy("c").agg(F.max("n").alias("_n"), F.count(F.lit(1)).alias("_s"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    n = F.col("_n")
    lo, hi = F.greatest("_lo", F.ceil(n * num / den)), F.least("_hi", F.floor(n * den / num))
    after = lambda x: F.ceil(x * num / den) - 1  # tokens behind a prefix
    common = lambda m: F.ceil((n + m) * num / (num + den))
    # if its own prefix ends first; if the partner's does (the larger the partner, the more follows)
    least = F.greatest(F.lit(1), F.least(common(lo) - after(n), common(hi) - after(hi) - 1))
    met = met.select("c", (F.col("_s") - least + 1).alias("_keep")).where("_keep > 0")
    order = Window.partitionBy("c").orderBy("token")  # the prefix of one class
    return rows.join(met, "c").withColumn("_at", F.row_number().over(order)).where("_at <= _keep").drop("_at", "_keep")


def met_pairs(rows: DataFrame, meets, similarity=SIMILARITY) -> DataFrame:
    """Pairs (c, o_c) of classes of ``rows`` that share a token, fulfil ``meets`` and share enough prefix tokens.

    ``rows`` hold every prefix token that two classes to be paired share. What two classes share is at most these and,
    of the class whose prefix ends first, all that follows it.
    """
    num, den = similarity
    rows = materialize(rows, "met-rows")
    short = materialize(fewer_tokens(rows), "short")
    names = [c for c in short.columns if c != "token"]
    other = short.select("token", *[F.col(c).alias(f"o_{c}") for c in names])
    pairs = short.join(other, "token").where((F.col("c") < F.col("o_c")) & meets & feasible())
    pairs = materialize(pairs.select(*[F.col(x + c) for x in ("", "o_") for c in ("c", "n", "ends")]).distinct(), "met")
    sets = rows.groupBy("c").agg(F.collect_list("token").alias("t"))  # the prefix of one class
    both = pairs.join(sets, "c").join(sets.select(F.col("c").alias("o_c"), F.col("t").alias("o_t")), "o_c")
    after = lambda n: F.ceil(n * num / den) - 1
    a, b = after(F.col("n")), after(F.col("o_n"))
    rest = F.when(F.col("ends") < F.col("o_ends"), a).when(F.col("ends") > F.col("o_ends"), b).otherwise(F.greatest(a, b))
    common = F.size(F.array_intersect("t", "o_t")) + rest
    return both.where(common * den >= (F.col("n") + F.col("o_n") - common) * num).select("c", "o_c")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n_shingles, set_key), classes of equal sets (set_key, k, n, rep), and links between classes (a, b).

    The links connect all that similarity connects; inside a component not every link is listed.
    """
    spark: SparkSession = df.sparkSession
    keyed = materialize(key_documents(df, id_col, text_col, n), "keys")
    docs = keyed.where("chunk is null").select(id_col, "n_shingles", "set_key", "k")
    counts = spark.sparkContext.broadcast(bucket_counts(keyed.where("chunk is not null"), BUCKETS))
    classes = docs.where("set_key is not null").groupBy("set_key").agg(
        F.min("k").alias("k"), F.min("n_shingles").alias("n"), F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")

    # prefixes, once a class, and the tokens that at least two classes post
    copied = spark.sparkContext.broadcast(bucket_counts(mark(classes.where("copies > 1")), BUCKETS))
    found = materialize(prefixes(df, text_col, n, counts, copied), "prefixes")
    counts.destroy()
    copied.destroy()
    twins = found.where("twin")
    posted = found.where("not twin").union(twins.join(twins.groupBy("k").agg(F.min("c").alias("c")).select("c"), "c").select(found.columns))
    shared = materialize(repeated(posted.select("c", F.explode("tokens").alias("token"))), "shared")
    num, den = SIMILARITY
    size = F.col("n") - F.ceil(F.col("n") * num / den) + 1  # of the prefix
    used = shared.groupBy("c").agg(F.count(F.lit(1)).alias("_used"))
    facts = posted.select("c", "k", "ends").join(used, "c").join(classes, "k").select("c", "set_key", "n", (size - F.col("_used")).alias("own"), "ends")
    facts = materialize(facts, "facts")
    discard(found)  # the prefixes, the largest of the tables here
    # the most typical class of a token has the smallest share of tokens of its own
    typical = facts.select("c", F.struct((-F.col("own") / F.col("n")).alias("t"), "c").alias("t"))
    leads = shared.join(typical, "c").groupBy("token").agg(F.max("t")["c"].alias("o_c"))
    led = shared.join(leads, "token").where("c != o_c").select("c", "o_c").distinct()
    numbers = facts.select(*FACTS)
    other = numbers.select(*[F.col(c).alias(f"o_{c}") for c in FACTS])
    first = materialize(led.join(numbers, "c").join(other, "o_c").where(feasible()).select("c", "o_c"), "first")

    # classes that fit none of their leaders may still fit others
    fit = first.select(F.explode(F.array("c", "o_c")).alias("c")).distinct().withColumn("_fit", F.lit(True))
    judged = materialize(shared.join(fit, "c", "left").select("token", "c", F.col("_fit").isNull().alias("lone")), "judged")
    some = judged.groupBy("token").agg(F.max("lone").alias("_any")).where("_any").select("token")
    lone = met_pairs(judged.join(some, "token").join(numbers, "c"), F.col("lone") | F.col("o_lone"))
    keys = facts.select("c", "set_key")
    named = lambda t: t.join(keys, "c").join(keys.select(F.col("c").alias("o_c"), F.col("set_key").alias("o_key")), "o_c").select(
        F.least("set_key", "o_key").alias("leader"), F.greatest("set_key", "o_key").alias("member"), "c", "o_c")
    # the leader of the token leads the comparison, so that its text is read once
    first = first.join(keys, "c").join(keys.select(F.col("c").alias("o_c"), F.col("set_key").alias("leader")), "o_c").select("leader", F.col("set_key").alias("member"))
    first = materialize(first.union(named(lone).select("leader", "member")).distinct(), "candidates")

    wanted = first.select(F.explode(F.array("leader", "member")).alias("set_key")).distinct()
    wanted = materialize(wanted.join(classes, "set_key").select("set_key", "k", F.col("rep").alias("_rep")), "wanted")
    marks = spark.sparkContext.broadcast(bucket_counts(mark(wanted), BUCKETS))
    texts = texts_of(df, id_col, text_col, n, marks).join(wanted.drop("k"), "set_key").where(F.col(id_col).eqNullSafe(F.col("_rep")))
    texts = materialize(texts.select("set_key", "data", "second", "third"), "texts")
    marks.destroy()
    links = materialize(verify(first, texts, n), "links")

    # classes of different components that share a token, where no leader has brought them together
    found = components(links)
    labelled = wanted.join(found, wanted["set_key"] == found["node"], "left").select("set_key", F.coalesce("component", "set_key").alias("comp")).join(keys, "set_key")
    labelled = materialize(labelled, "labelled")
    short = labelled.groupBy("comp").agg(F.min("c").alias("group"))  # a number for the component
    rest = shared.join(materialize(labelled.join(short, "comp").select("c", "group"), "groups"), "c")
    open_ = rest.groupBy("token").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi")).where("_lo != _hi").select("token")
    rest = rest.join(open_, "token").join(numbers, "c").select("token", *FACTS, "group")
    more = named(met_pairs(rest, F.col("group") != F.col("o_group")))
    done = first.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member"))
    more = more.select("leader", "member").join(done, ["leader", "member"], "left_anti")
    links = links.union(materialize(verify(more, texts, n), "links"))
    discard(texts, shared, judged, facts)
    return docs, classes, links


def join_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, keys: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its set and the smallest id that links reach. With ``keys`` also
    set_key, and leads: whether the row has that id and, of the sets of the component under that id, the smallest key.

    Null and empty texts have no shingles and are linked with nothing; their component is their own id. Copies,
    repeated rows and ties share the component of their class. Null ids take part, but name no component unless
    all ids of it are null. Other columns are ignored. An empty table gives no rows.
    """
    docs, classes, links = classify(df, id_col, text_col, n)
    found = components(links)
    labelled = classes.join(found, classes["set_key"] == found["node"], "left").select("set_key", "rep", F.coalesce("component", "set_key").alias("comp"))
    names = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "set_key"))["set_key"].alias("_key"))
    named = labelled.join(names, "comp").select("set_key", "component_id", "_key")
    out = docs.join(named, "set_key", "left")
    shown = [id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id")]
    if keys:
        first = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("set_key") == F.col("_key"))
        shown += ["set_key", (F.col("set_key").isNull() | first).alias("leads")]
    return out.select(*shown)
