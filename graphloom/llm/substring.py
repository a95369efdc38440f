"""Removal of repeated word windows by super-k-mer partitioning.

The minimiser of a window is the smallest hash among its short word runs. Consecutive windows that share one minimiser
at one place form a super-k-mer; equal windows always have equal minimisers.

1. Super-k-mers travel as compact rows (minimiser, hash of their words, place). Minimisers seen once end here.
2. Of super-k-mers with equal words, all but the first are repeats as they stand. They are sorted next to each other, those of
   frequent minimisers in parts, so that no large class is paired with its first row by row.
3. Where a minimiser is left with several different super-k-mers, each travels once as a packed string to the
   bucket of its minimiser. Sorting the bucket's windows, compared word by word, finds those seen before.
   Buckets of very frequent minimisers are divided by a hash of the window.

The first occurrence of a window is the one of the smallest document id, then the smallest start.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Hashes, map_batches, materialize, mix, words
from graphloom.llm.ngram_join import BUCKETS, bucket_counts, counter_rows

WINDOW = 20  # words in a window
RUN = 5  # words in the runs that minimisers are chosen from
CLASS_ROWS = 4096  # super-k-mers of one minimiser that are sorted together
BUCKET_STRINGS = 256  # packed strings of one minimiser sorted together
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def text_tag(text: str) -> int:
    """Tells rows of one id apart by their texts."""
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def super_kmers(h: np.ndarray, window: int = WINDOW, run: int = RUN):
    """(minimisers, word hashes, starts, window counts) of the super-k-mers of a text's word hashes."""
    n = len(h)
    if n < window:
        return None
    m = n - run + 1
    value = np.zeros(m, dtype=np.uint64)
    for i in range(run):
        value = mix(value * np.uint64(_ODD) + h[i:i + m])
    have, want = 1, window - run + 1  # runs in a window; the minimum over 1, 2, 4, ... of them
    low, place = value, np.arange(m)
    while have < want:
        step = min(have, want - have)
        right = low[step:] < low[:-step]  # the leftmost of equal ones
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        have += step
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1  # so a window repeated in one text is in two super-k-mers
    starts = np.concatenate([[0], cut])
    counts = np.diff(np.concatenate([starts, [len(low)]]))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(_ODD, n), dtype=np.uint64)])
    ends = starts + counts + window - 1
    content = mix((total[ends] - total[starts]) * powers(_INVERSE, n)[starts] + counts.astype(np.uint64))
    return low[starts].view(np.int64), content.view(np.int64), starts, counts


def compact(df: DataFrame, window: int, run: int) -> DataFrame:
    """Rows (mini, content, id, tag, at, n) of all super-k-mers of (id, text)."""
    kind = dict(df.dtypes)["id"]

    def make():
        hashes = Hashes()

        def run_(batches):
            def out(ids, rows):
                owner = np.concatenate([np.full(len(r[0]), i) for i, _, r in rows])
                tags = np.concatenate([np.full(len(r[0]), t, dtype=np.int32) for _, t, r in rows])
                mini, content, at, n = (np.concatenate([r[c] for _, _, r in rows]) for c in range(4))
                return [pa.array(mini), pa.array(content), ids.take(pa.array(owner)), pa.array(tags), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]

            for b in batches:
                rows, held = [], 0
                for i, t in enumerate(b.column(1).to_pylist()):
                    found = super_kmers(hashes.array(words(t)), window, run) if t else None
                    if found is None:
                        continue
                    rows.append((i, text_tag(t), found))
                    held += len(found[0])
                    if held > 100_000:
                        yield out(b.column(0), rows)
                        rows, held = [], 0
                if rows:
                    yield out(b.column(0), rows)

        return run_

    return map_batches(df, make, f"mini bigint, content bigint, id {kind}, tag int, at int, n int")


def marked(keys: DataFrame) -> np.ndarray:
    """A mark for every bucket that some row's tag falls into: a filter of fixed size that loses nothing."""
    def make():
        def run(batches):
            counts = np.zeros(BUCKETS, dtype=np.uint32)
            for b in batches:
                counts[b.column(0).to_numpy() & (BUCKETS - 1)] = 1
            if counts.any():
                yield list(zip(*counter_rows(counts)))

        return run

    return bucket_counts(map_batches(keys.select("tag"), make, "chunk int, data binary"), BUCKETS) > 0


def packed(df: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """(mini, part, id, tag, at, words): the words of super-k-mers (mini, id, tag, at, n, classes), fetched from their texts."""
    kind = dict(df.dtypes)["id"]
    spark = df.sparkSession
    wanted = spark.sparkContext.broadcast(marked(firsts))

    def texts():
        zip_ = zstandard.ZstdCompressor(level=3)

        def run(batches):
            bits = wanted.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows = [(k, tag, zip_.compress(t.encode("utf-8", "surrogatepass"))) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                            if t and bits[(tag := text_tag(t)) & (BUCKETS - 1)]]
                    if rows:
                        yield list(zip(*rows))

        return run

    sent = map_batches(df, texts, f"id {kind}, tag int, data binary").dropDuplicates(["id", "tag"])
    places = firsts.groupBy("id", "tag").agg(F.collect_list(F.struct("mini", "at", "n", "classes")).alias("places"))  # of one text
    both = sent.join(places.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")) & (sent["tag"] == places["tag"])).select("id", sent["tag"], "data", "places")

    def cut():
        unzip = zstandard.ZstdDecompressor()

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 32):
                    rows = []
                    for key, tag, data, places_ in zip(*(c.to_pylist() for c in b.slice(lo, 32).columns)):
                        ws = unzip.decompress(data).split()
                        for p in places_:
                            parts = -(-p["classes"] // BUCKET_STRINGS)
                            if parts == 1:
                                runs = [(0, p["at"], p["at"] + p["n"] - 1)]
                            else:  # consecutive windows of one part stay together
                                runs = []
                                for at in range(p["at"], p["at"] + p["n"]):
                                    k = xxhash.xxh3_64_intdigest(b" ".join(ws[at:at + window])) % parts
                                    if runs and runs[-1][0] == k:
                                        runs[-1] = (k, runs[-1][1], at)
                                    else:
                                        runs.append((k, at, at))
                            rows += [(p["mini"], k, key, tag, a, b" ".join(ws[a:z + window])) for k, a, z in runs]
                    if rows:
                        yield list(zip(*rows))

        return run

    ddl = f"mini bigint, part int, id {kind}, tag int, at int, words binary"
    return map_batches(both, cut, ddl)


def seen_before(strings: DataFrame, window: int) -> DataFrame:
    """Spans (id, tag, at, length) of words covered by windows that a bucket holds earlier, too."""
    kind = dict(strings.dtypes)["id"]
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = strings.repartition(parts, "mini", "part").sortWithinPartitions("mini", "part")

    def make():
        def repeats(group):
            found = []
            for key, tag, at, packed_words in group:
                ws = packed_words.split(b" ")
                found += [(b" ".join(ws[i:i + window]), key is not None, key or 0, at + i, tag) for i in range(len(ws) - window + 1)]
            found.sort()
            first = None
            for w, known, key, at, tag in found:
                if first is None or first[0] != w:
                    first = (w, known, key, at)
                elif (known, key, at) != first[1:]:
                    yield key if known else None, tag, at, window

        def run(batches):
            name, group = None, []
            for b in batches:
                out = []
                for mini, part, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if (mini, part) != name:
                        out += repeats(group)
                        name, group = (mini, part), []
                    group.append(row)
                if out:
                    yield list(zip(*out))
            if out := list(repeats(group)):
                yield list(zip(*out))

        return run

    return map_batches(sorted_, make, f"id {kind}, tag int, at int, length int")


def repeated_spans(df: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Spans (id, tag, at, length) of repeated windows of (id, text); they may overlap."""
    rows = compact(df, window, run)
    often = materialize(rows.groupBy("mini").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "often")
    parts = F.ceil(F.col("_c") / CLASS_ROWS)  # the super-k-mers of a frequent minimiser are dealt to parts by their place
    rows = rows.join(often, "mini").select("mini", "content", F.pmod(F.xxhash64("id", "at"), parts).cast("int").alias("part"), (parts > 1).alias("cut"), "id", "tag", "at", "n")
    inside = Window.partitionBy("mini", "content", "part").orderBy("id", "at", "n", "tag").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda: F.col("id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at"))
    rows = rows.repartition("mini", "content", "part").select("*", F.first("id").over(inside).alias("_id"), F.first("at").over(inside).alias("_at"), F.row_number().over(inside).alias("_rn"))
    rows = materialize(rows.select("mini", "content", "cut", "id", "tag", "at", "n", (~same()).alias("later"), (F.col("_rn") == 1).alias("leads")), "kmers")

    # a part knows the first of its own; only firsts of several parts meet the first of the whole class
    place = F.struct("id", "at", "n", "tag")
    united = materialize(rows.where("cut AND leads").groupBy("mini", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("parts")), "united")
    open_ = rows.where("cut AND NOT later").join(united.where("parts > 1").select("mini", "content", F.col("first.id").alias("_id"), F.col("first.at").alias("_at")), ["mini", "content"])
    later = rows.where("later").unionByName(open_.where(~same()).select(*rows.columns))
    later = later.select("id", "tag", "at", (F.col("n") + window - 1).cast("int").alias("length"))

    classes = rows.where("leads AND NOT cut").select("mini", "id", "tag", "at", "n").unionByName(united.select("mini", "first.id", "first.tag", "first.at", "first.n"))
    several = classes.groupBy("mini").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    firsts = materialize(classes.join(several, "mini").select("mini", "id", "tag", "at", "n", "classes"), "firsts")
    return later.union(seen_before(packed(df, firsts, window), window))


def without_repeats(df: DataFrame, finish, ddl: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, keep: tuple = ()) -> DataFrame:
    """Apply ``finish(text, words, kept)`` to every row, where ``kept`` marks the words that stay; its results make up
    the columns of ``ddl`` after the id and the ``keep`` columns. Rows without a repeat never leave their task.
    """
    kinds = dict(df.dtypes)
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    spans = materialize(repeated_spans(own, window, run), "spans")
    spark = df.sparkSession
    wanted = spark.sparkContext.broadcast(marked(spans))
    carried = [f"_keep{i}" for i in range(len(keep))]
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, carried)])
    head = ", ".join([f"id {kinds[id_col]}", *[f"{n} {kinds[c]}" for c, n in zip(keep, carried)]])

    def first():
        zip_ = zstandard.ZstdCompressor(level=3)

        def run_(batches):
            bits = wanted.value
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows = []
                    for t in part.column(1).to_pylist():
                        tag = text_tag(t or "")
                        if t and bits[tag & (BUCKETS - 1)]:
                            rows.append((tag, zip_.compress(t.encode("utf-8", "surrogatepass")), *[None] * n_out))
                        else:
                            ws = words(t)
                            rows.append((tag, None, *finish(t, ws, np.ones(len(ws), dtype=bool))))
                    yield [part.column(0), *part.columns[2:], *zip(*rows)]

        return run_

    n_out = len([x for x in ddl.split(",") if x.strip()])
    rows = map_batches(source, first, f"{head}, tag int, data binary, {ddl}")
    by_text = spans.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("at", "length")).alias("spans"))  # of one text
    names = [x.split()[0] for x in ddl.split(", ")]

    def second():
        unzip = zstandard.ZstdDecompressor()

        def run_(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    part = b.slice(lo, 64)
                    at = {n: k for k, n in enumerate(part.schema.names)}
                    out = []
                    for data, spans_, *done in zip(*(part.column(at[n]).to_pylist() for n in ("data", "spans", *names))):
                        if data is None:
                            out.append(done)
                            continue
                        text = unzip.decompress(data).decode("utf-8", "surrogatepass")
                        ws = words(text)
                        kept = np.ones(len(ws), dtype=bool)
                        for s in spans_ or ():
                            kept[s["at"]:s["at"] + s["length"]] = False
                        out.append(finish(text, ws, kept))
                    yield [*[part.column(at[n]) for n in ("id", *carried)], *zip(*out)]

        return run_

    both = rows.join(by_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").drop("_id", "_tag")
    out = map_batches(both, second, f"{head}, {ddl}")
    return out.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(keep, carried)], *names)


def digest_kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: the kept words, joined by one space, as a digest.

    Null, empty and short texts lose nothing. Of rows with equal text and equal id none is earlier than the other,
    so they lose the same words. Null ids come before all others. Other columns are ignored.
    """
    def finish(text, ws, kept):
        stay = ws if kept.all() else [w for w, k in zip(ws, kept.tolist()) if k]
        return len(ws), len(ws) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()

    return without_repeats(df, finish, "n_words bigint, n_removed bigint, kept_sha256 string", id_col, text_col, window, run)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(id, keep columns, text, n_chars, n_removed): texts without the words of repeated windows.

    A text that loses nothing stays as it is; else its kept words are joined by one space. Null texts stay null.
    """
    def finish(text, ws, kept):
        if kept.all():
            return text, len(text or ""), 0
        stay = b" ".join([w for w, k in zip(ws, kept.tolist()) if k]).decode("utf-8", "surrogatepass")
        return stay, len(stay), int((~kept).sum())

    return without_repeats(df, finish, "text string, n_chars bigint, n_removed bigint", id_col, text_col, window, run, keep)
