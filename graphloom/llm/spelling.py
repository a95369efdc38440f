"""Spelling variants of the corpus vocabulary by a bit-sliced position index.

1. Words are counted over whole texts; counts are summed per task before they are shuffled.
2. Words at most one edit apart keep one half: those of length L and L or L + 1 share their first or their last L // 2
   code points. Every word goes to the groups of both halves; a group that is still large is cut the same way again,
   over what its members do not share yet, so no group is paired up and none has to fit into memory.
3. A block of groups is indexed by bitsets per (position, letter) over its words. One recurrence per letter of the query
   words, word-parallel over the block, carries three sets at once: no error so far, one replaced letter, and one more
   letter in the indexed word, which reads the index one position further on.
"""

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import distribute, map_batches, materialize, only

RUN = "[A-Za-zÀ-ÿ]"  # letters of a word
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is at least so many times as frequent
NOISE = 199
TASK_WORDS = 200_000  # distinct words that a task counts before it passes them on
LONG_TEXT = 1 << 20  # characters from which the runs of a text are not listed at once
GROUP_ROWS = 4096  # words of a group that is not cut further
BLOCK = 512  # words of one index, if its groups are small; query words answered at once


def dropped_letter(key, run: str) -> str:
    """The run, without one letter where the checksum of key and run is divisible by 199. A null key counts as no text."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, spelled=dropped_letter) -> DataFrame:
    """(word, n): words of at least ``least`` letters of all texts, A-Z lower-cased, as ``spelled(id, run)`` gives them.

    ``spelled`` must not lengthen a run. Null and empty texts have no words. Repeated rows count each.
    """
    def make():
        runs = re.compile(RUN + "{%d,}" % least)  # greedy, so only maximal runs are found

        def run(batches):
            total: dict[str, int] = {}
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not text:
                        continue
                    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                    own: dict[str, int] = {}
                    for w in runs.findall(text) if len(text) < LONG_TEXT else (m.group() for m in runs.finditer(text)):
                        own[w] = own.get(w, 0) + 1
                    for w, n in own.items():
                        w = spelled(key, w)
                        if len(w) >= least:
                            total[w] = total.get(w, 0) + n
                    if len(total) > TASK_WORDS:
                        yield [list(total), list(total.values())]
                        total = {}
            if total:
                yield [list(total), list(total.values())]

        return run

    found = map_batches(only(df, id_col, text_col), make, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def halves(rows: DataFrame) -> DataFrame:
    """Cut groups in two: members of a group (len, p, s) share p letters in front and s behind; of the ``m`` letters between, a
    word of length ``len`` keeps its first or its last m // 2 in every word that is one edit away from it.
    """
    g = F.floor((F.col("len") - F.col("p") - F.col("s")) / 2).cast("int")
    cut = F.explode(F.array(F.struct((F.col("p") + g).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + g).alias("s"))))
    out = rows.select("word", "n", "len", cut.alias("_c")).select("word", "n", "len", "_c.p", "_c.s")
    front, back = F.substring("word", F.lit(1), F.col("p")), F.substring("word", F.length("word") - F.col("s") + 1, F.col("s"))
    # the front may not run into the back: two letters are compared apart
    return out.withColumn("h", F.xxhash64("len", "p", "s", front, back))


def groups(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, n, len, p, s, h): every word in the groups where words one edit away are met, none larger than ``group_rows``
    unless its members differ in two letters at most."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("len")).withColumns({"p": F.lit(0), "s": F.lit(0)})
    done, rows = None, materialize(halves(start), "halves")
    while True:
        large = rows.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("len") - F.col("p") - F.col("s")).alias("_m"))
        large = materialize(large.where((F.col("_n") > group_rows) & (F.col("_m") > 1)).select("h"), "large")
        small = rows.join(large, "h", "left_anti").select(rows.columns)
        done = small if done is None else done.union(small)
        if large.isEmpty():
            return done
        rows = materialize(halves(rows.join(large, "h", "left_semi")), "halves")


class PositionIndex:
    """Bitsets per (position, letter) over a block of words, with the letters that the words of a group share left out.

    ``middles`` are the letters between; those of words of length L have ``m`` of them, those of words of L + 1 one more.
    Words are numbered 0, 1, ...; bit i of a set stands for word i. ``group`` holds the group number of every word.
    """

    def __init__(self, middles: list[str], group: np.ndarray, m: int):
        n = len(middles)
        self.m, self.n, self.group = m, n, group
        self.longer = np.fromiter((len(w) > m for w in middles), dtype=bool, count=n)
        flat = np.frombuffer("".join(w.ljust(m + 1) for w in middles).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, m + 1).copy()
        flat[~self.longer, m] = 0xFFFFFFFF  # no letter at all
        letters, codes = np.unique(flat, return_inverse=True)
        self.codes = codes.reshape(n, m + 1)
        self.words = -(-n // 64)
        one = np.arange(n)
        sets = np.zeros((m + 1, len(letters), self.words * 64), dtype=np.uint8)
        for i in range(m + 1):
            sets[i, self.codes[:, i], one] = 1
        self.sets = np.packbits(sets, axis=2, bitorder="little").view(np.uint64)

    def mask(self, chosen: np.ndarray) -> np.ndarray:
        bits = np.zeros(chosen.shape[:-1] + (self.words * 64,), dtype=np.uint8)
        bits[..., :self.n] = chosen
        return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart. Queries have length L; words have length L (larger number only) or L + 1."""
        same_group = self.mask(self.group[asked][:, None] == self.group[None, :])
        exact = same_group  # no error so far
        replaced = np.zeros_like(exact)  # one letter replaced so far
        inserted = exact  # one letter more in the indexed word so far
        for i in range(self.m):
            letter = self.codes[asked, i]
            here = self.sets[i][letter]
            replaced = (replaced & here) | (exact & ~here)
            exact = exact & here
            inserted = (inserted & self.sets[i + 1][letter]) | exact
        after = self.mask((np.arange(self.n)[None, :] > asked[:, None]) & ~self.longer[None, :])
        found = (replaced & after) | (inserted & self.mask(self.longer))
        q, at = np.nonzero(found)
        bits = np.unpackbits(found[q, at][:, None].view(np.uint8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        return asked[q[k]], at[k] * 64 + bit


def near_pairs(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, a_n, b, b_n): words of (word, n) with exactly one inserted, deleted or replaced letter between them, once each."""
    rows = groups(words, group_rows).select("len", "p", "s", "h", "word", "n")
    rows = rows.repartition(distribute(words), "h").sortWithinPartitions("len", "p", "s", "h", "word")

    def make():
        def answer(shape, ws, ns):
            length, p, s = shape
            keys: dict = {}
            # the two ends apart, so that equal letters of different ends do not meet
            group = np.fromiter((keys.setdefault((w[:p], w[len(w) - s:]), len(keys)) for w in ws), dtype=np.int64, count=len(ws))
            index = PositionIndex([w[p:len(w) - s] for w in ws], group, length - p - s)
            asked = np.flatnonzero(~index.longer)
            for lo in range(0, len(asked), BLOCK):
                q, k = index.near(asked[lo:lo + BLOCK])
                if len(q):
                    yield [[ws[i] for i in q], [ns[i] for i in q], [ws[i] for i in k], [ns[i] for i in k]]

        def run(batches):
            shape, last, ws, ns = None, None, [], []
            for b in batches:
                for length, p, s, h, w, n in zip(*(c.to_pylist() for c in b.columns)):
                    if h != last and ws and ((length, p, s) != shape or len(ws) >= BLOCK):
                        yield from answer(shape, ws, ns)
                        ws, ns = [], []
                    shape, last = (length, p, s), h
                    ws.append(w)
                    ns.append(n)
            if ws:
                yield from answer(shape, ws, ns)

        return run

    found = map_batches(rows, make, "a string, a_n bigint, b string, b_n bigint")
    # a pair that shares both halves was met twice
    return found.select(*[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n"))]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): where the forms lead to. Forms grow in frequency, so the chains are short and end."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spelling variants of a vocabulary (word, n): word, form, root, n, n_near, form_n.

    The form is the near word of largest n, the smallest in code-point order of several, if it is at least ``times`` as
    frequent as the word; otherwise form and form_n are null. The root is where forms lead to, the word itself without a form.
    Words of fewer than two letters and null words are left out. An empty vocabulary gives no rows.
    """
    words = materialize(words.select("word", "n").where("word is not null and length(word) >= 2"), "words")
    pairs = materialize(near_pairs(words, group_rows), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("o_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("o_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), F.col("o"))).alias("_b"))
    judged = words.join(best, "word", "left")
    fits = -F.col("_b.m") >= F.lit(times) * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("_b.o")).alias("form"),
                           F.when(fits, -F.col("_b.m")).alias("form_n"))
    judged = materialize(judged, "forms")
    found = roots(judged.where("form is not null"))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                    times: int = TIMES, spelled=dropped_letter) -> DataFrame:
    """``variants`` of the words of all texts that occur at least ``least_count`` times.

    Null and empty texts have no words; null ids count as an id without text; repeated rows count each; other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    return variants(word_counts(df, id_col, text_col, least, spelled).where(F.col("n") >= least_count), times)
