"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenized once and cut into pieces. Only the histogram of piece lengths (at most
``size`` numbers) goes to the driver. There, lengths are placed longest first on the shortest pack that has
room, for all packs of one pattern at a time. The patterns come back as slots: ranges of ranks within a
length. A distributed rank per length then joins every piece to its slot.
"""

import heapq
import json
import zlib

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import load_ranks
from graphloom.llm.common import map_batches, materialize, only

RANK_ROWS = 20_000  # pieces of one length numbered by one task
_encodings: dict = {}


def _encoding(path: str, pattern: str, added: dict[str, int]):
    key = (path, pattern, *sorted(added.items()))
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=added)
    return _encodings[key]


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a tokenizer file adds to its vocabulary: a text that spells one holds its id there."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    odd = [t["content"] for t in found if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]
    if odd:
        raise ValueError(f"added tokens with rules of their own are not supported: {odd}")
    return {t["content"]: t["id"] for t in found}


def cut(n: int, size: int) -> list[int]:
    """Piece lengths of a document of n ids: full pieces, then the rest."""
    return [size] * (n // size) + ([n % size] if n % size else [])


def pieces(df: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
           added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of every document: its ids, then ``end_id``, cut into ``size`` ids and a rest. Texts are split at ``added`` tokens
    first, as the tokenizer does that has them.

    Columns: id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens.
    Null texts are empty: one piece holding ``end_id`` alone. Rows are kept as they come, copies too.
    """
    added = added or {}

    def make():
        enc = _encoding(path, pattern, added)

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows: tuple[list, ...] = ([], [], [], [], [])
                    for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        ids = enc.encode(text, allowed_special="all") if text else []
                        ids.append(end_id)
                        raw = memoryview(np.array(ids, dtype="<u4")).cast("B")
                        start = 0
                        for length in cut(len(ids), size):
                            for column, v in zip(rows, (key, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), len(ids))):
                                column.append(v)
                            start += length
                    yield list(rows)

        return run

    kind = dict(df.dtypes)[id_col]
    return map_batches(only(df, id_col, text_col), make, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count of packs, [(length, copies), ...]) that place every length of the histogram.

    Lengths go longest first to the shortest open pack, which is the one with most room. All packs of equal
    room and pattern are handled as one group, so the work depends on the number of lengths, not of pieces.
    """
    done: list = []
    open_: list = []  # heap of (-room, order, count, items): the shortest packs first
    order = 0
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        while left:
            if open_ and -open_[0][0] >= length:
                room, _, count, items = heapq.heappop(open_)
                room = -room
                used = min(left, count)
                if used < count:
                    heapq.heappush(open_, (-room, order, count - used, items))
                    order += 1
                if items[-1][0] == length:
                    new = [*items[:-1], (length, items[-1][1] + 1)]
                else:
                    new = [*items, (length, 1)]
                left -= used
                count, room = used, room - length
            else:  # none has room: a new pack takes as many of this length as fit
                each = min(size // length, left)
                count, room, new = left // each, size - each * length, [(length, each)]
                left -= count * each
            if room:
                heapq.heappush(open_, (-room, order, count, new))
                order += 1
            else:
                done.append((count, new))
    return done + [(count, items) for _, _, count, items in sorted(open_, key=lambda g: g[1])]


def slots(patterns, first_id: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of ranks, copies a pack, first sequence id, first offset) of every pattern entry."""
    taken: dict[int, int] = {}
    out, sequence = [], first_id
    for count, items in patterns:
        offset = 0
        for length, copies in items:
            rank = taken.get(length, 0)
            out.append((length, rank, count * copies, copies, sequence, offset))
            taken[length] = rank + count * copies
            offset += length * copies
        sequence += count
    return out


def rank_in_length(found: DataFrame, id_col: str, total: int) -> DataFrame:
    """Add ``_rank``, the 0-based number of a piece among those of its length.

    A length may hold most pieces, so each is dealt over enough buckets; buckets are numbered on their own and
    shifted by the counts of the buckets before them.
    """
    n_buckets = total // RANK_ROWS + 1
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "start"), F.lit(n_buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "start", "doc_tokens", "ids_crc32")
    numbered = dealt.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(shift, ["length", "_bucket"]).withColumn("_rank", F.col("_rn") - 1 + F.col("_shift")).drop("_rn", "_shift", "_bucket")


def pack(df: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         added: dict[str, int] | None = None) -> DataFrame:
    """Pack the documents of ``df``: one row per piece with sequence_id and offset.

    Full pieces are sequences of their own; rests are packed by ``shortest_pack_first``. Copies of a row are
    packed each. An empty table gives no rows. Null ids, null and empty texts are packed like others.
    """
    spark = df.sparkSession
    found = materialize(pieces(df, path, pattern, size, end_id, id_col, text_col, added), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    patterns = shortest_pack_first(histogram, size)
    table = spark.createDataFrame(slots(patterns), "length bigint, _first bigint, _many bigint, _copies bigint, _sequence bigint, _offset bigint")
    ranked = rank_in_length(found, id_col, sum(histogram.values()))
    at = F.col("_rank") - F.col("_first")
    # the slots depend on the lengths only (a few per length), not on the number of documents
    placed = ranked.join(F.broadcast(table), "length").where((at >= 0) & (at < F.col("_many")))
    return placed.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(at / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_copies") * F.col("length")).cast("long").alias("offset"),
    )
