"""Byte-level BPE by a hierarchical-bitmap rank queue.

Every pre-token is a linked list of parts. Adjacent pairs wait in one bucket per merge rank; a two-level
bitmap marks the buckets in use, so the next rank is found by two find-first-set steps. Entries whose pair
has changed meanwhile are skipped when they surface. The work for a pre-token of n bytes is near-linear
in n, however long it is.
"""

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from graphloom.llm.common import chunks, map_batches, only

LEAF = 8  # bits of a rank that pick a bit within a leaf of the bitmap
LONG_TEXT = 4_000_000  # characters from which a text is encoded block by block
BLOCK = 500_000  # pre-tokens of such a block
GROUP_NEW = 150_000  # new pre-tokens merged in one queue
LONG_PIECE = 256  # bytes from which a pre-token has a queue of its own
CACHE_ENTRIES = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes and decodes with one rank table. Remembers a bounded number of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.leaves = [0] * ((max(ranks.values()) >> LEAF) + 1)
        self.tokens = {r: b for b, r in ranks.items()}
        self.known: dict[str, int] = {}  # pre-token: its entry in the table
        self.table: list[bytes] = []  # packed ids
        self.new: list[str] = []  # known, but without an entry yet
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int32)
        pairs = {}
        for token, r in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    pairs[a * len(ranks) + b] = r
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_values = np.array([pairs[x] for x in self.pair_keys.tolist()], dtype=np.int64)
        self.byte_pairs = self.pair_ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. All single bytes must be in the rank table."""
        ranks, leaves = self.ranks, self.leaves
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, mask = len(piece), (1 << LEAF) - 1
        parts = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair_rank = [-1] * n
        buckets: dict[int, list[int]] = {}
        top = 0

        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                pair_rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending positions are a heap already
                else:
                    buckets[r] = [i]
                    leaves[r >> LEAF] |= 1 << (r & mask)
                    top |= 1 << (r >> LEAF)
        while top:
            w = (top & -top).bit_length() - 1
            leaf = leaves[w]
            r = (w << LEAF) + (leaf & -leaf).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)  # the leftmost pair of the lowest rank
            if not bucket:
                del buckets[r]
                leaves[w] = leaf = leaf & (leaf - 1)
                if not leaf:
                    top &= top - 1
            if pair_rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            parts[i] += parts[j]
            parts[j] = b""
            pair_rank[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
            p = before[i]
            for a, b in ((i, k), (p, i)):
                if a < 0:
                    continue
                r = ranks.get(parts[a] + parts[b]) if b < n else None
                if r is None:
                    pair_rank[a] = -1
                    continue
                pair_rank[a] = r
                if r in buckets:
                    heappush(buckets[r], a)
                else:
                    buckets[r] = [a]
                    leaves[r >> LEAF] |= 1 << (r & mask)
                    top |= 1 << (r >> LEAF)
        out, i = [], 0
        while i < n:
            out.append(ranks[parts[i]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, in one queue.

        Their linked lists lie side by side, without pairs across a border. The lowest rank of all comes out
        first, hence also the lowest of each pre-token; one step merges the leftmost pair of that rank in every
        pre-token that has one.
        """
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n, mask = len(raw), (1 << LEAF) - 1
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        ids = self.byte_ids[raw]
        here = np.arange(n, dtype=np.int32)
        same = owner[1:] == owner[:-1]
        after, before = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        after[:-1][same] = here[1:][same]
        before[1:][same] = here[:-1][same]
        pair_rank = np.full(n, -1, dtype=np.int32)
        pair_rank[:-1][same] = self.byte_pairs[raw[:-1][same], raw[1:][same]]
        waiting = np.flatnonzero(pair_rank >= 0)
        waiting = waiting[np.argsort(pair_rank[waiting], kind="stable")]
        found, at = np.unique(pair_rank[waiting], return_index=True)
        buckets = dict(zip(found.tolist(), (x.tolist() for x in np.split(waiting, at[1:])))) if len(found) else {}
        leaves, top = [0] * len(self.leaves), 0
        for r in buckets:
            leaves[r >> LEAF] |= 1 << (r & mask)
            top |= 1 << (r >> LEAF)
        while top:
            w = (top & -top).bit_length() - 1
            leaf = leaves[w]
            r = (w << LEAF) + (leaf & -leaf).bit_length() - 1
            i = np.array(buckets.pop(r))
            i = i[pair_rank[i] == r]  # the others are stale
            if len(i) > 1:
                i.sort()
                first = np.ones(len(i), dtype=bool)
                np.not_equal(owner[i[1:]], owner[i[:-1]], out=first[1:])
                if not first.all():
                    buckets[r] = i[~first].tolist()
                    i = i[first]
            if r not in buckets:
                leaves[w] = leaf = leaf & (leaf - 1)
                if not leaf:
                    top &= top - 1
            if not len(i):
                continue
            j = after[i]
            k, p = after[j], before[i]
            ids[i], ids[j], pair_rank[j] = r, -1, -1
            after[i] = k
            more, less = k >= 0, p >= 0
            before[k[more]] = i[more]
            pair_rank[i] = -1
            starts = np.concatenate([i[more], p[less]])
            if not len(starts):
                continue
            ranks = self.pair_ranks(ids[starts], np.concatenate([ids[k[more]], ids[i[less]]]))
            pair_rank[starts] = ranks
            kept = ranks >= 0
            for q, s in zip(ranks[kept].tolist(), starts[kept].tolist()):
                if q in buckets:
                    buckets[q].append(s)
                else:
                    buckets[q] = [s]
                    leaves[q >> LEAF] |= 1 << (q & mask)
                    top |= 1 << (q >> LEAF)
        alive = ids >= 0
        ends = (np.add.reduceat(alive, lengths.cumsum() - lengths, dtype=np.int64).cumsum() * 4).tolist()
        packed = ids[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joined bytes of each pair of ids, -1 where they are no token."""
        keys = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], -1)

    def numbered(self, pieces: list[str]) -> np.ndarray:
        """Entry of every pre-token in the table of known ones; new ones get an entry to be filled by ``learn``."""
        known = self.known
        known.update(zip(new := list(set(pieces).difference(known)), range(len(known), len(known) + len(new))))
        self.new.extend(new)
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int32, count=len(pieces))

    def learn(self) -> None:
        """Fill the entries of the new pre-tokens."""
        raw = [p.encode() for p in self.new]
        ids = [None if (r := self.ranks.get(x)) is None else r.to_bytes(4, "little") for x in raw]
        many = [k for k, x in enumerate(ids) if x is None and len(raw[k]) <= LONG_PIECE]
        for k, x in zip(many, self.merge_many([raw[k] for k in many]) if many else ()):
            ids[k] = x
        self.table += [np.array(self.merge(raw[k]), dtype="<u4").tobytes() if x is None else x for k, x in enumerate(ids)]
        self.new = []

    def forget(self) -> None:
        """Start the table anew once it holds more than CACHE_ENTRIES pre-tokens."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.table = {}, []

    def joined(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, numbers.tolist()))

    def encode(self, text: str):
        """Blocks of packed ids of one text, however long."""
        for pieces in chunks((m.group() for m in self.pattern.finditer(text)), BLOCK):
            self.forget()
            numbers = self.numbered(pieces)
            self.learn()
            yield self.joined(numbers)

    def encode_groups(self, texts: list[str]):
        """The packed blocks of every text in turn. Texts are taken together until they bring GROUP_NEW new pre-tokens."""
        group: list[np.ndarray] = []
        for t in texts:
            if len(t) <= LONG_TEXT:
                group.append(self.numbered(self.pattern.findall(t)))
                if len(self.new) < GROUP_NEW:
                    continue
            self.learn()
            yield from ([self.joined(x)] for x in group)
            group = []
            self.forget()
            if len(t) > LONG_TEXT:
                yield self.encode(t)
        self.learn()
        yield from ([self.joined(x)] for x in group)
        self.forget()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text as (id, ids array). Null texts are empty; rows are kept as they come, copies too."""
    def make():
        c = codec(path, pattern)

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    yield [part.column(0), [np.frombuffer(b"".join(blocks), dtype="<u4").tolist() for blocks in c.encode_groups(texts)]]

        return run

    kind = dict(df.dtypes)[id_col]
    return map_batches(only(df, id_col, text_col), make, f"`{id_col}` {kind}, ids array<bigint>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id list as (id, content). Null lists give null; an id outside the vocabulary raises KeyError."""
    def make():
        c = codec(path, pattern)

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    yield [part.column(0), [None if x is None else c.decode(np.array(x, dtype="<u4").tobytes()) for x in part.column(1).to_pylist()]]

        return run

    kind = dict(df.dtypes)[id_col]
    return map_batches(only(df, id_col, ids_col), make, f"`{id_col}` {kind}, content binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give the digests of both.

    Columns: id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256.
    Null and empty texts have no tokens and the digests of nothing. Repeated rows are answered each; null ids
    stay null; further columns are ignored. A long text is encoded, decoded and hashed block by block.
    """
    def make():
        c = codec(path, pattern)

        def run(batches):
            for b in batches:
                counts, ids_sha, back_sha = [], [], []
                for blocks in c.encode_groups([t or "" for t in b.column(1).to_pylist()]):
                    n, one, two = 0, hashlib.sha256(), hashlib.sha256()
                    for packed in blocks:
                        n += len(packed) >> 2
                        one.update(packed)
                        two.update(c.decode(packed))
                    counts.append(n)
                    ids_sha.append(one.hexdigest())
                    back_sha.append(two.hexdigest())
                yield [b.column(0), counts, ids_sha, back_sha]

        return run

    kind = dict(df.dtypes)[id_col]
    ddl = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(only(df, id_col, text_col), make, ddl)
