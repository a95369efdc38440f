"""Spelling variants, exact deduplication and vector codes against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm import exact_dedup, spelling, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n int, h string, digest string, e int, bucket int"


def frame(spark, rows):
    """Documents with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1, "y", "z", 2, 3) for k, t in rows], DOCS).repartition(3)


# spelling


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter, by definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows, least=6):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            out[run] += len(run) >= least
    return {w: n for w, n in out.items() if n}


def plain_variants(words, times=5):
    out, form = {}, {}
    around = {w: [o for o in words if near(w, o)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(around[w]), words[form[w]] if w in form else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_on_documents(spark):
    rows = list(zip(*[pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")]))
    rows += [(None, None), (None, "Straße straßen STRASSE " * 6), (-1, ""), (-2, "× ÷ÿÀ"), (-2, "Straße" * 2000), (5, "wörter " * 300_000)]
    words = {w: n for w, n in plain_words(rows).items() if n >= 5}
    assert as_dict(spelling.spelling_groups(frame(spark, rows))) == plain_variants(words)
    assert spelling.spelling_groups(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("group_rows", [2, 4096])
def test_variants_of_any_words(spark, group_rows):
    """Short and long words, letters beyond the basic plane, nulls, ties, chains of forms, and groups that are cut to the end."""
    random.seed(3)
    words = {"".join(random.choices("ab", k=random.randint(2, 9))): random.choice([1, 1, 5, 5, 30, 200]) for _ in range(400)}
    words |= {"漢字🎉字": 3, "漢字🎉": 20, "漢🎉字": 20, "a\0b": 4, "a\0bc": 9, "x" * 5000: 2, "x" * 5001: 10, "x" * 2500 + "y" + "x" * 2500: 60}
    words |= {"chains": 1, "chainss": 5, "chaines": 5, "chainsse": 30, "chainssen": 200}
    df = spark.createDataFrame([*words.items(), (None, 7), ("z", 4), ("", 4)], "word string, n long")
    assert as_dict(spelling.variants(df, group_rows=group_rows)) == plain_variants(words)


def test_position_index_tracks_both_sets():
    random.seed(4)
    m = 5
    middles = ["".join(random.choices("abc", k=m + random.randint(0, 1))) for _ in range(300)]
    middles = list(dict.fromkeys(middles))
    group = np.array([random.randint(0, 2) for _ in middles])
    index = spelling.PositionIndex(middles, group, m)
    asked = np.flatnonzero(~index.longer)
    found = set(zip(*(x.tolist() for x in index.near(asked))))
    want = {(i, j) for i, j in itertools.product(asked.tolist(), range(len(middles)))
            if group[i] == group[j] and near(middles[i], middles[j]) and (len(middles[j]) > m or j > i)}
    assert found == want and want


# exact deduplication


def plain_dedup(rows):
    groups: dict = {}
    for key, text in rows:
        raw = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
        groups.setdefault(hashlib.sha256(raw).hexdigest(), []).append(key)
    out = []
    for digest, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        at = keys.index(best)
        out += [(k, best, len(keys), i == at, digest) for i, k in enumerate(keys)]
    return Counter(out)


def result(df):
    return Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect())


def test_cuckoo_filter_keeps_and_deletes():
    random.seed(5)
    live = exact_dedup.Live()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for d in digests:
        live.add(d, [b""])
    assert len(live.filter.slots) >= 5000  # it overflowed and was rebuilt from the stored keys several times
    assert all(d in live.filter for d in digests)
    others = [hashlib.sha256(f"o{i}".encode()).digest() for i in range(5000)]
    assert sum(d in live.filter for d in others) < 20
    for d in digests[:4990]:
        live.remove(d)
    assert sum(map(bool, live.filter.slots)) == 10 and all(d in live.filter for d in digests[4990:])
    again = exact_dedup.CuckooFilter(data=live.filter.tobytes())
    assert all(d in again for d in digests[4990:]) and sum(d in again for d in others) <= 1
    assert not again.delete(next(d for d in digests if d not in again))


def test_one_fingerprint_many_digests():
    """Digests that share fingerprint and buckets overflow; more bits of the digest part them."""
    live = exact_dedup.Live()
    made = [i.to_bytes(8, "little") + b"\7\0" + bytes(22) for i in range(0, 64 * 40, 64)]
    for d in made:
        live.add(d, [b""])
    assert all(d in live.filter for d in made) and sum(map(bool, live.filter.slots)) == len(made)


def test_contents_are_verified():
    live = exact_dedup.Live()
    zip_ = exact_dedup.zstandard.compress
    d = hashlib.sha256(b"a").digest()
    live.add(d, [zip_(b"a")])
    assert live.find(d, b"a") is not None
    with pytest.raises(RuntimeError):
        live.find(d, b"another text")


@pytest.mark.parametrize("chunk", [2, 1000])
def test_exact_dedup_build_insert_delete(spark, monkeypatch, chunk):
    monkeypatch.setattr(exact_dedup, "CHUNK_IDS", chunk)
    random.seed(6)
    texts = ["a", "A", "b", None, "", "Ä", "ä", "long " * 400_000, "ccc", "CcC", "İ"]
    rows = [(random.choice([None, *range(60)]), random.choice(texts)) for _ in range(200)] + [(None, "no id"), (None, "no id")]
    rows += [(i + 100, f"u{i}") for i in range(700)]
    index = exact_dedup.build(frame(spark, rows))
    assert result(exact_dedup.verdicts(index)) == plain_dedup(rows)
    more = [(i + 5000, f"U{2 * i}") for i in range(500)]
    index = exact_dedup.insert(index, frame(spark, more))
    assert result(exact_dedup.verdicts(index)) == plain_dedup(rows + more)
    gone = {*range(50), *range(3000, 5400)}
    index = exact_dedup.delete(index, spark.createDataFrame([*((i,) for i in gone), (None,), (10 ** 9,)], "x long"))
    left = [r for r in rows + more if r[0] not in gone]
    assert result(exact_dedup.verdicts(index)) == plain_dedup(left)
    # filters and keys hold the live digests, no more and no less
    live = len({(t or "").encode().lower() for _, t in left})
    marks = sum(sum(map(bool, exact_dedup.CuckooFilter(data=bytes(r["slots"])).slots)) for r in index.filters.collect())
    assert index.keys.count() == live == marks
    index = exact_dedup.insert(index, frame(spark, rows))
    assert result(exact_dedup.verdicts(index)) == plain_dedup(left + rows)
    assert exact_dedup.dedup(frame(spark, rows).where("false")).count() == 0


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """By definition, with Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[int(x) * 4096 if abs(x) > 1 << 40 else math.floor(4096 * x) for x in r[1]] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    codes, errors, flat = [""] * len(rows), [0] * len(rows), []
    for cols in np.array_split(np.arange(len(whole[0])), parts):
        vs = [[w[c] for c in cols] for w in whole]
        book = [vs[i] for i in first]
        near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, b)), k) for k, b in enumerate(book))
        for _ in range(rounds):
            own: dict = {}
            for v in vs:
                own.setdefault(near(v)[1], []).append(v)
            book = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else b for k, b in enumerate(book)]
        for i, v in enumerate(vs):
            d, k = near(v)
            codes[i] += f"{k:02x}"
            errors[i] += d
        flat += [str(x) for b in book for x in b]
    label = Counter()
    for r, e in zip(rows, errors):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(flat).encode()).hexdigest()
    cap = lambda e: min(e, (1 << 63) - 1)
    return Counter((r[0], c, cap(e), cap(label[r[2]])) for r, c, e in zip(rows, codes, errors)), digest


def coded(df, **more):
    found, books = vector_codes.codes(df, **more)
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.label_errors(found).collect()), vector_codes.books_digest(books)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int, ids string, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "i", 2) for r in rows], VECTORS).repartition(2)


def test_vector_codes_on_embeddings(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(*[t.column(c).to_pylist() for c in ("vec_id", "embedding", "label")]))
    assert coded(spark.read.parquet(f"{SF}/embeddings.parquet")) == plain_codes(rows)


@pytest.mark.parametrize("width", [3, 11, 16])
def test_vector_codes_edges(spark, monkeypatch, width):
    """Null ids, labels and components, repeated rows, ties, odd widths, more than one block."""
    monkeypatch.setattr(vector_codes, "BLOCK", 40)
    random.seed(width)
    rows = [(i, [float(random.choice([-1, 0, 0, 1])) / 4096 + random.choice([0, 1]) for _ in range(width)], random.choice([None, 1, 2])) for i in range(150)]
    rows += [(None, [0.5] * width, None), (7, [0.25] * width, 1), (7, [0.25] * width, 1)]
    drop = [(1000, None, 1), (1001, [None] + [1.0] * (width - 1), 1), (1002, [float("nan")] * width, None), (1003, [float("inf")] + [0.0] * (width - 1), 2), (1004, [1.0] * (width + 1), 2), (1005, [], 1)]
    assert coded(vectors(spark, rows + drop)) == plain_codes(rows)
    few = rows[:5]
    assert coded(vectors(spark, few)) == plain_codes(few)
    none, books = vector_codes.codes(vectors(spark, drop[:2]))
    assert none.count() == 0 and books == []


def test_vector_codes_of_large_components(spark):
    random.seed(9)
    rows = [(i, [random.choice([-1.0, 1.0]) * 2.0 ** random.randint(-3, 50) for _ in range(16)], i % 3) for i in range(60)]
    assert coded(vectors(spark, rows)) == plain_codes(rows)
    assert coded(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)]))[0].total() == 2


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(2)
    centres = rng.integers(-40_000, 40_000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))).astype(np.int64)
    tree = vector_codes.CoverTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(4000)) and (points[tree.order] == tree.points).all()
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i]:tree.end[i]]
        far = np.sqrt(((own - own[0]) ** 2).sum(axis=1).max())
        assert np.isclose(far, tree.radius[i]) and (tree.sums[i] == own.sum(axis=0)).all()
        kids = range(tree.child[i], tree.child[i + 1])
        if len(kids):
            assert [tree.start[k] for k in kids] == [tree.start[i], *(tree.end[k] for k in kids[:-1])] and tree.end[kids[-1]] == tree.end[i]
            mid = tree.points[[tree.start[k] for k in kids]]
            gap = np.sqrt(((mid[:, None] - mid[None]) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
            assert (gap > max(tree.radius[k] for k in kids)).all()  # separated further than covered
    entries = points[:16] + rng.integers(-50, 50, (16, 8))
    sums, counts, exact, chosen = tree.assign(entries, each=True)
    near = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (chosen == near).all() and (counts == np.bincount(near, minlength=16)).all()
    assert all((sums[k] == tree.points[near == k].sum(axis=0)).all() for k in range(16))
    assert exact < 4000 * 16 / 10  # whole subtrees were assigned
