"""BPE, packing, SpotSigs, n-gram join and substring removal against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken


from graphloom.llm import bpe, ngram_join, packing, spotsigs, substring
from graphloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, `n tokens` int, tag string, words string"


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def frame(spark, rows):
    """Documents with further columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(k, t, 1, "x", "y") for k, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here at all"), (7, "=" * 3000), (8, "Größe 漢字 🎉 don't"), (9, "ab " * 5000)]


def test_bpe_like_tiktoken(spark, texts, ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, P.PATTERN)
    random.seed(1)
    bits = ["a", "b", "aa", "th", "e", "ß", "漢", " ", "  ", "\n", "1", "🎉", ".", "=", "====", "́"]
    made = ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(800)] + ["ab" * 5000, "=" * 4001, "x" * 300]
    sample = texts[:60] + made
    for t, blocks in zip(sample, c.encode_groups(sample)):
        raw = b"".join(blocks)
        assert np.frombuffer(raw, dtype="<u4").tolist() == enc.encode_ordinary(t)
        assert c.decode(raw) == t.encode()
    for t in made[-3:]:
        assert c.merge(t.encode()) == enc.encode_ordinary(t)
    rows = bpe.round_trip(frame(spark, EDGES), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(EDGES)
    for r, (k, t) in zip(sorted(rows, key=str), sorted(((k, t) for k, t in EDGES), key=lambda x: 0)):
        assert r["n_tokens"] >= 0
    by_text = {r["decoded_sha256"]: r for r in rows}
    for k, t in EDGES:
        ids = enc.encode_ordinary(t or "")
        r = by_text[hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode(bpe.encode(frame(spark, EDGES), path, P.PATTERN), path, P.PATTERN).collect()
    assert Counter(bytes(r["content"]) for r in back) == Counter((t or "").encode() for _, t in EDGES)


def test_bpe_long_text_in_blocks(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, P.PATTERN)
    many = ["the cat " * 400, "short one", " and  so on " * 200, ""]
    for t, blocks in zip(many, c.encode_groups(many)):
        assert np.frombuffer(b"".join(blocks), dtype="<u4").tolist() == enc.encode_ordinary(t)


def test_shortest_pack_first():
    random.seed(2)
    for size in (8, 64, 1024):
        for _ in range(20):
            h = Counter(random.choices(range(1, size + 1), k=random.randint(1, 400)))
            patterns = packing.shortest_pack_first(h, size)
            placed = Counter()
            for count, items in patterns:
                assert sum(x * n for x, n in items) <= size
                for x, n in items:
                    placed[x] += count * n
            assert placed == h
            # as one by one: longest first, onto the shortest pack with room
            packs: list[int] = []
            for x in sorted(h.elements(), reverse=True):
                fit = [i for i, used in enumerate(packs) if used + x <= size]
                if fit:
                    packs[min(fit, key=lambda i: packs[i])] += x
                else:
                    packs.append(x)
            assert sum(c for c, _ in patterns) == len(packs)
    assert packing.shortest_pack_first({}, 8) == []
    many = packing.shortest_pack_first({512: 10**9, 1: 10**6}, 1024)
    assert sum(c for c, _ in many) == 5 * 10**8 + 977


def test_pack(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    tok = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = packing.added_tokens(P.path("byte_bpe_50k.json"))
    rows = EDGES + [(100 + i, t) for i, t in enumerate(texts[:80])] + [(500, "a <|endoftext|> b"), (501, "<|endoftext|>" * 3 + "c<|endoftext|")]
    out = packing.pack(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, added=added).toPandas()
    assert out[out.doc_id == 501].doc_tokens.tolist() == [3 + len(tok.encode("c<|endoftext|", add_special_tokens=False).ids) + 1]
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t in rows}
    assert out.length.sum() == sum(len(ids[k]) for k, _ in rows)
    for r in out[out.doc_id.notna()].itertuples():
        own = ids[int(r.doc_id)]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], dtype="<u4").tobytes())
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    whole = out.drop_duplicates(["doc_id", "start", "sequence_id", "offset"])
    assert len(whole) == len(out)
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_spotsigs_edits(spark, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts[:50])] + [(1000, None), (1001, ""), (1002, texts[5]), (1003, texts[5]), (-4, "of und de")]
    out = {r["doc_id"]: r for r in spotsigs.compare_edits(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for i, (k, t) in enumerate(order):
        t, other = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[:len(t) - n] + other[:n]
        r = out[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (set(spotsigs.signatures(x, spotsigs.Spots()).tolist()) for x in (t, changed, other))
        for got, x in ((r["near_edited"], b), (r["near_next"], c)):
            want = 1.0 if a == x else len(a & x) / max(1, len(a | x))
            assert abs(got - want) < 1e-9  # of whole sets, however long
    assert out[1002]["fingerprint"] == out[1003]["fingerprint"] and out[1003]["near_next"] == 1.0
    assert spotsigs.compare_edits(frame(spark, [])).count() == 0
    one = spotsigs.compare_edits(frame(spark, [(5, "the cat sat on the mat and so on it went")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    ties = spotsigs.compare_edits(frame(spark, [(5, "b"), (5, "a"), (None, "c"), (None, None)])).collect()
    assert len(ties) == 4


def test_spotsigs_pairs(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and", "to"] * 30
    base = [random.choices(words, k=150) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        for j in range(4):
            w = list(b)
            for _ in range(j * 2):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append((i * 10 + j, " ".join(w)))
    got = {frozenset((r["fingerprint"], r["near_fingerprint"])) for r in spotsigs.near_pairs(frame(spark, rows), 0.6).collect()}
    prints = {spotsigs.fingerprint(spotsigs.signatures(t, spotsigs.Spots())) for _, t in rows}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and spotsigs.likeness(a, b) >= 0.6}
    assert got == want and want


def test_spotsigs_pairs_of_long_texts(spark):
    """Sets of more than SKETCH signatures are told apart and compared whole."""
    random.seed(4)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(f"the {a} {b}" for a, b in zip(random.choices(words, k=300), random.choices(words, k=300))) for _ in range(3)]
    rows = []
    for i, text in enumerate(base):
        for j in range(0, 50, 4):
            w = text.split()
            for at in random.sample(range(300), j):
                w[3 * at + 1] = random.choice(words)
            rows.append((i * 100 + j, " ".join(w)))
    sets = {k: spotsigs.signatures(t, spotsigs.Spots()) for k, t in rows}
    # one signature above the sketch differs: the counts and the sketches agree
    cut = sets[0][:-1].copy(), np.concatenate([sets[0][:-2], sets[0][-1:]])
    assert spotsigs.fingerprint(cut[0]) != spotsigs.fingerprint(cut[1]) and spotsigs.likeness(*map(spotsigs.fingerprint, cut)) < 1.0
    prints = {spotsigs.fingerprint(x): set(x.tolist()) for x in sets.values()}
    want = {frozenset((a, b)): len(x & y) / len(x | y) for a, x in prints.items() for b, y in prints.items() if a < b and len(x & y) / len(x | y) >= 0.8}
    got = spotsigs.near_pairs(frame(spark, rows), 0.8).collect()
    assert min(map(len, prints.values())) > spotsigs.SKETCH and len(got) == len(want) > 20
    assert {frozenset((r["fingerprint"], r["near_fingerprint"])): r["similarity"] for r in got} == want


def test_spotsigs_pairs_of_a_frequent_signature(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "CELL_ROWS", 3)
    test_spotsigs_pairs(spark)


def brute_components(rows):
    def tokens(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(k, tokens(t)) for k, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        low[find(i)].append(k)
    return {(k, len(s), min(low[find(i)])) for i, (k, s) in enumerate(sets)}


def test_ngram_join(spark, texts):
    random.seed(4)
    vocab = [f"w{i}" for i in range(400)]
    passage = random.choices(vocab, k=40)
    rows = [(i, t) for i, t in enumerate(texts)]
    for g in range(6):
        base = random.choices(vocab, k=random.choice([6, 30, 120, 300]))
        for j in range(12):
            w = list(base)
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append((1000 + g * 100 + j, " ".join(w) if j % 3 else " ".join(w).upper()))
    chain = random.choices(vocab, k=100)
    for j in range(8):  # each like the one before, the ends unlike
        rows.append((2000 - j, " ".join(chain[j * 8:] + chain[:j * 8])))
    rows += [(3000 + i, " ".join(passage + random.choices(vocab, k=60))) for i in range(20)]
    rows += [(4000, None), (4001, ""), (4002, "\n"), (4003, "two words"), (4004, "Two  WORDS"), (4005, "x"), (4006, texts[3]), (4006, texts[3])]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(frame(spark, rows)).collect()]
    assert len(got) == len(rows) and set(got) == brute_components(rows)
    assert ngram_join.join_documents(frame(spark, [])).count() == 0
    assert len(ngram_join.join_documents(frame(spark, [(None, "a b c d e f"), (None, None), (3, "a b c d e f")])).collect()) == 3


def test_prefix_filters_lose_nothing():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, ngram_join.BUCKETS)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.75, 1)))], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 6) + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert ngram_join.linked(a, b) == (100 * common >= 80 * (len(a) + len(b) - common))
        if ngram_join.linked(a, b):
            assert np.isin(ngram_join.first_prefix(a, counts)[0], ngram_join.first_prefix(b, counts)[0]).any()
            for x, y in zip(ngram_join.further_prefixes(a), ngram_join.further_prefixes(b)):
                assert np.isin(x, y).any()


def test_components(spark):
    random.seed(6)
    links = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 330)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


def brute_repeats(rows, window=20):
    first, out = {}, {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        kept = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i:i + window]), (k, i)) != (k, i):
                kept[i:i + window] = [False] * window
        out[k] = (len(w), kept.count(False), hashlib.sha256(b" ".join(x for x, s in zip(w, kept) if s)).hexdigest())
    return out


def test_substring(spark, texts, monkeypatch):
    random.seed(7)
    vocab = [f"w{i}" for i in range(50)]
    passage = random.choices(vocab, k=45)
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(40):
        a = random.choices(vocab, k=random.randint(0, 60))
        b = random.choices(vocab, k=random.randint(0, 60))
        cut = random.randint(0, 20)
        rows.append((1000 + i, " ".join(a + passage[cut:] + b)))
    rows += [(2000, "a " * 200), (2001, "a b c " * 40), (2002, "b c a " * 15), (2003, None), (2004, ""), (2005, "x\ty\n" * 30), (2006, " ".join(passage[:20])), (2007, " ".join(passage[:19]))]
    want = brute_repeats(rows)
    for limit in (256, 3):  # the smaller one divides the buckets
        monkeypatch.setattr(substring, "BUCKET_STRINGS", limit)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest_kept(frame(spark, rows)).collect()}
        assert got == want
    assert substring.digest_kept(frame(spark, [])).count() == 0
    twice = substring.digest_kept(frame(spark, [(1, texts[0]), (1, texts[0]), (None, texts[0]), (None, None)])).collect()
    assert len(twice) == 4
    text = {r["doc_id"]: r for r in substring.drop_repeats(frame(spark, rows), keep=("tag",)).collect()}
    assert text[2003]["text"] is None and text[2007]["text"] == " ".join(passage[:19]) and text[5]["tag"] == "x"
    assert all(hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == want[k][2] for k, r in text.items())


def joined_rows(spark, since):
    """Most rows that one join by content of the executions after ``since`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList()
    most = 0
    for i in range(found.size()):
        k = found.apply(i).executionId()
        if k <= since:
            continue
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for j in range(nodes.size()):
            if "Join" in nodes.apply(j).name() and "content" in nodes.apply(j).desc():
                metrics = nodes.apply(j).metrics()
                for m in range(metrics.size()):
                    if metrics.apply(m).name() == "number of output rows":
                        value = values.get(metrics.apply(m).accumulatorId())
                        most = max(most, int(value.get().replace(",", "")) if value.isDefined() else 0)
    return most


def test_a_frequent_passage_is_not_joined_row_by_row(spark, monkeypatch):
    """A passage of 300 texts: its super-k-mers are found next to each other, only the first of every part is joined."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    passage = rng.choices(vocab, k=60)
    rows = [(i, " ".join(rng.choices(vocab, k=25) + passage)) for i in range(300)]
    want = brute_repeats(rows)
    for limit in (50, 4096):  # the smaller one divides the classes into six parts
        monkeypatch.setattr(substring, "CLASS_ROWS", limit, raising=False)
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = max((found.apply(i).executionId() for i in range(found.size())), default=-1)
        spans = substring.materialize(substring.repeated_spans(frame(spark, rows).selectExpr("doc_id AS id", "text")), "spans")
        seen = spans.select("id", "at").distinct().count()
        made = joined_rows(spark, since)
        assert seen > 1000 and 10 * made < seen
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest_kept(frame(spark, rows)).collect()}
        assert got == want


def test_equal_windows_have_equal_minimisers():
    hashes = substring.Hashes()
    rng = random.Random(8)
    for _ in range(50):
        w = [b"w%d" % rng.randint(0, 3) for _ in range(rng.randint(20, 80))]
        mini, content, at, n = substring.super_kmers(hashes.array(w))
        seen = {}
        assert n.sum() == len(w) - 19 and at[0] == 0
        for m, a, k in zip(mini.tolist(), at.tolist(), n.tolist()):
            for i in range(a, a + k):
                assert seen.setdefault(tuple(w[i:i + 20]), m) == m
