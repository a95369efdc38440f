"""The pipeline, stage by stage, against brute force on small data."""

import numpy as np
import public_tokenizers as P
import tiktoken
from test_text_operators import brute_components, brute_repeats

import corpus_pipeline as C
from graphloom.llm import bpe, crf_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = docs.toPandas()
    field = crf_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = None
    for name, stage in C.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out = docs.toPandas()
        if name != "packing":
            assert out.columns.tolist() == C.COLUMNS and out.doc_id.is_unique
        if name == "quality":
            good = [k for k, t in zip(whole.doc_id, whole.text) if field.score([t])[0] >= crf_quality.CUT]
            assert sorted(out.doc_id) == sorted(good) and 0 < len(good) < len(whole)
            assert out.merge(whole, on=C.COLUMNS).shape[0] == len(out)
        elif name == "near_duplicates":
            want = {c for _, _, c in brute_components(list(zip(kept.doc_id, kept.text)))}
            assert set(out.doc_id) == want and len(want) < len(kept)
            assert out.merge(kept, on=C.COLUMNS).shape[0] == len(out)
        elif name == "repeated_passages":
            want = brute_repeats(list(zip(kept.doc_id, kept.text)))
            before = dict(zip(kept.doc_id, kept.text))
            for r in out.itertuples():
                n, gone, _ = want[r.doc_id]
                assert len(r.text.encode().split()) == n - gone and r.n_chars == len(r.text)
                assert gone or r.text == before[r.doc_id]
            assert len(out) == len(kept)
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert out.length.sum() == sum(len(enc.encode_ordinary(t)) + 1 for t in kept.text)
            assert (out.groupby("sequence_id").length.sum() <= 1024).all() and np.all(out.length > 0)
        kept = out
    assert C.run(spark, SF).count() == len(kept)


def test_duplicate_stage_keeps_one_row_an_id(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A B c d e f g", "en", "s", 13), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in C.near_duplicates(spark, docs, SF).collect())
    assert got == ["1", "3", "4", "None"]
    assert C.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_duplicate_stage_keeps_every_text_of_an_id(spark):
    """Ids that hold several texts: copies go, unlinked texts stay, with null and empty ones."""
    rows = [(5, "x y z u v w q"), (6, "x y z u v w q"), (6, "a text of its own that nothing else holds"), (1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"),
            (7, "One two three four five six"), (8, ""), (8, "  "), (8, None), (9, "zz yy xx ww vv uu"), (9, "ZZ yy xx ww vv uu"), (None, "x y z u v w q"), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, docs, SF).collect()), key=str)
    want = [(5, rows[0][1]), rows[2], rows[3], rows[4], (8, None), (9, "ZZ yy xx ww vv uu"), (None, rows[0][1]), (None, None)]
    assert got == sorted(want, key=str)
