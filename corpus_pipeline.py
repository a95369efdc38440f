"""Corpus pipeline: quality filter, near-duplicate removal, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's documents. All stages but the last return the columns of
``documents``.
"""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import crf_quality, ngram_join, packing, substring
from graphloom.llm.common import Hashes
from graphloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tag():
    """Bucket of a row's id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(ngram_join.BUCKETS)).cast("int").alias("tag")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good; its labels never count as inputs of a score. A null text scores as an
    empty one."""
    field = crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = crf_quality.score(docs, field, keep=tuple(COLUMNS))
    return scored.where("predicted = 1").select(COLUMNS)


def marked_rows(docs: DataFrame, bits, want: bool) -> DataFrame:
    """Rows whose id falls, or does not fall, into a marked bucket; those that do with the key of their set."""
    schema = T.StructType([*docs.select(COLUMNS).schema.fields, *([T.StructField("_key", T.BinaryType())] if want else [])])

    def run(batches):
        hashes = Hashes()
        for b in batches:
            found = b.filter(pa.array(bits.value[b.column(b.num_columns - 1).to_numpy()] == want)).select(COLUMNS)
            if want:
                sets = (ngram_join.shingles(t, hashes) for t in found.column("text").to_pylist())
                found = found.append_column("_key", pa.array([ngram_join.set_key(s) if len(s) else None for s in sets], type=pa.binary()))
            yield found

    return docs.select(*COLUMNS, tag().alias("_tag")).mapInArrow(run, schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of the smallest id. Of several texts under that id the one of the
    smallest key stays; a text without links stays whatever else its id holds. Rows of equal id and equal set count as one: the
    smallest in the order of their columns. Rows without an id name no component and stay.

    Only rows that may have to go are shuffled: ids that go, or come twice, mark buckets of a table of fixed size.
    """
    found = materialize(ngram_join.join_documents(docs, keys=True), "components").where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("leads").alias("leads"))
    bits = spark.sparkContext.broadcast(substring.marked(ids.where("_n > 1 or not leads").select(tag())))
    some = marked_rows(docs, bits, True)
    stay = found.where("leads").select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_set")).distinct()
    kept = some.join(stay, (F.col("doc_id") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_set")), "left_semi")
    kept = kept.groupBy("doc_id", "_key").agg(F.min(F.struct(*COLUMNS)).alias("_row")).select("_row.*")
    return marked_rows(docs, bits, False).union(kept).union(some.where("doc_id is null").select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occur earlier in the corpus."""
    return substring.drop_repeats(docs, keep=("lang", "source")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]
ORACLE_SQL = None  # the first stage is a fitted model, the last a packing: neither is SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
