"""Helpers shared by the operators: word lists, bounded hash tables, Arrow batches, shared tables."""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import batch_by_bytes, materialize, ship_package

__all__ = ["Hashes", "distribute", "materialize", "map_batches", "mix", "table", "words"]

CACHE_ENTRIES = 200_000
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(),
          "boolean": pa.bool_(), "binary": pa.binary()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text (none for null), as UTF-8; bytes.split() uses exactly those separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value

    def array(self, ws) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (murmur finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _type(simple: str) -> pa.DataType:
    if simple.startswith("array<"):
        return pa.list_(_type(simple[6:-1]))
    return _ARROW[simple]


def arrow_schema(ddl: str) -> pa.Schema:
    fields = T.StructType.fromDDL(ddl).fields
    return pa.schema([pa.field(f.name, _type(f.dataType.simpleString())) for f in fields])


def map_batches(df: DataFrame, make, ddl: str) -> DataFrame:
    """``make()`` runs once per task and gives fn(batches) -> lists of columns in the order of ``ddl``.

    Batches are Arrow record batches, bounded in rows and in bytes, and so is a worker's memory.
    """
    ship_package(df.sparkSession)
    batch_by_bytes(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches):
        for columns in make()(batches):
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)


def distribute(df: DataFrame, factor: int = 1) -> int:
    """Number of partitions for work on ``df``'s session."""
    return factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name and under their own names, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def chunks(items, n: int):
    it = iter(items)
    while block := list(itertools.islice(it, n)):
        yield block
