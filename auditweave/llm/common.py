"""Helpers shared by the operators: shared storage, table access, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.storage import stored

__all__ = ["WordHashes", "free_name", "give_back", "id_bucket", "marked", "mix64", "partitions", "rows_of", "slices", "small_batches", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null ids fall in none."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a bitmap of hashed keys, 2 MB at most in words of 64.
MARK_BITS = 24


def marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """row (all of df's columns), marked: false where df's key is surely not among wanted's; nulls are not marked.

    The bitmap has at most 2^18 words whatever wanted holds, so it is sent to every executor; the more keys it holds, the more
    others are marked too. Callers join what is marked and let the rest pass.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << MARK_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    at = wanted.where(F.col(key).isNotNull()).select(place(F.col(key).cast("long")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    rows = df.select(F.struct("*").alias("row")).withColumn("at", place(F.col("row")[key].cast("long")))
    joined = rows.withColumn("word", F.when(F.col("row")[key].isNotNull(), F.shiftright("at", 6))).join(F.broadcast(words), "word", "left")
    return joined.select("row", F.coalesce(F.col("bits").bitwiseAND(bit(F.col("at"))) != 0, F.lit(False)).alias("marked"))


def give_back() -> None:
    """Returns freed memory to the system where Arrow and the C library can: the driver and workers that are used again keep it otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, memoised; emptied when it holds `bound` words, so memory stays bounded on any corpus."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """The batches in pieces of few rows, so that what a task makes of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of an Arrow batch in the pipeline; Spark's own 64 MB take several times that in the JVM and in each Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES, unless the session sets a limit itself; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
