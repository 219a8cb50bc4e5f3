"""Shared helpers: table access, stored intermediates, blocks of texts and hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes that are not ASCII white space; bytes.split() splits by just these six.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
U64 = np.uint64
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one all executors share, as spark.checkpoint.dir names it; in the
    warehouse, which they share too, where that is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named}/tessera-{context.applicationId}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder: what follows neither computes it again nor depends on executors that may be lost."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Remove what this application stored; for when no frame made from it is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of 16 MB at most: several copies of a batch live there at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def given_back() -> None:
    """Memory that this process has freed goes back to the system, where its C library can do so."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: str) -> Column:
    """64 bits of the columns: rows that repeat in full share one."""
    return F.xxhash64(*columns)


def fold_of(doc_id, modulus: int) -> int:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def fold(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random odd number for each byte, and the base of the rolling hashes.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
BASE = 0xD1342543DE82EF95


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, extended when a longer block needs them."""

    inverse = pow(BASE, -1, 1 << 64)
    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * U64(pow(BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * U64(pow(cls.inverse, k, 1 << 64))])
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Prefix sums of symbol values times powers of BASE: the hash of any range comes from two of them."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k symbols."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + U64(k))


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~WHITE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
