"""Helpers shared by the training-data operators: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words: space and the control characters 9 to 13.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

#: Text bytes that a task holds as numpy arrays at once.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: For the hashes of words and of runs of words: a value for each byte, an odd base for each use.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(4) + np.uint64(1)


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables between jobs, spark.checkpoint.dir. Where that is unset a session whose tasks all run in
    the driver's own process takes a folder of its own; a cluster has no folder that all its machines share, and raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return at or "file:///tmp/checkpoints"


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, path)
    except Exception:  # the session may be gone at the interpreter's end
        pass


class Table:
    """A DataFrame written to the shared folder and read again: it cuts the lineage, and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_drop_quietly, self.spark, self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def extended(schema: StructType, **more: str) -> StructType:
    """A new schema with further columns; StructType.add would change the DataFrame's own."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in more.items())).fields])


def fresh(name: str, columns: list[str]) -> str:
    """The name, with more underscores before it if a column has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held(columns: list[str]) -> Column:
    """A struct of columns, to be carried along as they are; never without a field."""
    return F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias(fresh("_", columns)))


def utf8(column: pa.Array) -> pa.Array:
    """The column's texts as bytes; null gives no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return column.fill_null(b"")


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together; a longer text is a run of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield batch.slice(i, j - i)
        i = j


def trim() -> None:
    """Gives back what this process holds but doesn't use, as tasks of other operators may have run in it before."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # GNU's only
        libc.malloc_trim(0)


def chunks(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The offset and the bytes of each chunk of a text; chunks of long texts end at white space, so the memory stays bounded."""
    if len(text) <= 2 * CHUNK_BYTES:
        yield 0, np.frombuffer(text, dtype=np.uint8)
        return
    i = 0
    while i < len(text):
        j = min(len(text), i + CHUNK_BYTES)
        while j < len(text) and not SPACES[text[j]]:
            j += 1
        yield i, np.frombuffer(text, dtype=np.uint8, count=j - i, offset=i)
        i = j


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes starts and ends."""
    solid = ~SPACES[b]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(b) and solid[0]:
        edge = np.concatenate(([0], edge))
    if len(b) and solid[-1]:
        edge = np.concatenate((edge, [len(b)]))
    return edge[0::2], edge[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes.

    A word's hash is the sum over its bytes of value[byte] * base ** offset modulo 2 ** 64, then mixed.
    """
    found = [hashes_at(b, *word_spans(b)) for _, b in chunks(text)]
    return np.concatenate(found) if len(found) != 1 else found[0]


def hashes_at(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of the words that lie there, in order and apart."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offset = np.arange(lengths.sum()) - np.repeat(first, lengths)
    terms = BYTE_VALUE[b[np.repeat(starts, lengths) + offset]] * powers(0, int(lengths.max()))[offset]
    return mix(np.add.reduceat(terms, first))


_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1024, 1 << (max(1, n - 1)).bit_length())
        have = np.full(size, BASES[which], dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 20:
            _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of runs of words, from prefix sums of hash * base ** position modulo 2 ** 64."""

    def __init__(self, words: np.ndarray, which: int):
        n = len(words)
        self.power = powers(which, n + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * self.power[:n], dtype=np.uint64)))
        inverse = np.uint64(pow(int(BASES[which]), -1, 1 << 64))
        down = np.full(n + 1, inverse, dtype=np.uint64)
        down[0] = 1
        self.down = np.cumprod(down, dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
