"""Shared pieces of the corpus operators: row packing, scratch tables, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqscope.session import ensure_checkpoint_dir

#: Text bytes worked on at a time inside a task; bounds the size of the numpy arrays.
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch: texts are long, and a task holds a batch in the JVM and in Python.
BATCH_ROWS = 1000
#: Bytes of [\x20\x09-\x0D], the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def default_parts(spark: SparkSession, factor: int = 1) -> int:
    """Partitions for a shuffle of the corpus: the session's own setting, times a factor."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * factor


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to BATCH_ROWS rows unless the user has set its size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def scratch(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor; the folder can be
    removed when the results that were derived from it have been stored.  What the write
    shuffled is not needed any more: Spark drops the files of a shuffle once the driver's
    garbage collector finds it unused, so that is asked for here, and disks hold the
    exchanges of one step at a time; ``free=False`` leaves that to the next step that asks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _free(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _free(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_free(kind.elementType))
    return T.MapType(kind.keyType, _free(kind.valueType)) if isinstance(kind, T.MapType) else kind


def pack(docs: DataFrame, columns: list[str] | None = None, **own: Column) -> DataFrame:
    """One struct column ``_row`` with the input columns (or some), and own columns beside it.

    Whatever the input's columns are called, they cannot clash with the operator's."""
    small_batches(docs.sparkSession)
    row = [docs[f"`{c}`"] for c in (docs.columns if columns is None else columns)]
    packed = docs.select(F.struct(F.lit(None).cast("int").alias("_"), *row).alias("_row"), *[c.alias(k) for k, c in own.items()])
    kind = packed.schema["_row"].dataType
    free = _free(kind)  # as functions declare it: the declared type and that of the rows must agree
    return packed if free == kind else packed.withColumn("_row", F.col("_row").cast(free))


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all others in one column ``kept``, so that what the
    operator adds cannot meet them; ``restored`` takes them out again."""
    others = [docs[f"`{c}`"] for c in docs.columns if c not in used]
    return docs.select(F.struct(F.lit(None).cast("int").alias("_"), *others).alias("kept"), *[docs[f"`{c}`"] for c in used if c in docs.columns])


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of ``docs`` after ``aside``; ``new`` gives some other values."""
    held = df.schema["kept"].dataType.names
    return df.select(*[(new[c] if c in new else F.col("kept").getField(c) if c in held else F.col(f"`{c}`")).alias(c) for c in columns])


def without(docs: DataFrame, column: str) -> list[str]:
    """The input's columns but one: a text that a stage reads goes beside ``_row``, not twice."""
    return [c for c in docs.columns if c != column]


def unpack(df: DataFrame, columns: list[str], replace: dict[str, Column] | None = None,
           add: dict[str, Column] | None = None) -> DataFrame:
    """The input's columns again; ``replace`` gives some new values, and an added column
    takes the place of an input column of the same name."""
    replace, add = replace or {}, add or {}
    kept = [(replace[c] if c in replace else F.col("_row").getField(c)).alias(c)
            for c in columns if c not in add]
    return df.select(*kept, *[c.alias(k) for k, c in add.items()])


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    small_batches(docs.sparkSession)
    return F.coalesce(docs[f"`{column}`"].cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent 64-bit hash of 64-bit values for each seed."""
    return mix64(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have:have + take] = out[:take] * step
        have += take
    return out[:n]


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_BASE_INV, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def trim() -> None:
    """Gives memory that a worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every libc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them) of a string column, about
    ``most`` bytes at a time; one text is never cut, null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(max(lo + 1, np.searchsorted(at, at[lo] + most, "right") - 1))
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi
    trim()


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word ``[^\\x20\\x09-\\x0D]+`` of consecutive texts.

    The hash of a word is a 64-bit polynomial of its bytes (A-Z lower-cased) from prefix
    sums, mixed with the word's length."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    first = first[:n]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    start = np.flatnonzero(starts)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:]
    end = np.flatnonzero(stops) + 1
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))
    return h, np.searchsorted(at, start, "right") - 1, start, end


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the runs of ``width`` words inside a row; a row with fewer words, but
    at least one, has its whole sequence as its only shingle.  Repeats are kept."""
    n = len(h)
    count = np.bincount(row, minlength=n_rows)
    if n < width:
        full, full_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    else:
        acc = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            acc = acc * np.uint64(_BASE) + h[k:n - width + 1 + k]
        ok = row[:n - width + 1] == row[width - 1:]
        full, full_row = mix64(acc[ok]), row[:n - width + 1][ok]
    short = np.flatnonzero((count > 0) & (count < width))
    if not len(short):
        return full, full_row
    begin = np.searchsorted(row, short)
    own = []
    for r, b in zip(short.tolist(), begin.tolist()):
        acc1 = 0
        for x in h[b:b + int(count[r])].tolist():
            acc1 = (acc1 * _BASE + x + 1) % (1 << 64)
        own.append(acc1 ^ int(count[r]))
    value = np.concatenate([full, mix64(np.array(own, np.uint64))])
    where = np.concatenate([full_row, short])
    order = np.argsort(where, kind="stable")
    return value[order], where[order]


def distinct_sets(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, rows in order."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, row


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 seen as int64, the type that Spark has."""
    return x.view(np.int64)


def list_array(values: np.ndarray, row: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """Arrow list column from values that are ordered by row."""
    at = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n_rows), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
