"""Helpers shared by the training-data operators: Arrow batches cut by bytes,
collision-free column names, vectorised word hashing, reliable checkpoints."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, ship_package

BATCH_BYTES = 4 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in spark.checkpoint.dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Shuffle files and checkpoints that nothing refers to any more go now, not when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prepare(spark: SparkSession) -> None:
    """What every query needs: the shared folder, the package on the executors, Arrow batches bounded by bytes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_HELD: dict = {}


def held(owner: str, key, make):
    """Tables that a Python worker keeps between tasks: those of one operator, made anew when ``key`` changes."""
    if owner not in _HELD or _HELD[owner][0] != key:
        _HELD.clear()
        _HELD[owner] = (key, make())
    return _HELD[owner][1]


def release(owner: str = "") -> None:
    """Lets tables of other operators than ``owner`` go; tasks call it first, as workers are used again."""
    if owner not in _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system: a worker that waits for its next task keeps what it holds, no more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if trim:
        trim(0)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None and offs[-1] > 0 \
        else np.zeros(0, np.uint8)
    data = data[offs[0]:offs[-1]]
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES):
    """The batch cut to runs of rows with about ``limit`` bytes of ``column`` (a longer row stays whole)."""
    if batch.num_rows == 0:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def append_column(df: DataFrame, name: str, dtype: T.DataType, column: str, make, owner: str = "",
                  limit: int = BATCH_BYTES) -> DataFrame:
    """``df`` with one more column: ``make(array of column)`` per cut batch, no shuffle.

    ``make`` is a function of a pyarrow array that returns an array of the same length; ``owner`` names the tables that
    it finds with :func:`held`, ``limit`` the bytes of the column in a cut batch.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, dtype)])

    def run(batches):
        release(owner)
        for batch in batches:
            for part in slices(batch, column, limit):
                new = make(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, name])
        give_back()

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT = 0xD6E8FEB86659FD93


def powers(n: int, of: int = _MULT) -> np.ndarray:
    """The first n powers of an odd 64-bit multiplier."""
    out = np.full(max(n, 1), np.uint64(of))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Words of concatenated texts. ``table`` maps a byte to its normal form, or to 0x20 for a separator.

    Returns (flat, starts, ends, first): normal bytes in which each word is followed by
    one space, the words' byte ranges in it, and each text's first word (one entry more than texts).
    """
    n = len(offs) - 1
    wide = np.full(len(data) + n, 32, np.uint8)
    inside = np.ones(len(wide), bool)
    inside[offs[1:] + np.arange(n)] = False
    wide[inside] = table[data]
    word = wide != 32
    stop = np.zeros(len(wide), bool)
    if len(wide):
        stop[1:] = word[:-1] & ~word[1:]
    flat = wide[word | stop]
    ends = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(np.flatnonzero(stop), offs + np.arange(n + 1))
    return flat, starts, ends, first


_BLOCK = 1 << 16                 # bytes of words hashed together
_UP = powers(_BLOCK + 1)
_DOWN = powers(_BLOCK + 1, pow(_MULT, -1, 1 << 64))


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``words_of``: its bytes times the powers of their places, mixed.

    Places are counted from the start of a block; a word's sum is then divided by the power of its first place."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        to = max(int(np.searchsorted(ends, a + _BLOCK, side="right")), k + 1)
        size = int(ends[to - 1]) + 1 - a
        at = starts[k:to] - a
        value = _BYTE[flat[a:a + size]]
        value *= _UP[:size] if size <= len(_UP) else powers(size)
        value[ends[k:to] - a] = 0
        out[k:to] = np.add.reduceat(value, at) * _DOWN[at]
        k = to
    return mix(out + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return base + np.arange(total)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of ``kind`` values from flat values and the length of each list."""
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rename_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])
