"""What the training-data operators share: tables, materialisation, and text batches as flat byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast, by its columns' widths; with more, the same join shuffles.
BROADCAST_BYTES = 16_000_000
_WIDTH = {"bigint": 8, "double": 8, "int": 4, "boolean": 1}


def bound_batches(spark: SparkSession, rows: int = 1500) -> None:
    """Whole texts go to Python in batches of at most `rows`, so that neither side holds many long ones at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def release() -> None:
    """Gives what a finished batch of texts held back to the machine: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of the data folder, with only the columns that are asked for."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only if none is set and all runs on this machine (tests)."""
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sitesift-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: what follows neither recomputes it nor loses it with an executor.

    The folder goes with `discard`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables; whatever reads them has to be materialised itself by now."""
    for df in tables:
        fs, path = _path(df.sparkSession, df._folder)
        fs.delete(path, True)


def fits(df: DataFrame) -> bool:
    """Whether a table of fixed-width columns is within BROADCAST_BYTES; strings and binaries count 32 bytes (ids, digests)."""
    width = 16 + sum(_WIDTH.get(kind, 32) for _, kind in df.dtypes)
    limit = BROADCAST_BYTES // width
    return df.limit(limit + 1).count() <= limit


def among(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """df's rows whose `on` is in keys (materialised), or is not (left_anti): a broadcast while the keys fit, a shuffled join beyond."""
    return df.join(F.broadcast(keys) if fits(keys) else keys, on, how)


def join_hot(left: DataFrame, right: DataFrame, on: str, times: str, total: int) -> DataFrame:
    """left joined to right, which has one row for each `on` and in `times` how many of left's `total` rows have it.

    Keys with more than a hundred-thousandth of all rows (and 1,000 rows) are at most 100,000; they are broadcast, so that no task gathers
    their rows. The other keys meet by a shuffle. left is read twice if there are hot keys.
    """
    bound = max(1000, total // 100_000)
    hot = right.filter(F.col(times) > bound).drop(times)
    if hot.isEmpty():
        return left.join(right.drop(times), on)
    few = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.filter(F.col(times) <= bound).drop(times), on)
    return few.unionByName(rest)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array as one uint8 array and its int64 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bound_rows(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most `value`: two levels of counting, so that no row looks at all of them."""
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    table = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    group = F.size(F.filter(heads, lambda b: b <= value))
    inside = F.size(F.filter(F.coalesce(F.get(table, group - 1), F.array().cast("array<bigint>")), lambda b: b <= value))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)
