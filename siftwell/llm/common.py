"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* An operator selects the id and text columns that it is told to use and works on private names, so
  extra columns of any name do no harm.
* A null text counts as the empty text unless the operator's docstring says otherwise.
* Intermediate tables are written below ``spark.checkpoint.dir``, which executors and driver share, so
  a lost executor costs a re-read and never a result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=(2, 4096), dtype=np.uint64) | np.uint64(1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names; a folder of our own only in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again, and its path: cuts the lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of written() that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles whose frames are gone; they'd stay until a driver's collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return memory that this worker holds but doesn't use to the system: a worker serves many tasks, and what the
    last one needed at its peak stays with it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives memory back before it begins (another stage's model or arrays may have
    been freed since its last task) and once it has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending split points of an integer column, from one sketch of bounded size."""
    found = df.select(column).approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in found})


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below value (null: 0), by binary decisions in generated code."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def pieces(batch: pa.RecordBatch, text: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` text bytes at the most, or of one row."""
    column = batch.column(batch.schema.get_field_index(text))
    at = offsets_of(column)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's values, nulls being empty; length + 1 of them, not from 0 for a slice."""
    if not isinstance(column, pa.StringArray | pa.BinaryArray):
        column = column.cast(pa.string())
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values joined, and their offsets from 0; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    at = offsets_of(column)
    data = column.buffers()[2]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and how many each text has; none spans two texts."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = solid
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.diff(np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the ascending, disjoint, nonempty runs.

    Multilinear over 4096-byte pieces, whose hashes are chained, so it depends on every byte and the length.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    long = size > 4096
    if long.any():
        out = np.zeros(len(starts), dtype=np.uint64)
        out[~long] = hash_runs(data, starts[~long], ends[~long], seed)
        for i in np.flatnonzero(long):
            s = np.arange(starts[i], ends[i], 4096)
            h = hash_runs(data, s, np.minimum(s + 4096, ends[i]), seed)
            powers = np.cumprod(np.full(len(h), 0x9E3779B97F4A7C15, dtype=np.uint64))
            out[i] = mix(np.array([np.sum(h * powers, dtype=np.uint64) + np.uint64(len(h))], dtype=np.uint64))[0]
        return out
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    take = place + np.repeat(starts, size)
    term = (data[take].astype(np.uint64) + np.uint64(1 + seed)) * _MIX[0, place]
    return mix(np.add.reduceat(term, first) + size.astype(np.uint64) * _MIX[1, 0])


def hash_windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values of h."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out += h[i : n + i] * _MIX[1, i + 1]
    return mix(out)


def ragged(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + size[i] - 1 for each i, joined."""
    if not len(size):
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(starts - first, size)


def binary_list(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array whose items are the bytes of consecutive runs of values."""
    raw = np.ascontiguousarray(values)
    at = np.concatenate([[0], np.cumsum(size)]) * raw.dtype.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def spread(docs: DataFrame, column: str, rows: int, most: int = 65_536) -> tuple[Column, int]:
    """A bucket number that never falls as an integer column rises, for buckets of about `rows` rows; how many.

    256 quantiles, each cut evenly by value; at most `most` buckets. Null values go to bucket 0.
    """
    n = min(most, max(16, docs.count() // rows))
    low, high = docs.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit(0), 1
    bounds = [x for x in range_bounds(docs, column, min(n, 256)) if low < x]
    step = -(-n // (len(bounds) + 1))
    value, part = F.col(column), bucket_of(F.col(column), bounds)
    if step == 1:
        return part, len(bounds) + 1
    edges = [low, *bounds, high + 1]
    at = F.array(*[F.lit(x).cast("long") for x in edges])
    start, end = F.get(at, part), F.get(at, part + 1)
    inside = F.floor((value - start).cast("double") / (end - start) * step)
    return F.coalesce(part * step + F.least(F.greatest(inside, F.lit(0)), F.lit(step - 1)), F.lit(0)).cast("long"), (len(bounds) + 1) * step


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(ord, doc_id, text) with ord a unique long that ascends with (doc_id, text), nulls first; null text: ''.

    With carry, also `row`, a struct of all columns. Where ids are unique and not null, ord is the id and
    nothing moves; otherwise the rows are numbered by ranges and written once.
    """
    rest = [F.struct(*[docs[x] for x in docs.columns]).alias("row")] if carry else []
    names = ["ord", "doc_id", "text", *["row"] * carry]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    ids = plain.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if ids[0] in (None, 1) and not ids[1]:
        return plain.withColumn("ord", F.col("doc_id")).select(*names)
    from pyspark.sql.window import Window

    part, _ = spread(plain, "doc_id", 1000)
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text"))
    numbered = plain.withColumn("part", part.cast("long")).withColumn("ord", F.shiftleft("part", 32) + place)
    return written(numbered.select(*names), "keyed")[0]
