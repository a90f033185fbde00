"""Shared pieces: tables, the shared folder, salting, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Salts for joins whose left side may have one key in a third of all rows: as many as the application's cores when they are first
#: asked for, within these bounds. The number is kept, so that both sides of a join always agree.
FEWEST_SALTS, MOST_SALTS = 16, 1024
_salts: dict[str, int] = {}
#: Rows of a few numbers that are broadcast at most, as counted. The driver holds each such table twice, hashed and in blocks, and
#: frees it only when it collects garbage; a hashed row takes 80 to 160 bytes.
BROADCAST_ROWS = 30_000
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 21


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB at most, or one row, whatever the texts' length; for the session, as plans are made late."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def released(emit: Callable) -> Callable:
    """emit for mapInArrow, after which the process gives freed memory back: Python workers serve many tasks, and what one of them
    held once would stay with it beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from emit(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, and an
    error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larkgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, narrow: bool = False, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost nothing that is done.

    narrow: rows of a few numbers, which an eighth of the shuffle's partitions (eight at least) hold well.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = new_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs within it are deleted when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def salts() -> int:
    context = SparkSession.active().sparkContext
    return _salts.setdefault(context.applicationId, min(MOST_SALTS, max(FEWEST_SALTS, context.defaultParallelism)))


def salt_of(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts())).cast("int")


def all_salts(name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(salts() - 1))).alias(name)


def shared_array(spark: SparkSession, values: np.ndarray):
    """A broadcast of a small array of numbers or strings."""
    return spark.sparkContext.broadcast(values)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(kind) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit set of fixed size: bit h mod bits is set for every long h. Executors make it in maps of 32 768 bits, which reach the
    driver as bytes: bits / 8 in all, whatever the number of hashes."""
    at = F.pmod(column, F.lit(bits)) + 1  # these functions count from 1
    maps = hashes.groupBy(F.bitmap_bucket_number(at).alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    out = np.zeros(max(bits, 1 << 15) // 8, np.uint8)
    for nth, part in maps.toLocalIterator():
        out[(nth - 1) * 4096 : nth * 4096] = np.frombuffer(part, np.uint8)
    return out[: bits // 8].view("<u4")


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the uint64 hashes whose bit is set."""
    bit = hashes & np.uint64(len(table) * 32 - 1)
    return np.flatnonzero((table[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1))


def row_groups(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """A written table, marked for broadcast if its rows, counted, and its files' bytes are few enough; the same join without the mark otherwise."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes and df.count() <= most_rows else df


def drop_ids(docs: DataFrame, gone: DataFrame, column: str, most_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose doc_id isn't in the column of gone. A list of counted size is broadcast; beyond, both are shuffled."""
    gone = materialize(gone.select(F.col(column).alias("__gone")).where("__gone is not null").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, most_rows), F.col("doc_id") == F.col("__gone"), "left_anti")
