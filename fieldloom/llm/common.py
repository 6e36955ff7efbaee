"""Shared helpers: the cluster's shared folder, lineage cuts, size-checked broadcasts, byte arrays of Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import platform
import re
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with a few longs a row is broadcast (about 50 MB); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 48 << 20
#: Bytes of text that one numpy step takes; a longer text is a step of its own.
CHUNK_BYTES = 1 << 19

_BATCH_ROWS = 4000
_own_folder: list[str] = []
_made: list[str] = []
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and platform.libc_ver()[0] == "glibc" else None
if _libc is not None:
    _libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped, so that they go back to the system when freed


def release() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(task):
    """A function of Arrow batches whose worker, when it ends, gives free memory back: idle workers stay small."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def bounded_batches(spark: SparkSession, rows: int = _BATCH_ROWS) -> None:
    """Arrow batches of whole texts of at most rows rows in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if all of
    Spark runs in this one process (as in tests), else an error: a cluster's machines would each write their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="fieldloom-"))
        atexit.register(shutil.rmtree, _own_folder[0].removeprefix("file://"), ignore_errors=True)
    return _own_folder[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialize() has written and not deleted: a mark for delete_written()."""
    return len(_made)


def delete_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that materialize() has written since a mark, but for the last keep ones. For callers that have
    written out all results that read them."""
    gone = _made[since : len(_made) - keep]
    del _made[since : len(_made) - keep]
    for path in gone:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def meet(rows: DataFrame, side: DataFrame, keys: list[str], size: str, hot: int = 256) -> DataFrame:
    """Inner join of rows with a side of one row a key. size: the side's column with the number of rows that meet it, which
    is dropped. Rows of a key that more than hot rows share join by broadcast, so that no task gets all of them; such keys
    are counted first, and shuffle only where they are too many for a broadcast."""
    many = side.where(F.col(size) > hot)
    crowd = broadcast_if_small(many.select(*keys))
    few = rows.join(crowd, keys, "left_anti").join(side.where(F.col(size) <= hot).drop(size), keys)
    return few.unionByName(rows.join(broadcast_if_small(many.drop(size)), keys))


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of slim rows only where their number is known to be at most limit; otherwise the join shuffles."""
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if wide else np.int32
    buffer = column.buffers()[1]
    if buffer is None or not buffer.size:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffer, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges (lo, hi) of texts with at most limit bytes together, or one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def longs(column, null: int) -> np.ndarray:
    """An integer Arrow array as int64 with nulls replaced."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def rows_batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def groups(batches, keys: list[str]):
    """Of batches sorted by keys, tables that hold whole groups only: many small groups together, a large one alone.

    Rows of the last, maybe unfinished group wait for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        same = np.ones(table.num_rows, bool)
        last_key = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        for k, v in zip(keys, last_key, strict=True):
            same &= table.column(k).combine_chunks().to_numpy(zero_copy_only=False) == v
        cut = int(np.argmax(same))  # where the last group of this batch begins
        if cut == 0 and (not held or [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys] == last_key):
            held.append(table)
            continue
        if cut:
            held.append(table.slice(0, cut))
        if held:
            yield pa.concat_tables(held).combine_chunks()
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()
