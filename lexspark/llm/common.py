"""What the training-data operators share: the shared folder, materialised tables, unique row keys
and views of Arrow string columns as NumPy bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset (tests, one machine) a temporary folder takes its place.
    """
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lexspark-")
        spark.conf.set(CHECKPOINT, found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    # With its scheme: Python workers open it in the same store as Spark does.
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lexspark-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The write's shuffle files go as soon as it ends (in releases that have the setting).
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows (and so the bytes) that one Arrow batch brings to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception:  # noqa: BLE001  older releases have no such setting
        return


def keyed(docs: DataFrame, columns: list[str] | None = None, key: str = "row_key") -> DataFrame:
    """``docs`` with a long ``key`` that is unique and ascends with doc_id.

    Where every id is present once, the key is the id and nothing moves. Otherwise rows are
    range-partitioned by id (nulls first), ordered by text among equal ids, numbered and written.
    ``columns``: those to keep (doc_id and text are always kept).
    """
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *columns])) if columns is not None else docs
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    if not rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return rows.withColumn(key, F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return materialize(ordered.withColumn(key, F.monotonically_increasing_id()), "rows")


_KEPT: dict[object, object] = {}


def kept(name: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task of one kind.

    Workers outlive a stage. The first task of another kind lets go of what the ones before have
    kept, and gives the memory back, so a worker never holds the caches of two operators.
    """
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _KEPT[name] = make()
    return _KEPT[name]


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches with about ``limit`` bytes of text each; one longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. as one index array."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
