"""What the training-data operators share: the shared folder, table access, batches and buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of more bytes are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch while a table is written: a task holds one in the JVM's native memory and one in Python.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset the warehouse, if that can be shared: on a cluster it mustn't be a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/veriloom"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES at most for what runs inside the block; afterwards the session has its own bound again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors. It stays there. Written in small Arrow batches."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A function like ``written`` whose tables are deleted at the end of the block, by when what is made of them must be written."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, label: written(df, label, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def few(df: DataFrame, row_bytes: int) -> DataFrame:
    """df to be broadcast if its rows of this size at most hold BROADCAST_BYTES at most, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def measured_few(df: DataFrame) -> DataFrame:
    """df to be broadcast if its rows, their texts measured, hold BROADCAST_BYTES at most, else as it is."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    held = df.agg(F.sum(sum(texts, F.lit(16 * len(df.columns))).cast("long"))).head()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow; Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch; ``written`` lowers it), and text_batches cuts it further."""
    return df.mapInArrow(run, schema)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's bytes stay near a bound; a longer text has a batch of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()), np.int64, n)
        ends, start, held = np.cumsum(sizes), 0, 0
        while start < n:
            stop = int(np.searchsorted(ends, held + most_bytes, side="right"))
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            held, start = int(ends[stop - 1]), stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def joined(blobs: list[bytes], pad: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blobs in one byte array, pad before each and after the last, with their starts and ends."""
    lengths = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
    starts = np.cumsum(lengths + len(pad)) - lengths
    data = np.frombuffer(pad + pad.join(blobs) + pad, np.uint8)
    return data, starts, starts + lengths


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for ascending ranges that don't overlap; empty ranges give 0."""
    if not len(starts):
        return np.zeros(0)
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    total = np.add.reduceat(np.append(values, 0), bounds, dtype=np.float64 if values.dtype.kind == "f" else np.int64)[0::2]
    return np.where(ends > starts, total, 0)


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from columns by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)
