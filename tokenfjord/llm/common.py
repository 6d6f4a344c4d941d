"""Shared-folder tables, row keys and Arrow helpers used by all operators here."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def own_folder(spark: SparkSession) -> str:
    """The folder below the shared one that holds this application's tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has written between its stages.

    To be called when the results have been saved elsewhere: results are read
    from these tables, and op4's files are among them unless a path was given.
    """
    remove(spark, own_folder(spark))


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table of the shared folder, and the table's path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most a reread.
    """
    return written(df, name, **options)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that shuffles and plans that nothing refers to go now, and their disk and memory."""
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """64-bit key of a documents row; with doc_id it tells different rows apart.

    Maps count by their entries in order of the keys; columns with maps inside
    by their JSON.
    """

    def hashable(c: str, kind: str) -> Column:
        column = F.col(f"`{c}`")
        if "map<" not in kind:
            return column
        return F.array_sort(F.map_entries(column)) if kind.rindex("map<") == 0 else F.to_json(F.struct(column))

    return F.xxhash64(*[hashable(c, t) for c, t in df.dtypes])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_bytes`` of text or one row."""
    for batch in batches:
        at, size = 0, batch.column(text).nbytes
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(size, 1)))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step
    give_back()


def give_back() -> None:
    """Return free memory to the system, as workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
