"""Shared helpers: input columns, Arrow batches, the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write the frame as Parquet in the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder in the shared store; local for plain and file: paths."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The whole text, '' for null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1]
    return memoryview(data) if data is not None else memoryview(b""), offs


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """Each row's UTF-8 bytes, without decoding."""
    data, offs = buffers(column)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield bytes(data[a:b])


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit mixer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_path(*parts: str) -> str:
    return os.path.join(*parts)
