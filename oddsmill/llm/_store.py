"""Tables and arrays written to the folder that all machines share, to cut lineage where a plan is used again and to share models."""

from __future__ import annotations

import ctypes
import mmap
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application inside ``spark.checkpoint.dir``; its tables can be removed when the application has ended."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a lost executor then costs no more than reading it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what work of this process has freed; Python workers serve stage after stage, and the allocator keeps freed arrays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


#: Rows and bytes of an Arrow batch between Spark and Python; Spark's own bound of 10,000 rows can be hundreds of MB of long texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS and BATCH_BYTES where it is larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of those taken."""
    out = []
    for name in names:
        while name in taken or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def write_array(folder: str, name: str, a: np.ndarray) -> None:
    """One file of the shared folder; a task that runs again replaces it by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
    fs.move(part, f"{path}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """The array in the file, mapped into memory."""
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    if not isinstance(fs, pafs.LocalFileSystem):
        held, local = tempfile.mkstemp()
        with fs.open_input_stream(path) as source, os.fdopen(held, "wb") as out:
            while data := source.read(1 << 24):
                out.write(data)
        path = local
    if not os.path.getsize(path):
        return np.zeros(0, dtype)
    with open(path, "rb") as file:
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    if not isinstance(fs, pafs.LocalFileSystem):
        os.unlink(path)
    return np.frombuffer(view, dtype)
