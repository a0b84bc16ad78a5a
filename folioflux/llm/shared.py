"""Files in the folder that driver and executors share (folioflux.operators.kept has its tables), small settings, and memory of workers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import SparkSession

from folioflux.operators.files import read_file, write_file
from folioflux.operators.kept import keep, new_folder, shared_dir

__all__ = ["bound_batches", "delete_files", "keep", "lean", "local_path", "new_folder", "read_file", "release", "released", "shared_dir", "write_file"]


def bound_batches(spark: SparkSession) -> None:
    """Memory outside the heap stays small from here on, where the session doesn't say otherwise.

    Arrow batches have at most 16 MB instead of 64, as a batch of texts is in memory several times; and Parquet isn't read by vectored
    reads, whose direct buffers stay with every thread that has read (of 800 MB of texts they kept 120 MB in them and let an executor
    grow by 500 MB).
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(16 << 20))
    name = "parquet.hadoop.vectored.io.enabled"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "false")


@functools.cache
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; elsewhere nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives memory that this process has freed, but its allocators hold, back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator) -> Iterator:
    """The batches; when another is asked for, what the one before has left is released."""
    for batch in batches:
        yield batch
        del batch
        release()


def lean(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which releases memory after each batch and at its end.

    Workers outlive their tasks and run other operators' tasks after them; without this each keeps the most that any of them took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(released(batches))
        release()

    return run


def delete_files(spark: SparkSession, uris: list[str]) -> None:
    """Deletes what no task needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for uri in uris:
        path(uri).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(uri), False)


_COPIES: dict[str, str] = {}


def local_path(uri: str) -> str:
    """A path to memory-map: the shared file itself, or where the store isn't a file system a copy that lives as long as this worker."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return at.path
    if uri not in _COPIES:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        folder = tempfile.mkdtemp(prefix="folioflux-copy-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        fs.copy_files(path, f"{folder}/file", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        _COPIES[uri] = f"{folder}/file"
    return _COPIES[uri]
