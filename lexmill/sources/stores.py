"""Files as workers reach them: local ones, HDFS and object stores, through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

from lexmill.session import files_of


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session resolves it."""
    where, files = files_of(spark, path)
    return files.makeQualified(where).toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme (or a local path), and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme == "s3a" else path)


def read_range(path: str, begin: int, n: int) -> bytes:
    """At most n bytes of a file from `begin`; no others are read."""
    store, where = opened(path)
    with store.open_input_file(where) as f:
        return f.read_at(min(n, max(0, f.size() - begin)), begin)


def write_file(path: str, data: bytes) -> None:
    store, where = opened(path)
    with store.open_output_stream(where) as f:
        f.write(data)
