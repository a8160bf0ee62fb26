"""Small text files through Hadoop's file systems, so that a path means the same to the driver and to executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def _place(path: str) -> Iterator[tuple]:
    """(file system, path); checksums of local files aren't kept, as such files may be edited by hand."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("files are read and written through a session")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    place = hadoop.fs.Path(str(path))
    default = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.fs.FileSystem.newInstance(place.getFileSystem(default).makeQualified(place).toUri(), default)
    files.setVerifyChecksum(False)
    files.setWriteChecksum(False)
    try:
        yield files, place
    finally:
        files.close()


def file_exists(path: str) -> bool:
    with _place(path) as (files, place):
        return files.exists(place)


def read_text(path: str) -> str:
    with _place(path) as (files, place):
        stream = files.open(place)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()


def write_text(path: str, text: str) -> None:
    """Replaces what is there; folders above it are made."""
    with _place(path) as (files, place):
        stream = files.create(place, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
