"""Path operations on whatever file system a path lives on, through Hadoop's client."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANY = 32  # files, from which on listing them one by one is avoided


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    size: int
    is_file: bool


def _open(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute form with scheme, for comparing paths."""
    return _open(spark, path)[1].toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def entries(spark: SparkSession, directory: str) -> list[Entry]:
    """What lies directly in a directory, including zero-byte files that no Spark scan reports."""
    fs, p = _open(spark, directory)
    found = ((s.getPath().toString(), s) for s in fs.listStatus(p))
    return [Entry(path.rpartition("/")[2], path, s.getLen(), s.isFile()) for path, s in found]


def make_directory(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.mkdirs(p)


def create_file(spark: SparkSession, path: str, content: bytes) -> bool:
    """A new small file; false if one of that name is there already, which then stays as it is."""
    fs, p = _open(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return True


def read_file(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def chunks(spark: SparkSession, path: str, first: int) -> Iterator[bytes]:
    """The content of a file from its start, as far as it is asked for, in ever larger pieces."""
    fs, p = _open(spark, path)
    io = spark.sparkContext._jvm.org.apache.commons.io
    stream, size = fs.open(p), first
    try:
        while found := bytes(io.IOUtils.toByteArray(io.input.BoundedInputStream(stream, size))):
            yield found
            size = min(2 * size, 64 * first)
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _open(spark, source)
    if not fs.rename(p, _open(spark, target)[1]):
        raise OSError(f"cannot move {source} to {target}")


def literal(path: str) -> str:
    """Escape glob characters, as Spark readers treat every path as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_files(reader: Callable[..., DataFrame], paths: list[str], name_glob: str) -> DataFrame:
    """Read exactly these files of one folder.

    ``reader(path, **options)`` loads one path or a list.  Many files are loaded through
    their folder when that selects the very same files: a listing call per file would
    otherwise outlast the scan of a folder of many small lists.
    """
    folders = {p.rpartition("/")[0] for p in paths}
    if len(paths) > MANY and len(folders) == 1:
        by_folder = reader(literal(folders.pop()), pathGlobFilter=name_glob)
        if sorted(unquote(f.rpartition("/")[2]) for f in by_folder.inputFiles()) == sorted(
                p.rpartition("/")[2] for p in paths):
            return by_folder
    return reader([literal(p) for p in paths])
