"""Small file operations on any Hadoop file system, by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of what is in a folder, folders with -1; nothing if there is no such folder."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted((s.getPath().getName(), -1 if s.isDirectory() else s.getLen()) for s in fs.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that appears whole or not at all; one that is there already is an error."""
    fs, where = _at(spark, path)
    draft = where.suffix(".draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(where) or not fs.rename(draft, where):
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
