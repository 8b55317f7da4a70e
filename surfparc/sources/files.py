"""Small files through the file system Spark itself uses for a path."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, where = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _place(spark, path)
    data = fs.open(where)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet; False if someone has made it before."""
    fs, where = _place(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file; missing folders are made."""
    fs, where = _place(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
