"""Small files that commit something: written aside, made durable, renamed to a name that is new."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from ..errors import ConflictError

ASIDE = ".tmp-"


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, path = at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, text: str) -> None:
    """Make a new file appear whole or not at all. Nothing is replaced: a name that is taken is a conflict."""
    folder, _, name = path.rpartition("/")
    fs, target = at(spark, path)
    _, aside = at(spark, f"{folder}/{ASIDE}{name}-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise ConflictError(f"{path} was committed by another writer")


def size_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Data files and their bytes below a path."""
    fs, target = at(spark, path)
    if not fs.exists(target):
        return 0, 0
    found, files, size = fs.listFiles(target, True), 0, 0
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")):
            files, size = files + 1, size + status.getLen()
    return files, size


def sweep(spark: SparkSession, folder: str, older_than_s: float = 3600.0) -> list[str]:
    """Delete what interrupted commits left aside in a folder, once it is old enough to be no one's; returns the names."""
    fs, path = at(spark, folder)
    limit, gone = (time.time() - older_than_s) * 1000, []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if name.startswith(ASIDE) and status.getModificationTime() <= limit:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = at(spark, path)
    fs.delete(target, True)
