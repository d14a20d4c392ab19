"""Small atomic files beside a table, through Hadoop's file system, so any store Spark reads will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._" or n == "_SUCCESS")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a whole file under ``path``, once: False if it was there already, and then it stays as it was.

    The text is written under a name of its own first, so writers of the same path
    don't touch each other's, and readers see all of it or nothing. On local disks, where a
    rename replaces, the name is given by a hard link, which fails if the name is taken; elsewhere by
    the file system's rename, which must refuse taken names, as HDFS does. Stores whose
    rename is no single step give no such promise.
    """
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    jvm = spark.sparkContext._jvm
    fs.mkdirs(p.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            try:
                jvm.java.nio.file.Files.createLink(_local(jvm, p), _local(jvm, tmp))
                return True
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    return False
                raise
        return bool(fs.rename(tmp, p))
    finally:
        fs.delete(tmp, False)


def _local(jvm, path):
    return jvm.java.io.File(path.toUri().getPath()).toPath()


def modified(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the entries of a folder and when each was last changed, in epoch milliseconds."""
    fs, p = _fs(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
