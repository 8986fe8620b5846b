"""Small files through Hadoop's file systems, so that any path works that Spark reads. Nothing here is for data."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

MOST_BYTES = 200_000


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str, most: int = MOST_BYTES) -> str:
    """A whole file of at most so many bytes; a larger one raises."""
    fs, where = _at(spark, path)
    size = fs.getFileStatus(where).getLen()
    if size > most:
        raise ValueError(f"{path} has {size} bytes, more than {most}")
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file at once: a reader sees the old text or the new, never a part."""
    fs, where = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(where), options)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that mustn't exist yet: of several writers of one path exactly one gets True, and the file is never partial."""
    fs, where = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(where), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if fs.exists(where):
            return False
        raise e
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it doesn't exist. For folders that hold few."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="vocalis-"))
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get()
