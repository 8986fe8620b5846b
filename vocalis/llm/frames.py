"""Small DataFrame helpers of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where none is set, a local session (driver and executors on one machine) gets a folder of its own; on a cluster that raises.
    """
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vocalis-checkpoint-"))
        folder = sc._jsc.sc().getCheckpointDir()
    return folder.get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Frames that are made and run inside delete their shuffle files when they have run; else those stay until the driver happens
    to collect its garbage. For frames that are run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_open: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder. Inside scratch(), the checkpoint goes when that ends.

    The shuffle files behind it go at once.
    """
    shared_folder(df.sparkSession)
    with tidied(df.sparkSession):
        out = df.select("*").checkpoint()
    if _open:
        plan = out._jdf.queryExecution().logical()
        _open[-1].append(plan.rdd().getCheckpointFile().get())
    return out


def stored(df: DataFrame) -> DataFrame:
    """As saved(), but as Parquet: sorted rows pack small there, and a reader takes only the columns that it uses."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.select("*").write.parquet(folder)
    if _open:
        _open[-1].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints that are made inside, at its end: for work whose result is written by then."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            remove_folder(spark, folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
