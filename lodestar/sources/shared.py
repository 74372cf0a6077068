"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one gets a folder of this machine; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc._jsc.sc().getCheckpointDir().isEmpty():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, so a lost executor
    costs no recomputation, and several readers cost no second run."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_recording, "lists", []):
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_recording = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that takes the paths of the tables this thread stores meanwhile."""
    paths: list[str] = []
    _recording.lists = [*getattr(_recording, "lists", []), paths]
    try:
        yield paths
    finally:
        _recording.lists = [x for x in _recording.lists if x is not paths]


def drop_tables(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Removes those stored tables, but for the ones that reader's plan reads; tables that are gone already are passed over."""
    if not paths:
        return
    read = {part for f in (reader.inputFiles() if reader is not None else ()) for part in f.split("/")}
    for path in paths:
        if path.rsplit("/", 1)[1] not in read:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestar/{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Removes all stored tables of this application; results that read them must have been written before."""
    _delete(spark, _own_dir(spark))


#: Bytes of files up to which a table counts as small.
SMALL_BYTES = 1 << 30


def spread(table: DataFrame) -> DataFrame:
    """A table as read, for work that costs much time a row. One of fewer files than cores, and small, is dealt over all cores, as a file may
    be one row group, which one task reads; a large one is never moved."""
    spark = table.sparkSession
    files, cores = table.inputFiles(), spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return table
    size = spark.read.format("binaryFile").load(list(files)).agg({"length": "sum"}).first()[0]
    return table.repartition(cores) if size <= SMALL_BYTES else table
