"""Tables written once to the folder that all nodes of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a new folder of its own; on a cluster that
    is an error, since no node would see another one's folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables written inside, for ``removed`` once nothing reads them any more."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: later plans start there.

    A lost executor then costs a reread, and what a plan assigns (row numbers, say) is the
    same for every reader.  The files go when the session ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    files, p = _path(spark, path)
    files.deleteOnExit(p)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written table that no returned plan reads any more."""
    removed(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete written tables by their paths; those that are gone already are left alone."""
    for path in paths:
        files, p = _path(spark, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
