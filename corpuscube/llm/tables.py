"""Cutting lineage through a written table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and driver and
    executors are one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpuscube-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back: later jobs survive the loss of any executor
    without running its plan again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables this application has stored: what clear() goes back to."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def clear(spark: SparkSession, since: int = 0, last: bool = True) -> None:
    """Delete the tables that this application has stored since a mark, all if there is none;
    the last one too, unless told otherwise.  Call it once the results that read them are
    written."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - (not last)]
    _delete(spark, gone)
    paths[since:] = paths[since + len(gone) :]


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle that grows with the input is dealt into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
