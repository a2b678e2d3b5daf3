"""Sessions, small sides of joins, and workers that can import this package."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "corpuscube", master: str = "local[8]", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library expects."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def near(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for the small side of a join: computed once and broadcast if it has at most `most`
    rows, else as it is, so that the join shuffles."""
    rows = df.limit(most + 1).toArrow()
    return df if rows.num_rows > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name where driver and executors both reach: under spark.checkpoint.dir; one
    of our own only where that is unset and they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpuscube-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reach(spark: SparkSession) -> None:
    """Python workers find this package where they share the driver's file system."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def reaching(query: Callable) -> Callable:
    """A query, (spark, ...) -> DataFrame, whose workers find this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest, **named):
        reach(spark)
        return query(spark, *rest, **named)

    return run
