"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders of sessions that run in one process and name no folder of their own; removed when the process ends.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Where it is unset, a session whose driver and executors are one process
    (local mode, as in tests) gets a temporary folder. A cluster must name one:
    a folder of one machine would be out of reach for the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(sc.applicationId, tempfile.TemporaryDirectory(prefix="glossa-")).name


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Write the rows as a table in the scratch folder and go on from there.

    They are computed once, survive executor loss, and come back with real
    sizes for the optimizer and without the plan they were made by. The path is
    noted in ``made``, for ``drop`` to remove it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that ``cut`` has written, wherever the scratch folder is."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()
