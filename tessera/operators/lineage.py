"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on one machine, as in tests, a temporary folder will do where it is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: it is computed once, and a lost executor costs little."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is; nothing happens if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, which are counted; larger ones are joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of a task, about, where they are dealt by their number, and the most partitions: so many are written without holding them in memory first.
TASK_ROWS, MOST_PARTITIONS = 250_000, 200


def dealt(df: DataFrame, *key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` to as many partitions as ``rows`` need, its own if not given, which are counted.

    Left to itself Spark makes partitions of equal compressed size, which hold many millions of rows
    where columns repeat, and a task that sorts them or keeps their keys holds them uncompressed.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(min(MOST_PARTITIONS, max(1, -(-rows // TASK_ROWS))), *key)
