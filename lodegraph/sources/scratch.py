"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import graph

_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: lineage ends there, and a lost executor loses nothing.

    Unlike a checkpoint, the table has none of the constraints of the plan that made it, which grow with every round of
    an iteration. Tables are removed when the process ends.
    """
    path = f"{graph.shared_folder(df.sparkSession)}/lodegraph/scratch-{uuid.uuid4().hex}"
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is None:
                return
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may have ended already
            return
