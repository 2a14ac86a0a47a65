"""Written intermediate tables: lineage ends in a folder that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by this driver, for clear().
_MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            top = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            top = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
        else:
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they all share")
    _MADE.append(f"{top.rstrip('/')}/quire-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that a lost executor costs only the tasks it ran."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, what: str, make) -> str:
    """The folder of something that make(folder) writes, once for each application."""
    key = (spark.sparkContext.applicationId, what)
    if key not in _KEPT:
        path = scratch(spark)
        make(path)
        _KEPT[key] = path
    return _KEPT[key]


def clear(spark: SparkSession) -> None:
    """Remove the folders made so far. Results that are still to be read from them are lost: call it when they are saved."""
    _KEPT.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        at = path(_MADE.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
