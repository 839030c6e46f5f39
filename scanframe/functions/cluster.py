"""Shared folder handling: where intermediate tables go so that lost executors do not matter."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # one process with its own disk
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="scanframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def own_folder(spark: SparkSession) -> str:
    """Where this application writes everything intermediate; ``release`` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/scanframe-{spark.sparkContext.applicationId}"


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """A table that several queries of this application start from, written once and forgotten by ``release``."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = materialize(make())
    return _KEPT[key]


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results built on them end with it."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, survives executor loss, keeps column pruning and gives the optimizer the
    real size. Names are unique, so concurrent jobs never touch each other's tables.
    """
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize`` plus the number of rows, taken from the same write."""
    spark = df.sparkSession
    target = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
    return spark.read.schema(df.schema).parquet(target), seen.get["rows"]
