"""Tables that several steps read are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, ...], str] = {}
_LOCAL: list[str] = []
_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _LOCAL[0]
    return folder.rstrip("/")


def _new(spark: SparkSession, name: str) -> str:
    _PATHS.append(f"{shared_folder(spark)}/veilwork-{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def remove_written(spark: SparkSession) -> int:
    """Remove the tables that this process has written so far and say how many: for when the results that read them have been written."""
    n = len(_PATHS)
    while _PATHS:
        at = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder: what was not determined, such as sampled ranges, is fixed by it."""
    path = _new(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, as a table that is written once for each application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = _new(spark, name)
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
