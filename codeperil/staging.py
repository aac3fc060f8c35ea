"""Tables written between the steps of an operator, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all run on this machine, a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="codeperil-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/codeperil-steps/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet and read again: made once, whoever reads it, and still there when an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> list[str]:
    """The paths of this application that have not been released."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession) -> None:
    """Delete all that this application has staged; call it when no result that was made from it is read any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
