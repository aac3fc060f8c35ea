"""Shared helpers of the training-data operators: the shared folder, written tables and joins that survive hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as ship  # noqa: PLC0414  operators take it from here

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"
#: Word separators: space and the ASCII controls from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all run on this machine, one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="codeperil-")
    return _own_folder[app]


_made: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for `name` in the shared folder."""
    path = f"{shared_folder(spark)}/codeperil/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The paths that this application has got from shared_path and not removed, in order."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete what lies at paths of shared_path; for tables whose results have been written or read."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _made[spark.sparkContext.applicationId].remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it again, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this Python worker has freed to the machine; an idle worker would keep it while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


#: The least number of hot keys that a join allows for.
HOT_KEYS = 1000


def hot_aware_join(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str, spread: Column) -> DataFrame:
    """Left-join `left` with `right` (one row per key) when some keys may hold a large part of the rows of `left`.

    `rows` names the column of `right` with the number of rows that the key has on the left; `right` is read three
    times, so it should be a written table. A key is hot if it has more than half of a shuffle partition's share of the
    sum of `rows` (or than the HOT_KEYS-th part, if that is less), so at most two keys for each partition are hot, and
    only these are broadcast. The other keys join by shuffle. `spread` is an integer hash of a row of `left`; rows that
    met a hot key or have a null key are dealt by it, so no task gets a hot key's rows.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = total / max(HOT_KEYS, 2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(rows) > limit).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    cold = right.where(F.col(rows) <= limit).select(*keys, *[F.col(c).alias(f"__cold_{c}") for c in values], F.lit(0).alias("__salt"))
    met = left.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.when(F.col("__hot") | _any_null(keys), F.pmod(spread, F.lit(1 << 20)).cast("int") + 1).otherwise(F.lit(0)))
    out = met.join(cold, [*keys, "__salt"], "left")
    kept = [c for c in left.columns if c not in values]
    return out.select(*kept, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])


def _any_null(keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for key in keys:
        out = out | F.col(key).isNull()
    return out
