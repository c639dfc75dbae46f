"""Intermediate tables in the folder that driver and executors share, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it has more than this share of all rows, so there are fewer than so many heavy keys.
HEAVY_KEYS = 400


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; removed when the driver's JVM ends.

    Only a session on one machine (master ``local``) may lack that setting: a temporary folder then takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="defectflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, name: str, free: bool = True, **totals: Column) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the lineage ends there, and a lost executor costs only its own tasks.

    ``totals`` are aggregates of the same pass (``out.totals``). ``free``: a garbage collection afterwards, which lets Spark delete the shuffle files that only the finished job needed."""
    spark = df.sparkSession
    path, schema = shared_dir(spark, name), df.schema
    seen = Observation() if totals else None
    if seen:
        df = df.observe(seen, *(c.alias(k) for k, c in totals.items()))
    df.write.parquet(path)
    del df
    if free:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.folder, out.totals = path, dict(seen.get) if seen else {}
    if totals.keys() - out.totals.keys():  # not reported, as for an empty plan
        out.totals = out.agg(*(c.alias(k) for k, c in totals.items())).first().asDict()
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing reads any more."""
    for df in frames:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.folder)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Heavy keys have over ``total / HEAVY_KEYS`` rows, so they are fewer than ``HEAVY_KEYS``: their rows of ``table`` go to every task. All other keys are shuffled, at most a
    four-hundredth of the rows to one task, without Spark's own choice of a broadcast. Both inputs should be written tables, as they are read twice."""
    heavy = F.col(count) > total / HEAVY_KEYS
    few = table.where(heavy)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(table.where(~heavy).hint("merge"), key)
    return light.unionByName(rows.join(F.broadcast(few), key)).drop(count)


def equal_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the columns ``keys`` of two frames."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out
