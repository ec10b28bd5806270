"""Helpers that keep wide operations bounded per task: checkpoints, distributed ranks and distinct rows."""

from __future__ import annotations

import atexit
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Up to so many rows per group Spark may cut a ranking before its rows are moved; production pools are 3,000.
GROUP_LIMIT = 5000


def prepare(spark: SparkSession) -> None:
    """Lets Spark cut rankings of up to GROUP_LIMIT rows per group before the shuffle, as it does for short ones."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if 0 <= int(spark.conf.get(key, "1000")) < GROUP_LIMIT:
        spark.conf.set(key, str(GROUP_LIMIT))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; only where none is set, and only on a local master
    (tests), an own one beside the working folder, which is removed at the end."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not jsc.getCheckpointDir().isDefined():
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            here = os.getcwd() if os.access(os.getcwd(), os.W_OK) else os.path.expanduser("~")
            named = os.path.join(here, "spark-warehouse", f"cut-{spark.sparkContext.applicationId}")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see one fixed copy in the shared folder. Set spark.cleaner.referenceTracking.
    cleanCheckpoints, so that Spark removes it when the plan that reads it is gone."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_group_offsets(df: DataFrame, group: list[str], order: list[Column], weight: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same group that come earlier in `order`.

    The rows are range-partitioned over (group, order), so a group of any size is spread over many tasks; each task
    sums locally and adds the total of the earlier ranges of its group. `order` must be a total order inside a group.
    """
    spark = df.sparkSession
    cols = [F.col(g) for g in group]
    parts = shuffle_parts(spark)
    placed = cut(df.repartitionByRange(parts, *cols, *order).withColumn("__pid", F.spark_partition_id()))
    w_pid = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (placed.groupBy(*group, "__pid").agg(F.sum(weight).alias("__tot"))
            .withColumn("__off", F.coalesce(F.sum("__tot").over(w_pid), F.lit(0))).drop("__tot"))
    w_loc = Window.partitionBy(*group, "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(offs, [*group, "__pid"])
            .withColumn(out, F.coalesce(F.sum(weight).over(w_loc), F.lit(0)) + F.col("__off"))
            .drop("__pid", "__off"))
