"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; only in local mode may it be the warehouse."""
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (own.get() if own.isDefined() else None)
    if found:
        return found.rstrip("/")
    if context.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and its lineage cut where executors may be lost."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many tasks long work on few bytes is dealt to: one to four a core, in favour of the session's shuffles."""
    cores = spark.sparkContext.defaultParallelism
    return max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if ``df`` has a column of it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


