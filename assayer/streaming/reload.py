"""A configuration document that changes while a stream runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources import tables

LOG = "version long, value string"


def sound(text: str | None) -> bool:
    """Whether the text is a JSON array of objects."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return False
    return isinstance(found, list) and all(isinstance(x, dict) for x in found)


def rows_of(spark: SparkSession, text: str | None, schema: str) -> DataFrame:
    given = spark.createDataFrame([(text or "[]",)], "value string")
    return given.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def reloading(stream: DataFrame, read: Callable[[SparkSession], str | None], log: str, schema: str, key: str, use: Callable[[DataFrame, DataFrame, DataFrame, int], None], checkpoint: str) -> Any:
    """Starts ``stream``; each micro-batch reads the document again and runs ``use(batch, rows, gone, number)``: the rows in force
    (``schema``, columns as ``name: type``) and the keys that went with this batch.

    A document that is missing or broken leaves the last sound one in force; that is kept in the table ``log``, a row for each version, so a
    restarted or repeated batch sees what the first run saw.  The document is one small text.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = tables.open_table(spark, log, LOG).where(F.col("version") <= number)
        held = known.groupBy().agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version")).first()
        before, now = held["value"], held["value"]
        if held["version"] == number:
            # This batch is run again: the version before it is what it replaced.
            before = (known.where(F.col("version") < number).agg(F.max_by("value", "version")).first() or [None])[0]
        else:
            text = read(spark)
            if sound(text) and text != before:
                now = text
                tables.append(spark.createDataFrame([(number, text)], LOG), log)
        rows = rows_of(spark, now, schema)
        use(batch, rows, rows_of(spark, before, schema).join(rows, key, "left_anti").select(key), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append").start()
