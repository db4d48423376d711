"""Stored tables: Parquet with fixed schemas, and the writes a row store has, as DataFrames.

A key-value table is a log of settings; the latest row of a key counts.  Nothing is updated in place, so
a lost executor or a repeated write changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from assayer import schemas


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty with the schema if there is none yet."""
    from py4j.java_gateway import JavaObject

    place: JavaObject = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def latest(log: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """Upsert: the last row of each key."""
    keys, by = ([key] if isinstance(key, str) else key), ([order] if isinstance(order, str) else order)
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*by)).alias("r"))
    return top.select("r.*")


def setting(log: DataFrame, key: str) -> DataFrame:
    return latest(log.where(F.col("key") == key), "key", "at")


def setting_keys(log: DataFrame) -> DataFrame:
    return log.select("key").distinct().orderBy("key")


def session_transcript(transcripts: DataFrame, session_id: str | None = None) -> DataFrame:
    """Turns of one or all sessions in the order of time and arrival."""
    own = transcripts if session_id is None else transcripts.where(F.col("session_id") == session_id)
    turn = Window.partitionBy("session_id").orderBy("at", "ingest_id")
    return own.withColumn("turn_no", F.row_number().over(turn))


def history(transcripts: DataFrame) -> DataFrame:
    return session_transcript(transcripts).select("session_id", "turn_no", "role", "content")


def evidence_of(ledger: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of ledger flags, for the jobs that may see content."""
    refs = ledger.select("provider_id", "seq", F.explode("flags").alias("f")).select("provider_id", "seq", F.col("f.type").alias("type"), F.col("f.evidence_ref").alias("ref"))
    return refs.join(evidence, "ref")


def residency(transcripts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(kind, n_rows, n_chars) of what stays in place; an empty table has zeros."""
    size = lambda text: F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("n_chars")
    spans = F.to_json("spans")
    return transcripts.agg(F.lit("transcripts").alias("kind"), F.count("*").alias("n_rows"), size("content")).union(evidence.agg(F.lit("evidence").alias("kind"), F.count("*").alias("n_rows"), size(spans)))


def replace_if_changed(current: DataFrame, fresh: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hot reload: the rows to hold now, and the keys that have gone."""
    return fresh, current.join(fresh, key, "left_anti").select(key)


def reloaded(current: DataFrame, document: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hot reload from the text of a JSON array (``document``, one row with ``value``) in the schema of ``current``.

    A document that does not parse, or none at all, leaves the rows as they are and takes no key away.
    """
    sound = document.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", ArrayType(current.schema)).alias("rows")).where("rows is not null")
    if not sound.limit(1).count():
        return replace_if_changed(current, current, key)
    return replace_if_changed(current, sound.select(F.explode("rows").alias("r")).select("r.*"), key)


def holds_no_content(table: DataFrame) -> None:
    """Rates jobs get the ledger only: a column that could hold content is an error."""
    found = {"content", "text", "spans", "sealed"} & {c.lower() for c in table.columns}
    if found:
        raise ValueError(f"a rates job must not see content, got {sorted(found)}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], getattr(schemas, name.upper()))
