"""Saved intermediate tables and connected components, both spread over the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or set on the Spark context.

    Without one an error is raised: a folder of the driver's machine would be another one on each executor.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Driver and executor are one process here: the warehouse is as good as shared.
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_assayer"
    if not known.isDefined():
        context.setCheckpointDir(folder)
    return folder


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each made longer while ``df`` has a column of its name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small table through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Writes a large table as Parquet (compressed, read by column) to the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def free(*tables: DataFrame) -> None:
    """Deletes saved tables whose readers have all been saved themselves."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A saved table of a few narrow columns, marked for broadcast if it has at most
    ``most`` rows (some 16 MB); a larger one is left to be joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def small_lists(rows: DataFrame, lists: str, most: int = 2_000_000) -> DataFrame:
    """A saved table with a column of lists, marked for broadcast if it has at most ``most`` values in all (some 16 MB)."""
    values = rows.agg(F.coalesce(F.sum(F.size(lists) + 4), F.lit(0))).first()[0]
    return F.broadcast(rows) if values <= most else rows


#: Edges of two numbers each (some 6 MB in all) that one task takes without any shuffle.
ONE_TASK = 200_000


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node but the least of each component, which is its name.

    Alternating large-star and small-star steps: every step replaces links by links
    to a least neighbour, so the table never grows beyond the number of links, and a
    group of any size is spread by its members.  Only a table of ``ONE_TASK`` links at most is left to one task,
    as the files of a shuffle would be larger than it is.
    """

    def star(edges: DataFrame, pick: Column) -> DataFrame:
        both = together(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        new = both.where(pick).join(least, "a").select(F.col("m").alias("a"), "b")
        own = least.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return together(new.union(own)).where("a <> b").distinct()

    def settled(edges: DataFrame) -> bool:
        """Whether every node is either the least of its component or linked to that alone."""
        nodes = together(edges.select("b").union(together(edges.select("a")).distinct()))
        return is_empty(nodes.groupBy("b").count().where("count > 1"))

    edges = checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = edges.count() <= ONE_TASK

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    for _ in range(rounds):
        if settled(edges):
            break
        # Saved between the two steps: each reads its input twice.
        edges = checkpoint(star(edges, F.col("b") > F.col("a")))
        edges = checkpoint(star(edges, F.col("b") < F.col("a")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
