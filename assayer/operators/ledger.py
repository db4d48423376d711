"""The per-provider hash-chained ledger."""

from __future__ import annotations

import hashlib
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import digests
from assayer.plans import ordered, stage

DOMAIN = "assayer-ledger/v1"


#: Rows of a provider that one task orders.
PART_ROWS = 1_000_000


def numbered(rows: DataFrame, *order: str | Column, part: Column | None = None) -> DataFrame:
    """Sequence numbers from 1 for each provider, in the given order; with ``part``, which must not fall along it, by parts of a provider."""
    if part is not None:
        return ordered.numbered(rows, "provider_id", list(order), part, "seq")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("provider_id").orderBy(*order)).cast("long"))


def appended(rows: DataFrame, heads: DataFrame | None = None, domain: str = DOMAIN) -> DataFrame:
    """``rows`` (with seq) with prev_hash and hash, going on from the heads (provider_id, hash) of an older ledger.

    Each hash feeds the next, so this is a fold over each provider; verification isn't.
    """
    old = rows.withColumn("head", F.lit(None).cast("string")) if heads is None else rows.join(heads.select("provider_id", F.col("hash").alias("head")), "provider_id", "left")
    names = [c.split(" ")[0] for c in ("provider_id", "seq", "response_id", "at_iso", "outcome", "score", "flags", "evaluator_version", "taxonomy_version")]

    def step(prev: str | None, row: dict[str, Any]) -> tuple[str, tuple]:
        before = prev or row["head"] or digests.GENESIS
        flags = ",".join(":".join(str(x) for x in (f["type"], f["severity"], f["evidence_ref"]) if x is not None) for f in row["flags"] or [])
        score = Decimal(row["score"]).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        parts = [domain, row["provider_id"], row["seq"], row["response_id"], row["at_iso"], row["outcome"], score, flags, before]
        now = hashlib.sha256("\n".join(str(p) for p in parts if p is not None).encode()).hexdigest()
        return now, (*(row[n] for n in names), before, now)

    return ordered.fold(old.select(*names, "head"), "provider_id", ["seq"], lambda: None, step, schemas.LEDGER)


def verify(ledger: DataFrame, domain: str = DOMAIN, part_rows: int = PART_ROWS) -> DataFrame:
    """(provider_id, rows, first_break): the first seq that doesn't follow the stored row before it; null if none.

    Row against row, so it is parallel within a provider too, by parts of ``part_rows`` numbers.
    """
    before = lambda w: {"before": F.coalesce(F.lag("hash").over(w), F.lit(digests.GENESIS))}
    checked = ordered.rolling(ledger, "provider_id", "seq", F.floor(F.col("seq") / part_rows), 1, before)
    broken = (F.col("prev_hash") != F.col("before")) | (digests.entry_hash(domain, F.col("prev_hash")) != F.col("hash"))
    return checked.groupBy("provider_id").agg(F.count("*").alias("rows"), F.min(F.when(F.coalesce(broken, F.lit(True)), F.col("seq"))).alias("first_break"))


def heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("provider_id").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "provider_id"]), "seq").alias("r")).select("provider_id", "r.*")


def providers(ledger: DataFrame) -> DataFrame:
    return ledger.select("provider_id").distinct()


def recent(ledger: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each provider; the rank filter works before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("seq")))
    return ledger.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of each provider with the seq that ``numbered`` would give them, of rows not numbered yet: only
    they and a count of each provider are shuffled."""
    place, total = stage.free_name(rows, "place_"), stage.free_name(rows, "total_")
    top = rows.withColumn(place, F.row_number().over(Window.partitionBy("provider_id").orderBy(*map(F.desc, order)))).where(F.col(place) <= n)
    sizes = rows.groupBy("provider_id").agg(F.count("*").alias(total))
    return top.join(sizes, "provider_id").withColumn("seq", F.col(total) - F.col(place) + 1).drop(place, total)


def between(ledger: DataFrame, since: Column, until: Column) -> DataFrame:
    return ledger.where((F.col("at") >= since) & (F.col("at") < until))


def in_order(ledger: DataFrame) -> DataFrame:
    return ledger.repartition("provider_id").sortWithinPartitions("provider_id", "seq")


def counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("provider_id").agg(F.count("*").alias("n_rows"))


def after_reset(ledger: DataFrame, resets: DataFrame) -> DataFrame:
    """Rows after the provider's last reset (provider_id, seq): a reset removes what came before."""
    last = resets.groupBy("provider_id").agg(F.max("seq").alias("reset_seq"))
    return ledger.join(last, "provider_id", "left").where(F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))).drop("reset_seq")
