"""Rows for a dashboard: bands, offers to release, notices of a delivery, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivery_notices(outcome: Column, notices: Column) -> Column:
    """The monitor's own notices of a delivery with notice; none otherwise."""
    own = F.filter(notices, lambda n: n["source"] == "monitor")
    return F.when(outcome == "deliver_with_notice", own).otherwise(F.slice(notices, 1, 0))


def total_withheld(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum("open_blocks"), F.lit(0)).cast("long").alias("total_withheld"))


def largest_count(rated: DataFrame) -> DataFrame:
    """The largest flag count of any provider and type."""
    return rated.select(F.explode_outer(F.map_values("flag_counts")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"))


#: The mark that each stage of an exchange lights, of connect, receive, verify, evaluate, decide, deliver.
MARK_OF_STAGE = {
    "checking_standing": 0, "awaiting_response": 1, "receiving": 1, "response_complete": 1, "verifying_seal": 2,
    "evaluating_content": 3, "resolving_delivery": 4, "recording": 4, "delivering": 5,
}
MARKS, EVALUATE, DECIDE = 6, 3, 4


def trail(stage: Column, outcome: Column, unsent: Column, unevaluated: Column) -> Column:
    """The six marks (pending, active, done, skipped, stopped) of an exchange that has come to ``stage``.

    With an ``outcome`` the exchange is over: a delivery has every mark done, anything else stops at the decision,
    or at once where it was refused ``unsent``.  An unknown stage counts as the first.
    """
    active = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in MARK_OF_STAGE.items() for x in item]), stage), F.lit(0))
    delivered = F.coalesce(outcome.isin("deliver", "deliver_with_notice"), F.lit(False))
    halt = F.when((outcome == "refuse") & unsent, 0).when(outcome.isNotNull() & ~delivered, DECIDE)

    def mark(i: Column) -> Column:
        passed = F.when((i == EVALUATE) & unevaluated, "skipped").otherwise("done")
        halted = F.when(i < halt, passed).when(i == halt, "stopped").otherwise("pending")
        going = F.when(i < active, "done").when(i == active, "active").otherwise("pending")
        return F.when(delivered, "done").when(halt.isNotNull(), halted).otherwise(going)

    return F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), mark)


def _active(stage: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in MARK_OF_STAGE.items() for x in item]), stage), F.lit(0))


def trail_after(before: Column, stage: Column) -> Column:
    """The marks once a stage is reported: those before it are done, but what was skipped or stopped stays."""
    now = _active(stage)

    def mark(i: Column) -> Column:
        own = F.coalesce(F.get(before, i), F.lit("pending"))
        return F.when(own.isin("stopped", "skipped"), own).when(i < now, "done").when(i == now, "active").otherwise("pending")

    return F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), mark)


def trail_settled(before: Column, outcome: Column, passed: Column, evaluated: Column, sent: Column) -> Column:
    """The marks of a finished exchange: a delivery has all done; else it stops at the decision, or at once where nothing was
    sent, and the evaluation counts as skipped where the deterministic layer refused without one."""
    delivered = F.coalesce(outcome.isin("deliver", "deliver_with_notice"), F.lit(False))
    halt = F.when((outcome == "refuse") & ~sent, 0).otherwise(DECIDE)

    def mark(i: Column) -> Column:
        skipped = ((i == EVALUATE) & ~passed & ~evaluated) | (F.coalesce(F.get(before, i), F.lit("pending")) == "skipped")
        stopped = F.when(i == halt, "stopped").when(i > halt, "pending").when(skipped, "skipped").otherwise("done")
        return F.when(delivered, "done").otherwise(stopped)

    return F.transform(F.sequence(F.lit(0), F.lit(MARKS - 1)), mark)


def trail_reduced(before: Column, stages: Column) -> Column:
    """``trail_after`` of an exchange's stages, one after the other."""
    return F.aggregate(stages, before, lambda marks, stage: trail_after(marks, stage))


def halted(marks: Column) -> Column:
    return F.array_contains(marks, "stopped")


def complete(marks: Column) -> Column:
    return F.forall(marks, lambda m: m == "done")


def scripted(calls: DataFrame, script: Column, key: str, order: str) -> DataFrame:
    """``calls`` with the scripted response of each as ``text``: one after the other for each key, the last one again for all later calls."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return calls.withColumn("text", F.get(script, F.least(nth, F.size(script)) - 1))


def scripted_deltas(texts: DataFrame) -> DataFrame:
    """(exchange_id, chunk_no, chunk) of a scripted response (exchange_id, text): one event for each run of blanks or
    other characters, and the end marker; a fixture for the stream operators."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"\s+|\S+"), F.lit(0))
    # to_json of an array writes the string's JSON form between brackets.
    quoted = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    events = F.concat(F.transform(tokens, lambda t: F.concat(F.lit('data: {"choices":[{"delta":{"content":'), quoted(t), F.lit("}}]}\n\n"))), F.array(F.lit("data: [DONE]\n\n")))
    return texts.select("exchange_id", F.posexplode(events).alias("chunk_no", "e")).select("exchange_id", "chunk_no", F.encode("e", "UTF-8").alias("chunk"))
