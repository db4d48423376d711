"""Delivery decisions: everything in columns but the carryover, which feeds back on its own decisions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import policy as rules
from assayer.operators.ledger import PART_ROWS
from assayer.plans import parts


def fixed_outcome(standing: Column, passed: Column, sealed: Column, mandatory: Column, mode: Column, refuse_excluded: bool, unsealed: str) -> Column:
    """The outcomes that don't wait for the score, in their order; null where the score decides."""
    return (
        F.when((standing == "excluded") & F.lit(refuse_excluded), "refuse")
        .when(~passed, "refuse")
        .when(~sealed & F.lit(unsealed == "refuse"), "refuse")
        .when(mandatory.isNotNull(), "refuse")
        .when(mode == "observe", "deliver")
    )


def lines(remaining: int, warn: float, block: float, carryover: dict[str, Any]) -> tuple[float, float]:
    """Warn and block lines while a carryover is in force."""
    if remaining <= 0:
        return warn, block
    low = max(1, warn - carryover["warnDelta"])
    return low, max(low + 1, block - carryover["blockDelta"])


def step(remaining: int, row: dict[str, Any], carryover: dict[str, Any]) -> tuple[int, tuple[str, float, float, int]]:
    """(carryover after, (outcome, warn, block, carryover after)) of one response."""
    warn, block = lines(remaining, row["warn"], row["block"], carryover)
    kind = row["fixed"]
    if kind is None:
        if row["score"] >= block:
            kind = "deliver_with_notice" if row["mode"] == "annotate" else "withhold"
        else:
            kind = "deliver_with_notice" if row["score"] >= warn else "deliver"
    if row["sent"] and not row["n_flags"]:
        remaining = max(0, remaining - 1)
    if kind == "withhold":
        remaining = carryover["cleanResponses"]
    return remaining, (kind, warn, block, remaining)


def decided(row: dict[str, Column], lowered: bool, carryover: dict[str, Any]) -> tuple[Column, Column, Column]:
    """(outcome, warn, block) in columns, with or without a carryover in force."""
    warn, block = row["warn"], row["block"]
    if lowered:
        warn = F.greatest(F.lit(1.0), warn - carryover["warnDelta"])
        block = F.greatest(warn + 1, block - carryover["blockDelta"])
    scored = F.when(row["score"] >= block, F.when(row["mode"] == "annotate", "deliver_with_notice").otherwise("withhold")).when(row["score"] >= warn, "deliver_with_notice").otherwise("deliver")
    return F.coalesce(row["fixed"], scored), warn, block


def decisions(rows: DataFrame, policy: dict[str, Any], part_rows: int = PART_ROWS) -> DataFrame:
    """Outcomes of (provider_id, seq, response_id, score, warn, block, mode, fixed, n_flags, sent): one row each.

    ``sent`` is false for a refusal before sending, which neither carries nor decays anything.  What a response does to the
    clean responses still to come is a map of few states, so a provider's rows are cut in parts of ``part_rows`` numbers.
    """
    carryover = policy["carryover"]
    most = int(carryover["cleanResponses"])
    names = ["provider_id", "seq", "response_id", "score", "warn", "block", "mode", "fixed", "n_flags", "sent"]
    given = rows.select("provider_id", F.col("seq").cast("long").alias("seq"), "response_id", *[F.col(c).cast("double").alias(c) for c in ("score", "warn", "block")], *names[6:])
    row = {c: F.col(c) for c in names}
    plain, low = (decided(row, lowered, carryover) for lowered in (False, True))
    clean = F.col("sent") & (F.col("n_flags") == 0)

    def after(state: int) -> Column:
        outcome = low[0] if state else plain[0]
        return F.when(outcome == "withhold", most).when(clean, max(0, state - 1)).otherwise(state)

    out = parts.automaton(given, "provider_id", ["seq"], F.floor(F.col("seq") / part_rows), [after(s) for s in range(most + 1)], "before")
    left = F.col("before")
    kind, warn, block = (F.when(left > 0, lowered).otherwise(own) for own, lowered in zip(plain, low))
    remaining = F.when(kind == "withhold", most).when(clean, F.greatest(F.lit(0), left - 1)).otherwise(left)
    return out.select("provider_id", "seq", "response_id", "score", kind.alias("outcome"), warn.alias("effective_warn"), block.alias("effective_block"), remaining.cast("int").alias("clean_remaining"))


def with_authority(decided: DataFrame, flags: Column, policy: dict[str, Any], found: dict[str, Any] | None = None) -> DataFrame:
    return decided.withColumn("release_authority", F.when(F.col("outcome") == "withhold", rules.worst_authority(flags, policy, found)))


def reasons(standing: Column, passed: Column, sealed: Column, mandatory: Column, mode: Column, refuse_excluded: bool, unsealed: str, score: Column, warn: Column, block: Column) -> Column:
    """Codes of what decided, in the order of the checks; the last one names the branch that made the outcome."""
    noticed = F.when(~sealed & F.lit(unsealed == "notice"), F.array(F.lit("unsealed_notice"))).otherwise(F.array().cast("array<string>"))
    last = (
        F.when(mandatory.isNotNull(), F.concat(F.lit("mandatory:"), mandatory))
        .when(mode == "observe", "observe_mode")
        .when((score >= block) & (mode == "annotate"), "block_line_annotated")
        .when(score >= block, "block_line")
        .when(score >= warn, "warn_line")
        .otherwise("below_lines")
    )
    return (
        F.when((standing == "excluded") & F.lit(refuse_excluded), F.array(F.lit("standing_excluded")))
        .when(~passed, F.array(F.lit("deterministic_refusal")))
        .when(~sealed & F.lit(unsealed == "refuse"), F.array(F.lit("unsealed_refused")))
        .otherwise(F.concat(noticed, F.array(last)))
    )


def notices(reason: Column, outcome: Column) -> Column:
    """Codes of the notices that go with an outcome: a provenance notice stays whatever the score decides."""
    return F.concat(F.filter(reason, lambda r: r == "unsealed_notice"), F.when((outcome == "deliver_with_notice") & (F.get(F.reverse(reason), F.lit(0)) == "warn_line"), F.array(F.lit("warn_band"))).otherwise(F.array().cast("array<string>")))


def score_parts(number: Column, window: Column, instant: Column, seed: Column) -> Column:
    """The score beside what it adds up."""
    return F.struct(number.alias("score"), window.alias("window"), instant.alias("instant"), seed.alias("seed"))
