"""The engine as a few functions over DataFrames: flag, verify, score, decide, rates, export_view, monitor_state.

Time is always a column or a parameter, never the clock, so a replay gives what the first run gave.
"""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import flags as scanning
from assayer.operators import gate, ledger, notices, policy, scoring, verdict
from assayer.plans import stage
from assayer.sources.documents import DEFAULT_POLICY, NO_OVERLAY, TAXONOMY

rates = scoring.rates
export_view = scoring.export_view
monitor_state = scoring.monitor_state
verify_chain = ledger.verify
release = policy.release


class Evaluator(Protocol):
    """What finds flags in responses; ``flags`` adds an array column of that name and drops no row."""

    id: str
    version: str

    def flags(self, responses: DataFrame, content: Column) -> DataFrame: ...


class RuleEvaluator:
    """The taxonomy scan; its version names the taxonomy, so a verdict belongs to one pair of both."""

    id = "rules"

    def __init__(self, taxonomy: dict[str, Any] = TAXONOMY, evidence: bool = False) -> None:
        self.taxonomy, self.evidence, self.version = taxonomy, evidence, scanning.evaluator_version(taxonomy)

    def flags(self, responses: DataFrame, content: Column) -> DataFrame:
        return responses.withColumn("flags", scanning.flags(F.coalesce(content, F.lit("")), self.taxonomy, self.evidence))


class CapturedVerdicts:
    """An outside model's verdict texts, captured in a column; only their reading happens here."""

    id, version = "model", "captured"

    def __init__(self, verdict_column: str, taxonomy: dict[str, Any] = TAXONOMY) -> None:
        self.column, self.taxonomy = verdict_column, taxonomy

    def flags(self, responses: DataFrame, content: Column) -> DataFrame:
        return responses.withColumn("flags", scanning.model_flags(F.col(self.column), content, self.taxonomy))


def evaluator_of(config: dict[str, Any] | None, taxonomy: dict[str, Any] = TAXONOMY) -> Evaluator:
    """The evaluator a configuration names: ``rule`` (also without one), or ``model`` with the column of its captured verdicts."""
    kind = (config or {}).get("kind", "rule")
    if kind == "rule":
        return RuleEvaluator(taxonomy)
    if kind == "model" and config.get("verdictColumn"):
        return CapturedVerdicts(config["verdictColumn"], taxonomy)
    raise ValueError(f"an evaluator of kind {kind!r} is unknown or names no column of verdicts")


def flag(responses: DataFrame, evaluator: Evaluator | None = None, content: str = "content") -> DataFrame:
    return (evaluator or RuleEvaluator()).flags(responses, F.col(content))


def verify(responses: DataFrame, register: DataFrame) -> DataFrame:
    return verdict.verdicts(verdict.looked_up(responses, register))


def score(flagged: DataFrame, rules: dict[str, Any] = DEFAULT_POLICY, session: Column | None = None) -> DataFrame:
    """(…, instant_score, window_score, window_size) of rows (provider_id, seq, at, flags) by the policy's window.

    ``session`` is the session's start for a count window and its id for a time window.
    """
    rows, w = scoring.with_instant(flagged), rules["window"]
    own = session if w.get("scope") == "session" else None
    return scoring.time_window(rows, w.get("hours") or 24, own) if w["kind"] == "time" else scoring.count_window(rows, w.get("n") or 10, own)


def decide(scored: DataFrame, standing: Column, passed: Column, sealed: Column, minor: bool = False, rules: dict[str, Any] = DEFAULT_POLICY, overlay: dict[str, Any] = NO_OVERLAY) -> DataFrame:
    """Outcomes and release authorities of scored rows under a policy and an overlay, for one kind of users.

    Severities are raised to the overlay's floors for the response itself; rows before it count as they are in the ledger.
    A provider excluded before sending has its row with no score and leaves the carryover as it is.
    """
    found = policy.treatments(overlay, minor)
    raised = policy.floored(F.col("flags"), found)
    warn, block = policy.thresholds(overlay, rules, minor)
    mode = F.lit(policy.mode(overlay, rules["mode"], minor))
    seed = rules["standingSeed"]
    excluded = (standing == "excluded") & F.lit(seed["refuseExcluded"])
    total = F.col("window_score") + scanning.instant_score(raised) + scoring.seed(standing, seed["elevatedSeedScore"], seed["unknownSeedScore"])
    fixed = gate.fixed_outcome(standing, passed, sealed, policy.first_mandatory(raised, found), mode, seed["refuseExcluded"], policy.unsealed(overlay))
    given = scored.withColumns({"score": F.when(excluded, 0).otherwise(total), "warn": F.lit(warn), "block": F.lit(block), "mode": mode, "fixed": fixed, "n_flags": F.size("flags"), "sent": ~excluded})
    decided = gate.decisions(given, rules)
    flags_of = scored.select("provider_id", F.col("seq").cast("long").alias("seq"), raised.alias("flags"))
    return gate.with_authority(decided.join(flags_of, ["provider_id", "seq"]), F.col("flags"), rules, found).drop("flags")


def resolve(scored: DataFrame, session: Column, standing: Column, passed: Column, sealed: Column, minor: bool = False, rules: dict[str, Any] = DEFAULT_POLICY, overlay: dict[str, Any] = NO_OVERLAY) -> DataFrame:
    """``decide`` with what a gate result says besides: (provider_id, seq, response_id, score, outcome, .., release_authority, reasons, notices).

    ``reasons`` has codes in the order of the checks.  ``notices`` are ids: the policy's, then the overlay's that this delivery of its
    session raises, then the provenance notice of an unsealed response, whatever the outcome, then the warn band's.
    """
    found = policy.treatments(overlay, minor)
    mode = F.lit(policy.mode(overlay, rules["mode"], minor))
    given = scored.withColumns({"standing": standing, "passed": passed, "sealed": sealed, "session_id": session, "at_ms": F.unix_millis(F.col("at").cast("timestamp"))})
    given = stage.saved(given.withColumn("mandatory", policy.first_mandatory(policy.floored(F.col("flags"), found), found)))
    own = {c: F.col(c) for c in ("standing", "passed", "sealed")}
    decided = decide(given, **own, minor=minor, rules=rules, overlay=overlay)
    context = given.select("provider_id", F.col("seq").cast("long").alias("seq"), *own, "mandatory", "session_id", "at_ms")
    decided = decided.join(context, ["provider_id", "seq"])
    reasons = gate.reasons(*own.values(), F.col("mandatory"), mode, rules["standingSeed"]["refuseExcluded"], policy.unsealed(overlay), F.col("score"), F.col("effective_warn"), F.col("effective_block"))
    decided = stage.saved(decided.withColumn("reasons", reasons))
    deliveries = decided.select("session_id", "at_ms", F.col("seq").alias("order_id"), (F.col("outcome") == "deliver_with_notice").alias("in_warn_band"))
    raised = notices.raised(deliveries.distinct(), [*rules.get("notices", []), *policy.notices(overlay)])
    keys = F.struct("session_id", "at_ms", F.col("order_id").alias("seq")).alias("of")
    out = decided.withColumn("of", F.struct("session_id", "at_ms", "seq")).join(raised.select(keys, "raised"), "of")
    pinned = F.concat("raised", gate.notices(F.col("reasons"), F.col("outcome")))
    return out.withColumn("notices", pinned).drop("of", "raised", "session_id", "at_ms", "mandatory", *own)


def withheld_content(decided: DataFrame, released: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Texts of withheld responses that an authority has released (provider_id, response_id)."""
    own = decided.where("outcome = 'withhold'").join(released.select("provider_id", "response_id"), ["provider_id", "response_id"], "left_semi")
    return own.select("provider_id", "response_id").join(transcripts.select(F.col("id").alias("response_id"), "content"), "response_id")


def pinned(raised: DataFrame) -> DataFrame:
    """One row of each notice id, the first raised."""
    return raised.groupBy("id").agg(F.min_by(F.struct(*[c for c in raised.columns if c != "id"]), "raised_at").alias("r")).select("id", "r.*")


def confirmed_entry(responses: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Responses with the register entry that DNS names (provider_id, entry_id, key_set_digest), else the configured one."""
    dns = looked_up.select("provider_id", F.col("entry_id").alias("dns_entry"), F.col("key_set_digest").alias("dns_digest"))
    return responses.join(dns, "provider_id", "left").withColumn("register_entry_id", F.coalesce("dns_entry", "register_entry_id")).drop("dns_entry")
