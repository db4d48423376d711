"""The host's named operations over a store: what a window or a service asks for."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import api
from assayer.operators import ledger, policy, scoring
from assayer.plans import stage
from assayer.sources.documents import DEFAULT_POLICY, NO_OVERLAY, TAXONOMY
from assayer.sources.store import Store


class Host:
    """State of one user over a store; answers are DataFrames or small documents.

    Responses come in as a table, not over a network: ``ask`` evaluates it and writes what it decided.
    """

    def __init__(self, store: Store, rules: dict[str, Any] = DEFAULT_POLICY, overlay: dict[str, Any] = NO_OVERLAY, taxonomy: dict[str, Any] = TAXONOMY) -> None:
        self.store, self.rules, self.overlay, self.taxonomy = store, rules, overlay, taxonomy
        self.session_id = uuid.uuid4().hex

    @property
    def adult(self) -> bool:
        return self.store.preferences.get("isAdult") == "true"

    def state(self) -> dict[str, Any]:
        """Session, attestations, lines in force, transport, pending provisions, versions and each provider's row."""
        warn, block = policy.thresholds(self.overlay, self.rules, not self.adult)
        return {
            "sessionId": self.session_id, "attestations": {"isAdult": self.adult}, "effectiveThresholds": {"warn": warn, "block": block},
            "transport": {"withholdUnverifiedContent": self.store.preferences.get("withholdUnverifiedContent") == "true"},
            "jurisdiction": self.overlay.get("id"), "pendingProvisions": policy.pending(self.overlay), "policy": self.rules,
            "taxonomy": {"version": self.taxonomy["taxonomyVersion"], "status": self.taxonomy["status"], "flags": [{"type": f["type"], "severity": f["severity"]} for f in self.taxonomy["flags"]]},
            "providers": self.providers(),
        }

    def providers(self) -> DataFrame:
        own = self.store.ledger
        state = scoring.monitor_state(own.rows(), own.blocks(), own.verify(), self.rules["window"].get("n") or 10)
        return state.join(own.carryover().select("provider_id", "clean_remaining"), "provider_id", "left")

    def ask(self, responses: DataFrame) -> DataFrame:
        """Takes (provider_id, response_id, at, content[, standing, passed, sealed]) through flags, score and gate; returns the gate's results.

        The ledger gets a row of each, the transcript its sealed text, withheld ones a block.
        """
        given = {"standing": F.lit("unknown"), "passed": F.lit(True), "sealed": F.lit(True)}
        rows = responses.withColumns({c: v for c, v in given.items() if c not in responses.columns}).withColumn("at", F.col("at").cast("timestamp"))
        flagged = api.flag(rows, api.RuleEvaluator(self.taxonomy)).withColumn("at_iso", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        flagged = flagged.withColumn("flags", F.transform("flags", lambda f: F.struct(f["type"].alias("type"), f["severity"].cast("int").alias("severity"), F.concat("response_id", F.lit(":"), f["type"]).alias("evidence_ref"))))
        old = self.store.ledger.rows().select("provider_id", "response_id", F.to_timestamp("at_iso").alias("at"), "flags", F.lit(True).alias("old"))
        both = old.unionByName(flagged.select("provider_id", "response_id", "at", "flags", *given, F.lit(False).alias("old")), allowMissingColumns=True)
        scored = api.score(ledger.numbered(both.withColumn("new", ~F.col("old")), "new", "at", "response_id"), self.rules)
        asked = [F.coalesce(F.col(c), v) for c, v in given.items()]
        results = api.resolve(scored, F.lit(self.session_id), *asked, minor=not self.adult, rules=self.rules, overlay=self.overlay)
        results = results.join(flagged.select("provider_id", "response_id", "at_iso", "at", "flags", "content"), ["provider_id", "response_id"])
        version = F.lit(api.RuleEvaluator(self.taxonomy).version)
        results = stage.saved(results)
        self.store.ledger.append(results.select("provider_id", "response_id", "at_iso", "outcome", "score", "flags", version.alias("evaluator_version"), F.lit(self.taxonomy["taxonomyVersion"]).alias("taxonomy_version")))
        self.store.ledger._append("raises", results.where("outcome = 'withhold'").select("provider_id", "response_id", F.col("release_authority").alias("authority"), F.col("at").alias("raised_at")))
        self.store.transcripts.put_turns(results.select(F.lit(self.session_id).alias("session_id"), F.col("response_id").alias("id"), F.lit("assistant").alias("role"), "at", F.unix_micros("at").alias("ingest_id"), F.coalesce("content", F.lit("")).alias("content")))
        return results.drop("content", "at", "flags")

    def release(self, provider: str, response: str, actor: str, at_iso: str) -> dict[str, Any]:
        """Whether the actor may release, why not, and the content if so."""
        own = self.store.ledger
        asked = own.spark.createDataFrame([(provider, response, actor, self.adult)], "provider_id string, response_id string, actor string, adult boolean")
        found = policy.release(own.blocks(), asked).first()
        if not found["released"]:
            return {"released": False, "reason": found["reason"], "content": None}
        own.release_block(provider, response, actor, at_iso)
        text = self.store.transcripts.content().where(F.col("id") == response).first()
        return {"released": True, "reason": None, "content": text and text["content"]}

    def export(self, since_iso: str, until_iso: str, floor: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(each provider's payload, the summary beside what stays)."""
        rows = self.store.ledger.rows().withColumn("at", F.to_timestamp("at_iso"))
        rated = scoring.rates(rows.select("provider_id", "at", "flags"), F.lit(since_iso).cast("timestamp"), F.lit(until_iso).cast("timestamp"), self.rules["telemetry"]["granularityFloor"] if floor is None else floor)
        view = scoring.export_view(rated, rows)
        return view, scoring.export_summary(view, *self.store.transcripts.stored())

    def dispatch(self, method: str, params: dict[str, Any] | None = None) -> Any:
        """One of the named operations, as a service or a window calls it."""
        p = params or {}
        if method == "session.new":
            self.session_id = uuid.uuid4().hex
            return {"sessionId": self.session_id}
        if method in ("attestations.set", "transport.set"):
            name = "isAdult" if method == "attestations.set" else "withholdUnverifiedContent"
            self.store.preferences.set(name, "true" if p.get(name) else "false")
            return {name: bool(p.get(name))}
        known = {
            "state": lambda: self.state(), "policy": lambda: self.rules, "transcript": lambda: self.store.transcripts.session(self.session_id), "ask": lambda: self.ask(p["responses"]),
            "release": lambda: self.release(p["providerId"], p["responseId"], "custodian" if p.get("actor") == "custodian" else "self", p["at"]),
            "reputation.reset": lambda: self.store.ledger.reset(p.get("providerId") or None), "export": lambda: self.export(p["since"], p["until"], p.get("floor")),
        }
        if method not in known:
            raise ValueError(f"unknown method: {method}")
        return known[method]()
