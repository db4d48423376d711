"""Schemas of the tables and documents the engine reads and writes."""

from __future__ import annotations

FLAG = "struct<type: string, severity: int, evidence_ref: string>"
SPAN = "struct<start: int, end: int, text: string>"

LEDGER = (
    f"provider_id string, seq long, response_id string, at_iso string, outcome string, score decimal(18,4), flags array<{FLAG}>, "
    "evaluator_version string, taxonomy_version string, prev_hash string, hash string"
)
TRANSCRIPTS = "id string, session_id string, provider_id string, role string, at timestamp, ingest_id long, content string"
EVIDENCE = f"ref string, response_id string, spans array<{SPAN}>"
CARRYOVER = "provider_id string, multiplier double, clean_remaining int, set_at timestamp"
BLOCKS = "provider_id string, response_id string, authority string, raised_at timestamp, released_at timestamp, released_by string"
SETTINGS = "key string, value string, at timestamp"
TELEMETRY = "id string, window_start timestamp, window_end timestamp, emitted_at timestamp, payload string"
KEY = "struct<selector: string, publicKeyPem: string, status: string, retiredAt: string>"
REGISTER_ENTRY = (
    "id string, providerIdentity string, status string, authorizedEndpoints array<string>, models array<string>, sealPolicy string, "
    f"contentBinding string, identityDomain string, keys array<{KEY}>"
)
SEAL = "struct<registerEntryId: string, selector: string, model: string, providerIdentity: string, exchangeId: string, requestDigest: string, signedAt: string, alg: string, signature: string>"
STANDING_ENTRY = "registerEntryId string, state string, quorumSources int, excludedInJurisdictions array<string>"

#: Fixed orders that decide between several values.
MODES = ("observe", "annotate", "enforce")
AUTHORITIES = ("self_release", "custodial_release", "escalating", "non_releasable")
