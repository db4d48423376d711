"""Configuration documents (taxonomy, policy, overlay, standing, register, providers).

They are read through Spark, so any file system Spark knows will do, and parsed on the driver: each is
one small document.  Objects with a repeated member are rejected where the document is signed.
"""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from assayer import schemas


def unique_members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a member name is repeated")
    return out


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_document(spark: SparkSession, path: str, strict: bool = False) -> dict[str, Any]:
    return json.loads(read_text(spark, path), object_pairs_hook=unique_members if strict else None)


def discovered(explicit: str | None, variable: str, default: str) -> str:
    """Where a document is: the given path, else the environment variable, else the default."""
    return explicit or os.environ.get(variable) or default


def register_entries(spark: SparkSession, document: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame([json.dumps(e) for e in document.get("entries", [])], "string").selectExpr(f"from_json(value, '{schemas.REGISTER_ENTRY}') AS e").select("e.*")


def standing_entries(spark: SparkSession, document: dict[str, Any] | None) -> DataFrame:
    rows = [json.dumps(e) for e in (document or {}).get("providers", [])]
    return spark.createDataFrame(rows, "string").selectExpr(f"from_json(value, '{schemas.STANDING_ENTRY}') AS e").select("e.*")


def write_providers(providers: DataFrame, path: str) -> None:
    providers.write.mode("overwrite").json(path)


#: Documents that stand for none.
NO_OVERLAY: dict[str, Any] = {"id": "none", "name": "No overlay loaded", "version": "0"}
NO_STANDING: dict[str, Any] = {"thresholds": {"warnRate": 0.05, "exclusionRate": 0.15, "minimumQuorumSources": 25}, "providers": []}

#: Policy of a demonstration scale; fixed values.
DEFAULT_POLICY: dict[str, Any] = {
    "mode": "enforce",
    "window": {"kind": "count", "n": 10, "scope": "cross_session"},
    "thresholds": {"warn": 4, "block": 8},
    "carryover": {"warnDelta": 1, "blockDelta": 2, "cleanResponses": 5},
    "standingSeed": {"elevatedSeedScore": 2, "refuseExcluded": True, "unknownSeedScore": 0},
    "releaseAuthority": {"default": "self_release", "byFlagType": {}},
    "notices": [],
    "telemetry": {"granularityFloor": 20},
}

#: The taxonomy that comes with the engine: patterns that mean the same to Java and RE2.
TAXONOMY: dict[str, Any] = {
    "taxonomyVersion": "own-1",
    "status": "current",
    "flags": [
        {"type": "contact_detail", "severity": 2, "criteria": [{"id": "email", "pattern": r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9]", "needs": "@", "unless": []}, {"id": "phone", "pattern": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "needs": "+1 (", "unless": ["555-00"]}]},
        {"type": "network_address", "severity": 1, "criteria": [{"id": "ipv4", "pattern": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "unless": [r"^127\."]}]},
        {"type": "secret", "severity": 3, "criteria": [{"id": "assignment", "pattern": r"(?:token|password|api_key|secret) = .[a-z0-9]{8,}", "needs": " = ", "unless": []}]},
        {"type": "licence_text", "severity": 1, "criteria": [{"id": "licence", "pattern": r"licensed under [a-z ]+", "unless": []}]},
        {"type": "shouting", "severity": 1, "criteria": [{"id": "marks", "pattern": r"[a-z]+!! [a-z]+!! [a-z]+!!", "needs": "!! ", "unless": []}]},
    ],
}


def read_signed(spark: SparkSession, path: str, signature_path: str, pinned_key_path: str) -> tuple[dict[str, Any], bool]:
    """A document and whether its detached signature verifies with the pinned key (never with one inside it)."""
    from assayer.functions import ed25519

    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    signature, pem = read_text(spark, signature_path).strip(), read_text(spark, pinned_key_path)
    return json.loads(raw, object_pairs_hook=unique_members), ed25519.verify(ed25519.key_of(pem), raw, ed25519.signature_bytes(signature))
