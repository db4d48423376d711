"""The deterministic pass: ordered findings, verdict and attribution, in one projection after two lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import urls
from assayer.plans import stage

FUTURE_SKEW_MS, OLDEST_MS = 300_000, 3_600_000


def millis(text: Column) -> Column:
    """Milliseconds of an ISO time; null where it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def freshness(signed_at: Column, received_at: Column) -> Column:
    """``seal_malformed``, ``seal_not_fresh`` or null, against the time of receipt."""
    offset = millis(signed_at) - millis(received_at)
    return F.when(millis(signed_at).isNull(), "seal_malformed").when((offset > FUTURE_SKEW_MS) | (-offset > OLDEST_MS), "seal_not_fresh")


def key_status(status: Column, retired_at: Column, signed_at: Column) -> Column:
    """Code of a key that doesn't vouch, as of the signature; null for one that does."""
    retired = millis(retired_at).isNull() | millis(signed_at).isNull() | (millis(signed_at) >= millis(retired_at))
    return F.when(status == "compromised", "seal_key_compromised").when((status == "retired") & retired, "seal_key_retired").when(~status.isin("current", "rotating", "retired") | status.isNull(), "seal_key_unknown")


def looked_up(responses: DataFrame, entries: DataFrame) -> DataFrame:
    """Responses with the register entry of the *provider* and the key the seal names in it; the response never
    chooses its entry."""
    flat = entries.select(F.col("id").alias("register_entry_id"), F.struct(*entries.columns).alias("entry"))
    out = responses.join(flat, "register_entry_id", "left")
    return out.withColumn("key", F.get(F.filter(F.col("entry.keys"), lambda k: k["selector"] == F.col("seal.selector")), F.lit(0)))


def verdicts(rows: DataFrame) -> DataFrame:
    """``looked_up`` rows with ``verdict`` (passed, seal_present, seal_valid, endpoint_authorized, attribution, findings).

    Signature checks are an input (``signature_valid``), since they need the served bytes only.
    """
    # Times and URLs are read once: what several findings ask for is a column of an earlier projection.
    names = dict(zip(("fresh", "status", "endpoint"), (stage.free_name(rows, n) for n in ("fresh", "status_of_key", "endpoint"))))
    known = F.col("entry").isNotNull()
    columns = rows.columns
    rows = rows.withColumns({
        names["fresh"]: freshness(F.col("seal.signedAt"), F.col("received_at")),
        names["status"]: F.when(known & F.col("key").isNotNull(), key_status(F.col("key.status"), F.col("key.retiredAt"), F.col("seal.signedAt"))),
        names["endpoint"]: F.when(known, urls.endpoint_authorized(F.col("entry.authorizedEndpoints"), F.col("served_from"))).otherwise(F.lit(True)),
    })
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    entry, sealed = c("entry").isNotNull(), c("seal").isNotNull()
    named = c("register_entry_id").isNotNull()
    digests = c("dns_digest").isNotNull() & c("computed_digest").isNotNull()
    equal = digests & (c("dns_digest") == c("computed_digest"))
    key = c("key").isNotNull()
    fresh, status, endpoint = (c(names[n]) for n in ("fresh", "status", "endpoint"))
    checked = sealed & entry & key & status.isNull()
    signed = checked & yes(c("signature_valid"))
    same_provider = yes(c("seal.providerIdentity") == c("entry.providerIdentity"))
    valid = signed & same_provider
    all_sealed = yes(c("entry.sealPolicy") == "all")

    def finding(when: Column, code: Column | str, refuses: Column | bool) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        refuses = F.lit(refuses) if isinstance(refuses, bool) else refuses
        return F.when(yes(when), F.struct(code.alias("code"), refuses.alias("refuses")))

    found = F.array_compact(F.array(
        finding(named & ~entry, "register_entry_unknown", True),
        finding(c("entry.status") == "revoked", "register_entry_revoked", True),
        finding(digests & ~equal, "key_set_digest_mismatch", True),
        finding(c("multiple_seals"), "seal_multiple", True),
        finding(c("seal_duplicate_member"), "seal_duplicate_json_member", True),
        finding(c("seal_decode_failed") & ~yes(c("seal_duplicate_member")), "seal_malformed", True),
        finding(c("content_after_seal"), "content_after_terminal_seal", True),
        finding(c("unknown_binding"), "unknown_content_binding", False),
        finding(~sealed & ~yes(c("seal_decode_failed")) & ~yes(c("multiple_seals")), "seal_absent", all_sealed),
        finding(sealed & named & ~c("seal.registerEntryId").eqNullSafe(c("register_entry_id")), "seal_entry_mismatch", True),
        finding(sealed & (F.coalesce(c("seal.exchangeId"), F.lit("")) != c("exchange_id")), "exchange_id_mismatch", True),
        finding(sealed & fresh.isNotNull(), fresh, True),
        finding(sealed & ~entry & ~named, "seal_key_unknown", True),
        finding(sealed & entry & ~key, "seal_key_unknown", True),
        finding(sealed & status.isNotNull(), status, status == "seal_key_unknown"),
        finding(checked & ~signed, "seal_signature_invalid", True),
        finding(signed & ~same_provider, "seal_provider_mismatch", True),
        finding(valid & ~yes(F.array_contains(c("entry.models"), c("seal.model"))), "seal_model_mismatch", True),
        finding(valid & c("seal.requestDigest").isNotNull() & ~c("seal.requestDigest").eqNullSafe(c("request_digest")), "request_modified", False),
        finding(~endpoint, "endpoint_not_authorized", True),
    ))
    unattributed = status.isin("seal_key_compromised", "seal_key_retired")
    unbound = yes(c("unknown_binding"))
    attribution = F.when(unbound, "none").when(equal & ~yes(sealed & unattributed), "confirmed").when(equal, "unconfirmed").when(digests, "none").when(entry, "unconfirmed").otherwise("none")
    codes = stage.free_name(rows, "findings")
    return rows.withColumn(codes, found).withColumn(
        "verdict",
        F.struct(
            (~F.exists(codes, lambda f: f["refuses"])).alias("passed"), sealed.alias("seal_present"), (valid & ~unbound).alias("seal_valid"),
            endpoint.alias("endpoint_authorized"), attribution.alias("attribution"), F.transform(codes, lambda f: f["code"]).alias("findings"),
        ),
    ).select(*columns, "verdict")
