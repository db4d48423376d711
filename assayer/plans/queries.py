"""The engine's operators over the driver's tables, one query each.

Bindings: ``documents`` are responses (provider = source), ``events`` a time-stamped ledger (provider =
user; errors and slow views carry flags), ``conversations`` transcripts, ``pages`` contacted URLs,
``supplier`` and ``nation`` register entries with standing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import api, schemas
from assayer.functions import digests, ed25519, flags, urls, wire
from assayer.operators import gate, ledger, notices, policy, scoring, verdict, views
from assayer.sources import tables
from assayer.sources.documents import DEFAULT_POLICY, TAXONOMY

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

WARN, BLOCK, LAST = 4, 8, 10
DAY = "2024-01-15"

BATCH = {"version": "1", "trafficClass": "test", "windowStart": "2024-01-10", "windowEnd": "2024-01-20", "evaluatorVersion": "e1", "taxonomyVersion": "t1"}
#: The secret seed of test 2 of RFC 8032, section 7.1; a fixed value.
SEED = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
OVERLAY: dict[str, Any] = {
    "id": "example",
    "categoryTreatments": {"slow_view": {"severityFloor": 2, "status": "in_force"}, "service_error": {"severityFloor": 3, "status": "pending"}},
    "thresholdOverrides": {"warn": 3, "status": "in_force"},
    "modeFloor": "annotate",
    "minorOnly": {"status": "in_force", "thresholdOverrides": {"block": 6}, "modeFloor": "enforce", "categoryTreatments": {"service_error": {"nonReleasable": True}}},
    "provenance": {"unsealedTreatment": "notice", "status": "pending"},
}
AUTHORITY = DEFAULT_POLICY | {"releaseAuthority": {"default": "self_release", "byFlagType": {"service_error": "custodial_release", "slow_view": "self_release"}}}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as rows of a ledger before they are numbered (provider_id, response_id, at, at_iso, outcome, score, flags, versions)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    error = F.col("event_type") == "error"
    slow = (F.col("event_type") == "view") & (F.col("value") > 60)
    severity = F.when(error, F.when(F.col("value") >= 100, 3).when(F.col("value") >= 40, 2).otherwise(1)).when(slow, 1)
    kind = F.when(error, "service_error").when(slow, "slow_view")
    ref = F.concat(F.lit("ev"), F.col("event_id").cast("string"))
    none = F.array().cast("array<struct<type: string, severity: int, evidence_ref: string>>")
    found = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("type"), severity.cast("int").alias("severity"), ref.alias("evidence_ref")))).otherwise(none)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response_id"),
        "event_id", "at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at_iso"),
        F.when(error, "withhold").otherwise("deliver").alias("outcome"), F.coalesce(severity, F.lit(0)).cast("decimal(18,4)").alias("score"),
        found.alias("flags"), F.lit("e1").alias("evaluator_version"), F.lit("t1").alias("taxonomy_version"), "event_type", "value",
    )


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with seq, a provider's rows split by day while they are numbered."""
    return ledger.numbered(event_rows(spark, sf_dir), "at", "event_id", part=F.to_date("at"))


def _flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("provider_id"), flags.flags(F.coalesce("text", F.lit("")), TAXONOMY).alias("flags"))


# Taxonomy scan


@query
def flag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _flagged_documents(spark, sf_dir)
    return d.select("doc_id", F.array_join(F.transform("flags", lambda f: f["type"]), ",").alias("types"), F.array_join(F.transform("flags", lambda f: f["basis"]), ",").alias("basis"), flags.instant_score(F.col("flags")).alias("severity"))


@query
def flag_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _flagged_documents(spark, sf_dir).select("provider_id", F.explode("flags").alias("f"))
    return d.groupBy("provider_id", F.col("f.type").alias("type")).agg(F.count("*").alias("n"), F.sum("f.severity").alias("severity"))


@query
def evidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    criterion = TAXONOMY["flags"][1]["criteria"][0]
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(criterion["pattern"]))
    s = flags.spans(F.col("text"), criterion, flags.MAX_SPANS)
    return d.select("doc_id", F.posexplode(s).alias("at", "s")).select("doc_id", F.col("at").cast("long").alias("at"), F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.col("s.text").alias("span_text"))


@query
def benchmark_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place of a model's excerpt in the evaluated text; excerpts that aren't there are dropped and the flag stays."""
    lab = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0")
    d = table(spark, sf_dir, "documents").join(lab, "doc_id")
    excerpt = F.concat(F.substring("text", 11, 12), F.when(F.col("doc_id") % 3 == 0, "~absent~").otherwise(""))
    out = F.to_json(F.struct(F.array(F.struct(F.when(F.col("toxic") == 1, "secret").otherwise("not_a_type").alias("type"), F.lit("because").alias("reason"), F.array(excerpt).alias("evidence"))).alias("flags")))
    f = flags.model_flags(F.concat(F.lit("Verdict: "), out, F.lit(" end")), F.col("text"), TAXONOMY)
    return d.select("doc_id", F.explode(f).alias("f")).select("doc_id", "f.type", F.col("f.severity").cast("long").alias("severity"), "f.basis", F.size("f.evidence").cast("long").alias("n_spans"), F.get("f.evidence", F.lit(0))["start"].cast("long").alias("span_start"))


@query
def model_verdict_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside verdicts: unknown types go, severity is the taxonomy's, not the verdict's."""
    types = spark.createDataFrame([(f["type"], int(f["severity"])) for f in TAXONOMY["flags"]], "type string, severity long")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.when(F.col("toxic") == 1, "secret").otherwise("unknown_type"), F.when(F.col("quality") == 0, "shouting"))).alias("type"))
    return lab.join(F.broadcast(types), "type").select("doc_id", "type", "severity")


# Rolling scores


@query
def window_score_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST)
    return out.select("provider_id", "seq", "instant_score", "window_score", "window_size")


@query
def window_score_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.time_window(scoring.with_instant(events_ledger(spark, sf_dir)), 24)
    return out.select("provider_id", "seq", "instant_score", "window_score", "window_size")


@query
def session_scope_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten rows first, then those of the session (a day)."""
    out = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST, F.date_trunc("day", F.col("at")))
    return out.select("provider_id", "seq", "window_score", "window_size")


@query
def band_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to flags, rolling score and band: the flagship."""
    rows = ledger.numbered(scoring.with_instant(_flagged_documents(spark, sf_dir)), "doc_id", part=F.floor(F.col("doc_id") / ledger.PART_ROWS))
    out = scoring.count_window(rows, LAST).withColumn("score", F.col("window_score") + F.col("instant_score"))
    return out.select("provider_id", "seq", "doc_id", "score", scoring.band(F.col("score"), F.lit(WARN), F.lit(BLOCK)).alias("band"), scoring.meter_scale(F.col("score"), F.lit(BLOCK).cast("long")).alias("meter"))


def _counts_text(counts: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query
def rates_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, until = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    out = scoring.rates(event_rows(spark, sf_dir).select("provider_id", "at", "flags"), since, until, 20)
    return out.withColumn("flag_counts", _counts_text(F.col("flag_counts")))


@query
def export_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_rows(spark, sf_dir).select("provider_id", "at", "flags")
    rated = scoring.rates(own, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 20)
    return scoring.export_view(rated.withColumn("incident_rate", F.lit(None).cast("double")), own)


@query
def telemetry_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header row, then each provider's payload."""
    rated = scoring.rates(event_rows(spark, sf_dir).select("provider_id", "at", "flags"), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 20)
    return scoring.batch(rated.withColumn("incident_rate", F.lit(None).cast("double")), BATCH)


@query
def telemetry_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed batch as it arrives: every third user's payload was changed on the way."""
    rated = scoring.rates(event_rows(spark, sf_dir).select("provider_id", "at", "flags"), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 20)
    sent = scoring.signed_batch(rated.withColumn("incident_rate", F.lit(None).cast("double")), BATCH, SEED)
    third = F.substring("provider_id", 2, 20).cast("long") % 3 == 0
    arrived = sent.withColumn("payload", F.when(third, F.replace("payload", F.lit('"evaluatedResponses":'), F.lit('"evaluatedResponses":1'))).otherwise(F.col("payload")))
    return scoring.checked_batch(arrived, ed25519.pem_of(ed25519.public_key(SEED)))


@query
def signed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each supplier with a detached signature and the pinned key: some were changed after signing, some keys are another's."""
    k = F.col("s_suppkey")
    own, other = (ed25519.pem_of(ed25519.public_key(seed)) for seed in (SEED, SEED[::-1]))
    doc = F.to_json(F.struct(F.col("s_name").alias("registerEntryId"), F.col("s_nationkey").alias("nation")))
    sealed = ed25519.dealt(table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("document")), "s_suppkey").withColumn("signature", ed25519.signature(F.col("document"), SEED))
    read = sealed.select("s_suppkey", F.when(k % 5 == 0, F.concat("document", F.lit(" "))).otherwise(F.col("document")).alias("document"), F.when(k % 11 == 0, F.substring("signature", 2, 90)).otherwise(F.col("signature")).alias("signature"), F.when(k % 7 == 0, other).otherwise(own).alias("pem"))
    return read.select("s_suppkey", F.sha2("document", 256).alias("document_sha256"), ed25519.signature_valid(F.col("pem"), F.col("document"), F.col("signature")).alias("signature_valid"))


@query
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = policy.blocks(*_block_events(spark, sf_dir)).where("released_at is null").groupBy("provider_id").agg(F.count("*").alias("open_blocks"))
    rated = scoring.rates(event_rows(spark, sf_dir).select("provider_id", "at", "flags"), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 20)
    withheld = views.total_withheld(open_).select(F.lit("withheld").alias("name"), F.col("total_withheld").alias("n"))
    return withheld.union(views.largest_count(rated).select(F.lit("largest_count"), "largest"))


# Ledger scans and chain


@query
def ledger_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.heads(events_ledger(spark, sf_dir)).select("provider_id", "seq", "response_id", "outcome")


@query
def ledger_recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(event_rows(spark, sf_dir), 3, "at", "event_id").select("provider_id", "seq", "response_id")


@query
def ledger_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.between(events_ledger(spark, sf_dir), F.lit(DAY).cast("timestamp"), F.lit("2024-01-16").cast("timestamp"))
    return out.select("provider_id", "seq", "response_id", "at_iso")


@query
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts(event_rows(spark, sf_dir))


@query
def ledger_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir)
    return ledger.after_reset(rows, rows.where("event_type = 'signup'").select("provider_id", "seq")).select("provider_id", "seq")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.appended(events_ledger(spark, sf_dir))


@query
def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chained(spark, sf_dir).select("provider_id", "seq", "prev_hash", "hash")


@query
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.verify(_chained(spark, sf_dir))


@query
def chain_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome is changed in every ledger of more than 40 rows, at row 7."""
    rows = _chained(spark, sf_dir)
    long_ = ledger.counts(rows).where("n_rows > 40").select("provider_id", F.lit(7).cast("long").alias("seq"), F.lit(True).alias("long"))
    changed = rows.join(long_, ["provider_id", "seq"], "left").withColumn("outcome", F.when(F.col("long"), "refuse").otherwise(F.col("outcome")))
    return ledger.verify(changed.drop("long"))


# Lookups and precedence


def _register(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("good", "elevated_scrutiny", "excluded")]), (k % 3 + 1).cast("int"))
    entries = s.where(k % 7 != 0).select(F.col("s_name").alias("registerEntryId"), state.alias("state"), (k % 50).cast("int").alias("quorumSources"), F.when(k % 2 == 0, F.array(F.lit("N1"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))).alias("excludedInJurisdictions"))
    providers = s.select(F.col("s_name").alias("register_entry_id"), F.concat(F.lit("N"), F.pmod(F.col("s_nationkey"), F.lit(3)).cast("string")).alias("jurisdiction"))
    return providers, entries


@query
def standing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers, entries = _register(spark, sf_dir)
    return policy.standing(providers, entries, F.col("jurisdiction"), 25)


@query
def seeded_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers, entries = _register(spark, sf_dir)
    rated = policy.standing(providers, entries, F.col("jurisdiction"), 25).select(F.concat(F.lit("u"), F.regexp_extract("register_entry_id", "([0-9]+)$", 1).cast("long").cast("string")).alias("provider_id"), "standing")
    rows = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST).join(rated, "provider_id", "left").withColumn("standing", F.coalesce("standing", F.lit("unknown")))
    return rows.select("provider_id", "seq", "standing", scoring.total(F.col("standing"), DEFAULT_POLICY).alias("score"))


@query
def severity_floor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir).where(F.size("flags") > 0)
    raised = policy.floored(F.col("flags"), policy.treatments(OVERLAY, False))
    return rows.select("response_id", F.get("flags", F.lit(0))["severity"].cast("long").alias("severity"), F.get(raised, F.lit(0))["severity"].cast("long").alias("raised"))


@query
def worst_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir)
    # The gravest of a day is the gravest of its rows': ranks are compared in tasks before the shuffle.
    ranked = lambda found=None: F.max(F.array_position(F.array(*map(F.lit, schemas.AUTHORITIES)), policy.worst_authority(F.col("flags"), AUTHORITY, found)))
    by_day = rows.groupBy("provider_id", F.to_date("at").alias("day")).agg(ranked().alias("own"), ranked(policy.treatments(OVERLAY, True)).alias("minor"))
    named = lambda c: F.element_at(F.array(*map(F.lit, schemas.AUTHORITIES)), F.col(c).cast("int"))
    return by_day.select("provider_id", F.col("day").cast("string").alias("day"), named("own").alias("authority"), named("minor").alias("authority_minor"))


@query
def effective_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4 == 0).alias("minor"))
    warn, block = (lambda i: policy.by_age(F.col("minor"), lambda m: int(policy.thresholds(OVERLAY, DEFAULT_POLICY, m)[i])))(0), (lambda i: policy.by_age(F.col("minor"), lambda m: int(policy.thresholds(OVERLAY, DEFAULT_POLICY, m)[i])))(1)
    return c.select("c_custkey", "minor", warn.cast("long").alias("warn"), block.cast("long").alias("block"), policy.by_age(F.col("minor"), lambda m: policy.mode(OVERLAY, "observe", m)).alias("mode"))


def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlay document for each nation, as JSON text: provisions of every kind, pending in some nations."""
    k, status = F.col("n_nationkey"), lambda m: F.when(F.col("n_nationkey") % m == 0, "pending").otherwise("in_force")
    treatments = F.map_from_arrays(F.array(F.lit("slow_view"), F.concat(F.lit("of_"), F.lower("n_name"))), F.array(F.struct(status(2).alias("status")), F.struct(status(3).alias("status"))))
    document = F.struct(
        F.array(F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"), status(5).alias("status"))).alias("notices"), treatments.alias("categoryTreatments"),
        F.when(k % 4 != 1, F.struct(status(8).alias("status"))).alias("thresholdOverrides"), F.when(k % 3 != 1, "annotate").alias("modeFloor"), status(7).alias("modeFloorStatus"), F.struct(status(11).alias("status")).alias("provenance"),
    )
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 9 != 8, F.to_json(document)).otherwise("{broken").alias("document"))


@query
def pending_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _overlays(spark, sf_dir)
    return o.select("n_nationkey", F.array_join(policy.pending_of(F.col("document")), ",").alias("pending"))


def _block_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events_ledger(spark, sf_dir)
    raises = rows.where("event_type = 'error'").select("provider_id", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")).alias("response_id"), F.when(F.col("value") > 100, "non_releasable").when(F.col("value") > 40, "custodial_release").otherwise("self_release").alias("authority"), F.col("at").alias("raised_at"))
    releases = rows.where("event_type = 'purchase'").select("provider_id", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string")).alias("response_id"), F.col("at").alias("released_at"), F.lit("self").alias("released_by"))
    return raises, releases


@query
def open_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = policy.blocks(*_block_events(spark, sf_dir))
    return b.where("released_at is null").select("provider_id", "response_id", "authority", F.unix_micros("raised_at").alias("raised_us"))


@query
def release_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = policy.blocks(*_block_events(spark, sf_dir))
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    asked = u.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("provider_id"), F.explode(F.array(*[F.lit(f"b{i}") for i in range(5)])).alias("response_id"), F.when(F.col("user_id") % 2 == 0, "self").otherwise("custodian").alias("actor"), (F.col("user_id") % 3 > 0).alias("adult"))
    return policy.release(b, asked).select("provider_id", "response_id", "released", "reason")


@query
def monitor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir)
    usual = typical_duration_median(spark, sf_dir).where("model = 'view'")
    out = scoring.monitor_state(rows, policy.blocks(*_block_events(spark, sf_dir)), ledger.verify(_chained(spark, sf_dir)), typical=usual)
    return out.withColumn("flag_counts", _counts_text(F.col("flag_counts")))


# URLs, seals, verdicts


@query
def endpoint_authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    base = F.concat(F.lit("http://"), host, F.when(F.col("page_id") % 2 == 0, ":80/en/").otherwise("/fr"))
    return p.select("page_id", urls.endpoint_matches(base, F.col("url")).alias("authorized"), urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"))


@query
def forbidden_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    hosts = F.element_at(F.array(*[F.lit(h) for h in ("localhost", "a.localhost", "10.1.2.3", "172.16.0.9", "172.32.0.9", "192.168.1.1", "169.254.0.1", "8.8.8.8", "fd00::1", "fe80::1", "::1", "2001:db8::1", "example.com", "0.0.0.0", "127.9.9.9", "999.1.1.1")]), (k % 16 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", hosts.alias("host"), urls.forbidden_host(hosts).alias("forbidden"))


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sealed responses: signed some time before or after receipt, by keys of every status."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    received = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    signed = F.date_format(F.timestamp_seconds(F.unix_seconds("at") + (n % 11 - 5) * 900), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", received.alias("received_at"), F.when(n % 97 == 0, "not a time").otherwise(signed).alias("signed_at"))


@query
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir).select("event_id", verdict.freshness(F.col("signed_at"), F.col("received_at")).alias("finding"))


@query
def key_status_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("current", "rotating", "retired", "compromised", "lost")]), (F.col("event_id") % 5 + 1).cast("int"))
    return _sealed(spark, sf_dir).select("event_id", status.alias("status"), verdict.key_status(status, F.lit("2024-01-15T00:00:00Z"), F.col("signed_at")).alias("finding"))


@query
def verdict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v) for v in values]), (n % m + 1).cast("int"))
    ids = ["e0", "e1", "e2"]
    keys = [{"selector": "k0", "publicKeyPem": "", "status": "current", "retiredAt": None}, {"selector": "k1", "publicKeyPem": "", "status": "retired", "retiredAt": "2024-01-15T00:00:00Z"}, {"selector": "k2", "publicKeyPem": "", "status": "compromised", "retiredAt": None}]
    entries = spark.createDataFrame(
        [(i, "P" + i, "revoked" if i == "e2" else "active", ["https://api.example.com/v1"], ["m0", "m1"], "all" if i == "e1" else "some", "chat-delta", None, keys) for i in ids],
        "id string, providerIdentity string, status string, authorizedEndpoints array<string>, models array<string>, sealPolicy string, contentBinding string, identityDomain string, keys array<struct<selector: string, publicKeyPem: string, status: string, retiredAt: string>>",
    )
    entry = pick(["e0", "e1", "e2", "e9", None], 5)
    seal = F.when(n % 4 != 0, F.struct(entry.alias("registerEntryId"), pick(["k0", "k1", "k2", "k7"], 4 * 5 // 5).alias("selector"), pick(["m0", "m1", "m2"], 3).alias("model"), F.concat(F.lit("P"), F.when(n % 13 == 0, "x").otherwise(F.coalesce(entry, F.lit("")))).alias("providerIdentity"), F.lit("x").alias("exchangeId"), F.when(n % 17 == 0, "other").alias("requestDigest"), F.col("signed_at").alias("signedAt")))
    rows = _sealed(spark, sf_dir).select(
        "event_id", entry.alias("register_entry_id"), seal.alias("seal"), "received_at", F.when(n % 19 == 0, "y").otherwise("x").alias("exchange_id"), F.lit("d").alias("request_digest"),
        F.when(n % 23 == 0, "https://api.example.com/v1evil").otherwise("https://api.example.com/v1/chat").alias("served_from"), (n % 29 == 0).alias("multiple_seals"), F.lit(False).alias("seal_duplicate_member"), F.lit(False).alias("seal_decode_failed"),
        (n % 31 == 0).alias("content_after_seal"), (n % 37 == 0).alias("unknown_binding"), (n % 7 != 0).alias("signature_valid"), F.when(n % 3 == 0, "g").alias("dns_digest"), F.when(n % 3 == 0, F.when(n % 41 == 0, "h").otherwise("g")).alias("computed_digest"),
    )
    out = verdict.verdicts(verdict.looked_up(rows, entries))
    return out.select("event_id", "verdict.passed", "verdict.seal_present", "verdict.seal_valid", "verdict.endpoint_authorized", "verdict.attribution", F.array_join("verdict.findings", ",").alias("findings"))


@query
def key_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", "s_suppkey")
    pem = F.concat(F.lit("-----BEGIN PUBLIC KEY-----\n"), F.base64(F.encode("s_name", "UTF-8")), F.lit("\n-----END PUBLIC KEY-----\n"))
    keys = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("selector"), pem.alias("publicKeyPem"))).alias("keys"))
    return keys.select("s_nationkey", digests.key_set_digest(F.col("keys")).alias("digest"))


@query
def request_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digests.request_digest(F.col("text")).alias("digest"))


@query
def txt_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["v=b1; e=one; k=abc", "e=one; v=b1", "v=b1; e=", "v=b1;e=a;e=b", "v=b1;e=a;r=http://x.example", "v=b1;e=a;r=https://10.0.0.1/x", "v=b1;e=a;r=https://x.example/reg", "v=b1;nonsense", "", "v=b1;e=a;r=::"]
    k = F.col("s_suppkey")
    payload = F.element_at(F.array(*[F.lit(c) for c in cases]), (k % len(cases) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", payload.alias("payload"), wire.txt_binding(payload, "b1").alias("b")).select("s_suppkey", "b.ok", "b.reason", "b.entry_id", "b.register_url", "b.key_set_digest")


# Transcripts, durations, streams


@query
def transcript_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.col("turn").alias("ingest_id"), "role", F.col("text").alias("content"))
    return tables.history(c).select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "role", F.length("content").cast("long").alias("n_chars"))


@query
def residency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))


@query
def typical_duration_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_ledger(spark, sf_dir)
    return scoring.typical_duration(rows.select("provider_id", F.col("event_type").alias("model"), "at", "response_id", F.floor(F.col("value") * 10).cast("long").alias("duration_ms")))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an event stream: a delta for each turn, a seal at the end; every fifth goes on after it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    delta = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), F.to_json(F.array("text")), F.lit("}}]}"))
    delta = F.regexp_replace(F.regexp_replace(delta, r'"content":\[', '"content":'), r"\]\}\}\]\}$", "}}]}")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", delta.alias("d")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r["d"]), "\n\n").alias("b"))
    late = F.when(F.col("conv_id") % 5 == 0, 'data: {"choices":[{"delta":{"content":"late"}}]}\n\n').otherwise("")
    return whole.select("conv_id", F.concat("b", F.lit("\n\nevent: seal\ndata: s"), F.col("conv_id").cast("string"), F.lit("\n\n"), late, F.lit('data: {"choices":[]}\n\ndata: [DONE]\n\n')).alias("body"))


@query
def sse_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wire.accumulated(_streams(spark, sf_dir), "chat-delta", key="conv_id")
    return out.select("conv_id", F.length("sealed_content").cast("long").alias("n_chars"), F.sha2("sealed_content", 256).alias("sha256"), "terminal_seal", "content_after_seal", "several_seals")


@query
def notice_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("order_id"), (F.col("event_type") == "error").alias("in_warn_band"))
    found = notices.raised(rows, [{"id": "start", "trigger": "session_start", "repeatMinutes": 2880}, {"id": "warn", "trigger": "on_warn"}])
    return found.select(F.col("order_id").alias("event_id"), F.array_join("raised", ",").alias("raised"))


@query
def arrival_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each minute of the real clock as a millisecond."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000).cast("long").alias("at_ms"), F.col("event_id").alias("order_id"))
    return notices.arrival_levels(e).select(F.col("order_id").alias("event_id"), F.round("level", 6).alias("level"))


@query
def gate_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST)
    refused = F.col("value") > 250
    # A refused response isn't scanned: no flags of its own, and it counts as clean.
    fixed = gate.fixed_outcome(F.lit("good"), ~refused, F.lit(True), F.lit(None), F.lit("enforce"), True, "ignore")
    given = rows.withColumns({"score": F.col("window_score") + F.col("instant_score"), "warn": F.lit(WARN), "block": F.lit(BLOCK), "mode": F.lit("enforce"), "fixed": fixed, "n_flags": F.size("flags"), "sent": F.lit(True)})
    out = gate.decisions(given, DEFAULT_POLICY)
    return out.select("provider_id", "seq", F.col("score").cast("long").alias("score"), "outcome", F.col("effective_warn").cast("long").alias("effective_warn"), F.col("effective_block").cast("long").alias("effective_block"), F.col("clean_remaining").cast("long").alias("clean_remaining"))


@query
def refusal_without_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An excluded provider's response is never sent: it is refused with no effect on the carryover."""
    rows = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST)
    excluded = F.col("value") > 250
    fixed = gate.fixed_outcome(F.when(excluded, "excluded").otherwise("good"), F.lit(True), F.lit(True), F.lit(None), F.lit("enforce"), True, "ignore")
    given = rows.withColumns({"score": F.col("window_score") + F.col("instant_score"), "warn": F.lit(WARN), "block": F.lit(BLOCK), "mode": F.lit("enforce"), "fixed": fixed, "n_flags": F.size("flags"), "sent": ~excluded})
    out = gate.decisions(given, DEFAULT_POLICY)
    return out.select("provider_id", "seq", "outcome", F.col("clean_remaining").cast("long").alias("clean_remaining"))


@query
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the gate but the carryover, with its reasons and notices."""
    rows = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST)
    n = F.col("event_id")
    standing = F.when(n % 11 == 0, "excluded").otherwise("good")
    passed, sealed = n % 13 != 0, n % 4 != 0
    mandatory = F.when((F.col("event_type") == "error") & (F.col("value") > 200), "service_error")
    mode = F.element_at(F.array(F.lit("enforce"), F.lit("annotate"), F.lit("observe")), (n % 3 + 1).cast("int"))
    score, warn, block = F.col("window_score") + F.col("instant_score"), F.lit(WARN), F.lit(BLOCK)
    why = gate.reasons(standing, passed, sealed, mandatory, mode, True, "notice", score, warn, block)
    fixed = gate.fixed_outcome(standing, passed, sealed, mandatory, mode, True, "notice")
    late = F.when(score >= block, F.when(mode == "annotate", "deliver_with_notice").otherwise("withhold")).when(score >= warn, "deliver_with_notice").otherwise("deliver")
    out = rows.select("event_id", F.coalesce(fixed, late).alias("outcome"), why.alias("why"))
    return out.select("event_id", "outcome", F.array_join("why", ",").alias("reasons"), F.array_join(gate.notices(F.col("why"), F.col("outcome")), ",").alias("notices"))


@query
def gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of the gate: outcome after carryover, reasons and notices in their order; a provider is a session."""
    rows = scoring.count_window(scoring.with_instant(events_ledger(spark, sf_dir)), LAST)
    n = F.col("event_id")
    rules = DEFAULT_POLICY | {"notices": [{"id": "start", "trigger": "session_start", "repeatMinutes": 2880}, {"id": "warn", "trigger": "on_warn"}]}
    overlay = {"id": "example", "notices": [{"id": "local", "trigger": "always"}, {"id": "later", "trigger": "always", "status": "pending"}], "provenance": {"unsealedTreatment": "notice", "status": "in_force"}}
    out = api.resolve(rows, F.col("provider_id"), F.when(F.col("value") > 250, "excluded").otherwise("good"), n % 13 != 0, n % 4 != 0, rules=rules, overlay=overlay)
    return out.select("provider_id", "seq", "outcome", F.col("clean_remaining").cast("long").alias("clean_remaining"), F.array_join("reasons", ",").alias("reasons"), F.array_join("notices", ",").alias("notices"))


@query
def mandatory_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flag of a document that is never delivered."""
    never = policy.treatments({"categoryTreatments": {t: {"mandatoryNonDelivery": True} for t in ("network_address", "secret", "shouting")}}, False)
    return _flagged_documents(spark, sf_dir).select("doc_id", policy.first_mandatory(F.col("flags"), never).alias("mandatory"))


@query
def dns_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register entries that TXT records name, before the configured ones."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("provider_id"), F.concat(F.lit("own-"), F.col("s_nationkey").cast("string")).alias("register_entry_id"))
    record = F.concat(F.lit("v=b1; e=dns-"), F.col("provider_id"), F.when(k % 4 == 0, "; k=abc").otherwise(""))
    read = s.where(k % 3 != 0).select("provider_id", wire.txt_binding(F.when(k % 5 != 0, record).otherwise("e=none"), "b1").alias("b")).where("b.ok")
    return api.confirmed_entry(s, read.select("provider_id", "b.entry_id", "b.key_set_digest")).select("s_suppkey", "register_entry_id", "dns_digest")


@query
def export_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would leave beside what stays, with the sealed sizes of conversations and evidence."""
    key = F.lit(bytes(range(32)))
    turns = table(spark, sf_dir, "conversations").select(digests.sealed(F.col("text"), key).alias("sealed"))
    spans = event_rows(spark, sf_dir).where(F.size("flags") > 0).select(F.col("flags").alias("spans"), digests.sealed(F.col("response_id"), key).alias("sealed"))
    out = scoring.export_summary(export_view(spark, sf_dir), turns, spans, ["https://evaluator.example"])
    # 12 bytes of nonce and 16 of tag, in base64.
    return out.select("providers", "would_leave_bytes", "ledger_rows", "transcript_turns", "evidence_spans", (F.col("sealed_bytes") > 28 * F.col("transcript_turns")).alias("sealed"), F.array_join("outbound_paths", ",").alias("outbound"))


@query
def trail_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a user's day one after the other, from marks of which one may be skipped, and the settled trail."""
    n = F.col("event_id")
    stage_of = F.get(F.array(*map(F.lit, views.MARK_OF_STAGE)), (n % len(views.MARK_OF_STAGE)).cast("int"))
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", stage_of.alias("stage"), "value")
    days = e.groupBy("user_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "stage"))), lambda x: x["stage"]).alias("stages"), F.max("value").alias("most"))
    start = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("pending"), F.lit("pending"), F.lit("skipped"))).otherwise(F.array().cast("array<string>"))
    marks = days.select("user_id", "day", "most", views.trail_reduced(start, F.col("stages")).alias("m"))
    outcome = F.when(F.col("most") > 150, "refuse").when(F.col("most") > 80, "withhold").otherwise("deliver")
    settled = views.trail_settled(F.col("m"), outcome, F.col("most") < 120, F.lit(False), F.col("user_id") % 2 == 0)
    return marks.select("user_id", "day", F.array_join("m", ",").alias("marks"), F.array_join(settled, ",").alias("settled"))


# Stores


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("at"))


@query
def settings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(_settings(spark, sf_dir), "key", "at").select("key", "value")


@query
def setting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.setting(_settings(spark, sf_dir), "u1").select("key", "value")


@query
def setting_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.setting_keys(_settings(spark, sf_dir))


@query
def ledger_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.providers(events_ledger(spark, sf_dir))


@query
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select(F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("ref"), F.col("props").alias("spans"))
    return tables.evidence_of(events_ledger(spark, sf_dir), held).select("provider_id", "seq", "type", "ref", "spans")


@query
def residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"))
    held = table(spark, sf_dir, "events").select(F.struct("props").alias("spans"))
    return tables.residency(c, held)


@query
def keys_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot reload: suppliers that a fresh document no longer has."""
    current = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return tables.replace_if_changed(current, current.where("s_suppkey % 3 <> 0"), "s_suppkey")[1]


@query
def sealed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-GCM and back for every text; another key opens nothing."""
    key, other = F.lit(bytes(range(32))), F.lit(bytes(32))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", digests.sealed(F.col("text"), key).alias("sealed"))
    return c.select("conv_id", "turn", F.sha2(digests.opened(F.col("sealed"), key), 256).alias("opened_sha256"), digests.opened(F.col("sealed"), other).isNull().alias("refused"))


@query
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound documents, a repeated member and trailing content."""
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.col("props")).when(n % 3 == 1, F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "a": 1}'))).otherwise(F.concat("props", F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", wire.json_code(text).alias("code"))


# The host's answers


@query
def pinned_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 7).cast("string")).alias("id"), F.struct("ts", "event_id").alias("raised_at"))
    return api.pinned(e).select("id", F.col("raised_at.event_id").alias("first_event"))


@query
def self_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the evaluator's own origin."""
    pages = table(spark, sf_dir, "pages")
    origin = urls.origin(F.col("url"))
    least = pages.agg(F.min(origin).alias("evaluator"))
    return policy.origin_conflicts(F.col("evaluator"), pages.join(F.broadcast(least), F.lit(True)), origin).select("page_id", "evaluator")


@query
def released_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withheld responses that were released, with their text."""
    rows = events_ledger(spark, sf_dir)
    released = rows.where("value > 100").select("provider_id", "response_id")
    texts = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("content"))
    return api.withheld_content(rows, released, texts).select("provider_id", "response_id", "content")


# Settings, displays and wire forms


@query
def transport_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    binding = F.when(k % 3 == 0, "chat-delta").when(k % 3 == 1, "strange")
    return table(spark, sf_dir, "supplier").select("s_suppkey", policy.transport(F.when(k % 4 != 0, F.col("s_name")), binding, list(wire.BINDINGS), "content-block-delta").alias("transport"))


@query
def setting_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("c_custkey") % 3 == 0, "on")
    return table(spark, sf_dir, "customer").select("c_custkey", policy.setting("off", True, stored).alias("locked"), policy.setting("off", False, stored).alias("free"))


@query
def release_affordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = policy.blocks(*_block_events(spark, sf_dir)).where("released_at is null")
    offered = lambda custodian: policy.release_offered(F.col("authority"), F.lit(custodian))
    return b.select("provider_id", "response_id", offered(False).alias("own"), offered(True).alias("custodian"))


@query
def delivery_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    found = F.array(*[F.struct(F.lit(s).alias("source"), F.concat(F.lit(i), (n % 4).cast("string")).alias("id")) for s, i in (("monitor", "a"), ("policy", "b"), ("monitor", "c"))])
    outcome = F.when(n % 3 == 0, "deliver_with_notice").when(n % 3 == 1, "deliver").otherwise("withhold")
    shown = F.transform(views.delivery_notices(outcome, found), lambda x: x["id"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(shown, ",").alias("shown"))


@query
def notice_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, raised = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    window = F.when(n % 4 != 0, n % 50)
    return table(spark, sf_dir, "events").select("event_id", notices.still_displayed(window, raised, raised + n % 3600 * 1000).alias("displayed"))


@query
def compose_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed characters, words and pastes; each minute of the real clock as a millisecond."""
    n = F.col("event_id")
    bump = notices.compose_bump(F.when(n % 3 == 0, "char").when(n % 3 == 1, "word").otherwise("paste"), F.col("props"))
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), at.alias("at_ms"), n.alias("order_id"), bump.alias("bump"))
    out = notices.arrival_levels(rows, notices.COMPOSE_HALF_LIFE_MS)
    return out.select(F.col("order_id").alias("event_id"), F.round(notices.clamped(F.col("level")), 6).alias("level"))


@query
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (n % 5).alias("standing_ms"), (n % 700).alias("provider_ms"), F.when(n % 6 != 0, n % 40).alias("evaluate_ms"), (n % 800).alias("total_ms"))
    return scoring.stage_times(rows, ["standing_ms", "provider_ms", "evaluate_ms"]).select("event_id", "parts_ms", "covered")


@query
def trail_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of exchanges at every stage, and of finished ones."""
    n = F.col("event_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    marks = views.trail(pick(list(views.MARK_OF_STAGE)), pick([None, "deliver", "deliver_with_notice", "withhold", "refuse"]), n % 7 == 0, n % 3 == 0)
    rows = table(spark, sf_dir, "events").select("event_id", marks.alias("m"))
    return rows.select("event_id", F.array_join("m", ",").alias("marks"), views.halted(F.col("m")).alias("halted"), views.complete(F.col("m")).alias("complete"))


@query
def outbound_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    base = F.when(k % 3 == 0, "http://localhost:9000/x").when(k % 3 == 1, "http://[::1]/v1").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.outbound_paths(base), ",").alias("paths"), urls.basename(F.col("url")).alias("base_name"))


@query
def seal_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seal as a header and back; two seals in one header are told apart from one."""
    k = F.col("s_suppkey")
    header = wire.encoded(F.struct(F.col("s_name").alias("registerEntryId"), F.lit("k1").alias("selector"), F.concat(F.lit("m>?"), k.cast("string")).alias("model")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", header.alias("one"))
    sent = F.when(k % 2 == 0, F.concat("one", F.lit(","), "one")).otherwise(F.col("one"))
    return rows.select("s_suppkey", wire.decoded_seal(F.col("one"))["registerEntryId"].alias("entry"), wire.decoded_seal(F.col("one"))["model"].alias("model"), wire.several_seals(sent).alias("several"))


@query
def seal_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = digests.seal_payload("demo-seal", [F.col("role"), F.col("conv_id").cast("string")], F.col("text"))
    pre = digests.pre_seal_payload("demo-pre-seal", [F.col("role"), F.col("turn").cast("string")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(payload, 256).alias("payload_sha256"), F.sha2(pre, 256).alias("pre_sha256"), digests.one_line(F.col("text")).alias("one_line"))


@query
def evaluator_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(flags.prompt(TAXONOMY, F.col("text")), 256).alias("prompt_sha256"))


@query
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as scripted chunks of bytes, put together and read again."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("exchange_id"), "text")
    out = wire.accumulated(wire.whole_chunks(views.scripted_deltas(c)), "chat-delta")
    return out.select("exchange_id", F.sha2("sealed_content", 256).alias("text_sha256"), F.col("terminal_seal").isNull().alias("unsealed"))


@query
def scripted_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's calls answered from a script of as many responses as the user's number says; the last one repeats."""
    script = F.slice(F.array(F.lit("one"), F.lit("two"), F.lit("three")), F.lit(1), (F.col("user_id") % 3 + 1).cast("int"))
    return views.scripted(table(spark, sf_dir, "events").select("event_id", "user_id"), script, "user_id", "event_id").select("event_id", "text")


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = wire.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, "").eqNullSafe(F.col("text")).alias("whole"))
