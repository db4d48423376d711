"""Rolling scores over a provider's ledger, standing seeds, bands and rates."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from assayer.functions import ed25519
from assayer.functions.flags import instant_score
from assayer.operators.ledger import PART_ROWS
from assayer.plans import ordered, parts, stage
from assayer.sources.tables import holds_no_content

#: A response scored now may see rows up to a second later.
AHEAD_US = 1_000_000


def with_instant(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("instant_score", instant_score(F.col("flags")))


def count_window(ledger: DataFrame, n: int = 10, session_start: Column | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """window_score and window_size over the ``n`` rows before each; a session's start cuts them after the last ``n`` are taken.

    A provider's rows are split in parts of ``part_rows`` numbers, so a hot one is many tasks.
    """

    def measures(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-n, -1)
        if session_start is None:
            return {"window_score": F.coalesce(F.sum("instant_score").over(w), F.lit(0)), "window_size": F.count("*").over(w)}
        prior = F.filter(F.collect_list(F.struct("at", "instant_score")).over(w), lambda r: r["at"] >= session_start)
        return {"window_score": F.aggregate(prior, F.lit(0).cast("long"), lambda a, r: a + r["instant_score"]), "window_size": F.size(prior).cast("long")}

    return ordered.rolling(ledger, "provider_id", "seq", F.floor(F.col("seq") / part_rows), n, measures)


def time_window(ledger: DataFrame, hours: int = 24, session: Column | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """window_score and window_size over ``[at - hours, at + 1 s)`` without the row itself, within the session if there is one.

    Providers of up to ``part_rows`` rows take one shuffle (``_by_spans``); of longer ones even a single day is many tasks (``_by_ranges``).
    """
    span = hours * 3_600_000_000
    us, own_session = stage.free_name(ledger, "us"), stage.free_name(ledger, "session_of")
    rows = ledger.withColumn(us, F.unix_micros(F.col("at").cast("timestamp")))
    keys = ["provider_id"] if session is None else ["provider_id", own_session]
    rows = rows if session is None else rows.withColumn(own_session, session)
    out = parts.by_size(rows, "provider_id", part_rows, lambda r: _by_spans(r, keys, us, span), lambda r: _by_ranges(r, keys, us, span))
    return out.drop(us, own_session)


def _by_spans(own: DataFrame, keys: list[str], us: str, span: int) -> DataFrame:
    """Time cut in parts as long as the window; time and score of a row go to each part that can see it.  A sum
    is the difference of two running sums, which read each row once however many rows a window holds."""
    here, there = stage.free_name(own, "here"), stage.free_name(own, "there")
    part = lambda x: F.floor(x / span).cast("long")
    sent = own.withColumn(here, part(F.col(us))).withColumn(there, F.explode_outer(F.sequence(part(F.col(us) - (AHEAD_US - 1)), part(F.col(us) + span))))
    mine = F.col(here).eqNullSafe(F.col(there))
    kept = {*keys, us, here, there, "instant_score"}
    sent = sent.select(*[F.col(c) if c in kept else F.when(mine, F.col(c)).alias(c) for c in sent.columns])
    within = Window.partitionBy(*keys, there).orderBy(us)
    until, before = within.rangeBetween(Window.unboundedPreceding, AHEAD_US - 1), within.rangeBetween(Window.unboundedPreceding, -span - 1)
    # Rows without a time see one another and nothing else.
    early = lambda c: F.coalesce(F.when(F.col(us).isNotNull(), c.over(before)), F.lit(0))
    out = sent.withColumns({
        "window_score": F.sum("instant_score").over(until) - early(F.sum("instant_score")) - F.col("instant_score"),
        "window_size": F.count("*").over(until) - early(F.count("*")) - 1,
    })
    return out.where(mine).drop(here, there)


def _by_ranges(own: DataFrame, keys: list[str], us: str, span: int) -> DataFrame:
    """The same for hot providers: scores and the two ends of every row's window are points of one line, cut in ranges of equal size.

    Running sums within a range go on from the sums of earlier ranges; a row's score is the sum at its window's end less
    that before its start.  However many rows an hour holds, they are many ranges.
    """
    name = stage.free_name(own, "row")
    rows = stage.saved(own.withColumn(name, F.monotonically_increasing_id()))
    key = F.struct(*keys).alias("key")
    timed = rows.where(F.col(us).isNotNull()).select(name, key, F.col(us).alias("us"), F.col("instant_score").cast("long").alias("own"))
    none = F.lit(None).cast("long")
    ends = [timed.select("key", (F.col("us") + shift).alias("x"), F.lit(kind).alias("kind"), F.col(name).alias("of"), none.alias("own")) for kind, shift in ((1, AHEAD_US - 1), (2, -span - 1))]
    line = timed.select("key", F.col("us").alias("x"), F.lit(0).alias("kind"), none.alias("of"), "own").union(ends[0]).union(ends[1])
    # Saved with its range: a second run of the cut might cut elsewhere.
    line = stage.saved(line.repartitionByRange("key", "x", "kind").withColumn("range", F.spark_partition_id()))
    sums = {"score": F.sum("own"), "size": F.count("own")}
    inside = Window.partitionBy("key", "range").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = line.groupBy("key", "range").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range of a hot provider.
    starts = whole.select("key", "range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums])
    upto = line.withColumns({n: F.coalesce(c.over(inside), F.lit(0)) for n, c in sums.items()}).where("of is not null").join(starts, ["key", "range"])
    at = lambda kind, n: F.max(F.when(F.col("kind") == kind, F.col(n) + F.col(f"{n}_before")))
    found = upto.groupBy("of").agg(*[(at(1, n) - at(2, n)).alias(n) for n in sums])
    untimed = rows.where(F.col(us).isNull()).groupBy(key).agg(F.sum("instant_score").alias("score"), F.count("*").alias("size"))
    untimed = rows.where(F.col(us).isNull()).select(F.col(name).alias("of"), key).join(untimed, "key").select("of", "score", "size")
    both = found.unionByName(untimed).select("of", F.col("score").alias("window_score"), F.col("size").alias("window_size"))
    out = rows.join(both, F.col(name) == F.col("of"))
    return out.select(*own.columns, (F.col("window_score") - F.col("instant_score")).alias("window_score"), (F.col("window_size") - 1).alias("window_size"))


def seed(standing: Column, elevated: int = 2, unknown: int = 0) -> Column:
    return F.when(standing == "elevated_scrutiny", elevated).when(standing == "unknown", unknown).otherwise(0).cast("long")


def total(standing: Column, policy: dict[str, Any]) -> Column:
    s = policy["standingSeed"]
    return F.col("window_score") + F.col("instant_score") + seed(standing, s["elevatedSeedScore"], s["unknownSeedScore"])


def band(score: Column, warn: Column, block: Column, excluded: Column | None = None) -> Column:
    out = F.when(score >= block, "block").when(score >= warn, "warn").otherwise("clear")
    return out if excluded is None else F.when(excluded, "excluded").otherwise(out)


def meter_scale(score: Column, block: Column) -> Column:
    return F.greatest(block, score, F.lit(1))


def rates(ledger: DataFrame, since: Column, until: Column, floor: int = 20, strict_suppression: bool = False) -> DataFrame:
    """Rates of each provider of the ledger, also of one without rows between the times.

    Below the floor only the rate is withheld; ``strict_suppression`` withholds the counts too.
    """
    holds_no_content(ledger)
    inside = (F.col("at") >= since) & (F.col("at") < until)
    rows = ledger.select("provider_id", inside.alias("inside"), F.when(inside, F.col("flags")).alias("flags"))
    # Flags of a row are one or a few: exploded they are counted by type before the shuffle.
    of_type = rows.where("inside").select("provider_id", F.explode("flags").alias("f")).groupBy("provider_id", F.col("f.type").alias("type")).agg(F.count("*").alias("n"))
    of_type = of_type.groupBy("provider_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("flag_counts"))
    whole = rows.groupBy("provider_id").agg(F.count_if("inside").alias("evaluated_responses"), F.coalesce(F.sum(instant_score(F.col("flags"))), F.lit(0)).alias("severity_weighted_incidents"))
    out = whole.join(of_type, "provider_id", "left").withColumn("flag_counts", F.coalesce("flag_counts", F.create_map().cast("map<string, bigint>")))
    suppressed = F.col("evaluated_responses") < floor
    rate = F.when(~suppressed & (F.col("evaluated_responses") > 0), F.col("severity_weighted_incidents") / F.col("evaluated_responses"))
    out = out.withColumn("incident_rate", rate).withColumn("suppressed", suppressed)
    if strict_suppression:
        for c in ("flag_counts", "severity_weighted_incidents", "evaluated_responses"):
            out = out.withColumn(c, F.when(~F.col("suppressed"), F.col(c)))
    return out.select("provider_id", "evaluated_responses", "flag_counts", "severity_weighted_incidents", "incident_rate", "suppressed")


def provider_payload(rated: DataFrame) -> DataFrame:
    """(provider_id, payload): canonical JSON, fields in fixed order, types sorted, a null rate kept."""
    fields = {"providerId": "provider_id", "evaluatedResponses": "evaluated_responses", "flagCounts": "flag_counts", "severityWeightedIncidents": "severity_weighted_incidents", "incidentRate": "incident_rate", "suppressed": "suppressed"}
    return rated.select("provider_id", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("payload"))


def export_view(rated: DataFrame, ledger: DataFrame) -> DataFrame:
    """(provider_id, payload, would_leave_bytes, ledger_rows): what would go out beside what stays."""
    rows = ledger.groupBy("provider_id").agg(F.count("*").alias("ledger_rows"))
    return provider_payload(rated).withColumn("would_leave_bytes", F.octet_length("payload").cast("long")).join(rows, "provider_id")


def export_summary(view: DataFrame, transcripts: DataFrame, evidence: DataFrame, outbound: list[str] | None = None) -> DataFrame:
    """One row: what a batch would send of all providers beside what never leaves (turns, spans, their sealed sizes, ledger rows),
    and the paths on which content does leave.

    ``view`` is ``export_view``'s; transcripts and evidence have their sealed bytes in ``sealed``.
    """
    out = view.agg(F.count("*").alias("providers"), F.coalesce(F.sum("would_leave_bytes"), F.lit(0)).alias("would_leave_bytes"), F.coalesce(F.sum("ledger_rows"), F.lit(0)).alias("ledger_rows"))
    size = F.coalesce(F.sum(F.octet_length("sealed")), F.lit(0)).cast("long")
    turns = transcripts.agg(F.count("*").alias("transcript_turns"), size.alias("transcript_bytes"))
    spans = evidence.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)).cast("long").alias("evidence_spans"), size.alias("evidence_bytes"))
    # Three single rows side by side.
    both = [d.withColumn("one", F.lit(1)) for d in (out, turns, spans)]
    joined = both[0].join(both[1], "one").join(both[2], "one").drop("one")
    paths = F.array(*map(F.lit, outbound)) if outbound else F.array().cast("array<string>")
    sealed = F.col("transcript_bytes") + F.col("evidence_bytes")
    return joined.select("providers", "would_leave_bytes", "ledger_rows", "transcript_turns", "evidence_spans", sealed.alias("sealed_bytes"), paths.alias("outbound_paths"))


def typical_duration(durations: DataFrame, last: int = 20, fewest: int = 3) -> DataFrame:
    """Median of the last durations of each (provider_id, model): null below ``fewest``; of an even number the mean
    of the middle two, rounded half up."""
    rank = F.row_number().over(Window.partitionBy("provider_id", "model").orderBy(F.desc("at"), F.desc("response_id")))
    own = durations.withColumn("rank", rank).where(F.col("rank") <= last).groupBy("provider_id", "model").agg(F.array_sort(F.collect_list("duration_ms")).alias("d"))
    n = F.size("d")
    middle = F.get("d", F.floor(n / 2).cast("int")).cast("double")
    even = F.floor((F.get("d", F.floor(n / 2).cast("int") - 1) + F.get("d", F.floor(n / 2).cast("int"))) / 2 + 0.5).cast("double")
    return own.select("provider_id", "model", n.cast("long").alias("samples"), F.when(n < fewest, None).when(n % 2 == 1, middle).otherwise(even).alias("typical_ms"))


def batch(rated: DataFrame, header: dict[str, Any]) -> DataFrame:
    """(provider_id, payload) of a telemetry batch: the header's row, of no provider, and a row of each provider.

    The parts stay rows, so that no task holds the batch as one document.
    """
    head = rated.sparkSession.createDataFrame([(None, json.dumps(header, separators=(",", ":"), ensure_ascii=False))], "provider_id string, payload string")
    return head.union(provider_payload(rated))


def signed_batch(rated: DataFrame, header: dict[str, Any], seed: bytes) -> DataFrame:
    """The batch with a signature of each row: a provider's is of header and payload, the header's of itself and the number
    of providers, so a changed, moved, added or lost row shows and no task holds the batch as one document."""
    text = json.dumps(header, separators=(",", ":"), ensure_ascii=False)
    parts = provider_payload(rated).withColumn("signed", F.concat_ws("\n", F.lit(text), F.col("payload")))
    head = parts.agg(F.concat_ws("\n", F.lit(text), F.count("*").cast("string")).alias("signed"))
    both = head.select(F.lit(None).cast("string").alias("provider_id"), F.lit(text).alias("payload"), "signed").union(parts)
    return ed25519.dealt(both, "provider_id").select("provider_id", "payload", ed25519.signature(F.col("signed"), seed).alias("signature"))


def checked_batch(batch: DataFrame, pem: str) -> DataFrame:
    """(provider_id, payload, valid) of a signed batch by the sender's public key; without exactly one header nothing is valid."""
    heads = [r["payload"] for r in batch.where("provider_id is null").select("payload").limit(2).collect()]
    n = batch.where("provider_id is not null").count()
    about = F.when(F.col("provider_id").isNull(), F.lit(str(n))).otherwise(F.col("payload"))
    valid = ed25519.signature_valid(F.lit(pem), F.concat_ws("\n", F.lit(heads[0]), about), F.col("signature")) if len(heads) == 1 and heads[0] is not None else F.lit(False)
    return ed25519.dealt(batch, "provider_id").select("provider_id", "payload", valid.alias("valid"))


def monitor_state(ledger: DataFrame, blocks: DataFrame, chain: DataFrame, n: int = 10, typical: DataFrame | None = None) -> DataFrame:
    """The dashboard's row of each provider: a count window with neither seed nor carryover, and flags by type in it.

    ``typical`` (provider_id, typical_ms) has the usual duration of each provider's present model.
    """
    rank = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("seq")))
    top = ledger.withColumn("rank", rank).where(F.col("rank") <= n)
    window = top.groupBy("provider_id").agg(F.sum(instant_score(F.col("flags"))).alias("window_score"), F.count("*").alias("window_size"))
    by_type = top.select("provider_id", F.explode("flags").alias("f")).groupBy("provider_id", F.col("f.type").alias("type")).agg(F.count("*").alias("k"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "k")))).alias("flag_counts")
    flags = by_type.groupBy("provider_id").agg(F.sum("k").alias("window_flags"), counts)
    rows = ledger.groupBy("provider_id").agg(F.count("*").alias("n_rows"))
    open_ = blocks.where("released_at is null").groupBy("provider_id").agg(F.count("*").alias("open_blocks"))
    out = rows.join(window, "provider_id", "left").join(flags, "provider_id", "left").join(open_, "provider_id", "left").join(chain.select("provider_id", F.col("first_break").isNull().alias("chain_ok")), "provider_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("window_score", "window_size", "window_flags", "open_blocks")]
    none = F.create_map().cast("map<string, bigint>")
    out = out.join(typical.select("provider_id", "typical_ms"), "provider_id", "left") if typical is not None else out.withColumn("typical_ms", F.lit(None).cast("double"))
    return out.select("provider_id", "n_rows", *zero, F.coalesce("flag_counts", none).alias("flag_counts"), "chain_ok", "typical_ms")


def stage_times(times: DataFrame, parts: list[str], whole: str = "total_ms") -> DataFrame:
    """The parts' sum beside the whole, and whether the whole covers them within 5 ms."""
    added = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return times.withColumn("parts_ms", added).withColumn("covered", F.col(whole) + 5 >= F.col("parts_ms"))
