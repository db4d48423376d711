from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.operators import gate, ledger, notices, policy, scoring, verdict
from assayer.sources import documents, tables
from assayer.sources.documents import DEFAULT_POLICY

CARRY = DEFAULT_POLICY["carryover"]


def replay(severities, seed=2, mode="enforce"):
    """A scalar replay of the policy: (score, kind, carryover after) of each turn."""
    out, remaining, window = [], 0, []
    for own in severities:
        score = sum(map(sum, window[-10:])) + sum(own) + seed
        remaining, made = gate.step(remaining, {"score": score, "warn": 4, "block": 8, "mode": mode, "fixed": None, "n_flags": len(own), "sent": True}, CARRY)
        out.append((score, made[0], remaining))
        window.append(own)
    return out


def test_twenty_turns():
    got = replay([[], [1], [1], [2], [3], *[[]] * 15])
    kinds = {"deliver": "d", "deliver_with_notice": "n", "withhold": "w"}
    assert "".join(kinds[k] for _, k, _ in got) == "ddnnw" + "w" * 9 + "n" + "d" * 5
    assert [s for s, _, _ in got] == [2, 3, 4, 6, 9, 9, 9, 9, 9, 9, 9, 9, 8, 7, 5, 2, 2, 2, 2, 2]
    assert [c for _, _, c in got][-6:] == [4, 3, 2, 1, 0, 0]


@pytest.mark.parametrize(("mode", "kind"), [("enforce", "withhold"), ("annotate", "deliver_with_notice")])
def test_modes(mode, kind):
    assert replay([[3], [3], [3]], mode=mode)[-1][1] == kind


def test_fixed_outcomes_in_their_order(spark):
    case = lambda **k: spark.range(1).select(gate.fixed_outcome(F.lit(k.get("s", "good")), F.lit(k.get("p", True)), F.lit(k.get("seal", True)), F.lit(k.get("m")).cast("string"), F.lit(k.get("mode", "enforce")), True, k.get("u", "ignore"))).first()[0]
    assert case(s="excluded") == "refuse" and case(p=False, mode="observe") == "refuse" and case(seal=False, u="refuse") == "refuse"
    assert case(m="x", mode="observe") == "refuse" and case(mode="observe") == "deliver" and case() is None and case(seal=False, u="notice") is None


def test_overlays_only_tighten():
    o = {"thresholdOverrides": {"warn": 9, "block": 5}, "minorOnly": {"thresholdOverrides": {"warn": 1}, "status": "pending"}, "modeFloor": "observe"}
    assert policy.thresholds(o, DEFAULT_POLICY, True) == (4, 5)
    assert policy.mode(o, "annotate", False) == "annotate"
    assert policy.pending(o) == ["minorOnly"]
    assert policy.unsealed(documents.NO_OVERLAY) == "ignore"


def test_reraising_a_block_clears_its_release(spark):
    raises = spark.sql("SELECT 'p' AS provider_id, 'r' AS response_id, 'self_release' AS authority, timestamp'2024-01-01' AS raised_at UNION ALL SELECT 'p', 'r', 'self_release', timestamp'2024-01-03'")
    releases = spark.sql("SELECT 'p' AS provider_id, 'r' AS response_id, timestamp'2024-01-02' AS released_at, 'self' AS released_by")
    assert policy.blocks(raises, releases).first()["released_at"] is None
    assert policy.blocks(raises.where("raised_at < timestamp'2024-01-02'"), releases).first()["released_by"] == "self"


def test_chain_goes_on_and_shows_the_first_break(spark):
    rows = spark.createDataFrame([("p", "r1", "t1", "deliver", 0.0), ("p", "r2", "t2", "withhold", 9.0), ("q", "s1", "t1", "deliver", 2.25)], "provider_id string, response_id string, at_iso string, outcome string, score double")
    rows = ledger.numbered(rows.select("*", F.col("score").cast("decimal(18,4)").alias("s")).drop("score").withColumnRenamed("s", "score").withColumn("flags", F.array(F.struct(F.lit("x").alias("type"), F.lit(1).alias("severity"), F.lit("e").alias("evidence_ref")))).withColumn("evaluator_version", F.lit("e")).withColumn("taxonomy_version", F.lit("t")), "at_iso")
    chain = ledger.appended(rows)
    assert {r["provider_id"]: r["first_break"] for r in ledger.verify(chain).collect()} == {"p": None, "q": None}
    more = ledger.appended(rows.where("provider_id = 'p'").withColumn("seq", F.col("seq") + 2), ledger.heads(chain))
    assert ledger.verify(chain.union(more)).where("provider_id = 'p'").first()["first_break"] is None
    changed = chain.withColumn("score", F.when(F.col("response_id") == "r2", 8).otherwise(F.col("score")).cast("decimal(18,4)"))
    assert ledger.verify(changed).where("provider_id = 'p'").first()["first_break"] == 2


def test_rates_keep_small_counts_unless_strict(spark):
    rows = spark.sql("SELECT 'p' AS provider_id, timestamp'2024-01-01' AS at, array(named_struct('type', 'x', 'severity', 1, 'evidence_ref', 'e')) AS flags UNION ALL SELECT 'q', timestamp'2023-01-01', array()")
    since, until = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    got = {r["provider_id"]: r for r in scoring.rates(rows, since, until, 2).collect()}
    assert got["p"]["flag_counts"] == {"x": 1} and got["p"]["incident_rate"] is None and got["q"]["evaluated_responses"] == 0
    assert scoring.rates(rows, since, until, 2, strict_suppression=True).where("provider_id = 'p'").first()["flag_counts"] is None
    assert scoring.rates(rows, since, until, 1).where("provider_id = 'p'").first()["incident_rate"] == 1.0
    with pytest.raises(ValueError):
        scoring.rates(rows.withColumn("content", F.lit("x")), since, until)


def test_key_status_and_freshness(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    t = F.lit("2024-01-01T00:00:00Z")
    assert one(verdict.freshness(F.lit("2024-01-01T00:05:00Z"), t)) is None
    assert one(verdict.freshness(F.lit("2024-01-01T00:05:01Z"), t)) == "seal_not_fresh"
    assert one(verdict.freshness(F.lit("2023-12-31T23:00:00Z"), t)) is None
    assert one(verdict.freshness(F.lit("bad"), t)) == "seal_malformed"
    assert one(verdict.freshness(t, F.lit("bad"))) is None
    assert one(verdict.key_status(F.lit("retired"), F.lit(None).cast("string"), t)) == "seal_key_retired"


def test_compose_bumps(spark):
    rows = spark.createDataFrame([("char", None), ("word", None), ("paste", "a b c d e"), ("paste", "")], "kind string, text string")
    assert [round(r[0], 2) for r in rows.select(notices.compose_bump(F.col("kind"), F.col("text"))).collect()] == [0.1, 0.32, 1.28, 0.32]


def test_tables_and_documents(spark, tmp_path):
    log = spark.createDataFrame([("a", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("b", "3", "2024-01-01")], "key string, value string, at string")
    assert tables.setting(log, "a").first()["value"] == "2"
    path = str(tmp_path / "t")
    assert tables.open_table(spark, path, "key string, value string, at string").count() == 0
    tables.append(log, path)
    assert tables.open_table(spark, path, "key string, value string, at string").count() == 3
    doc = tmp_path / "d.json"
    doc.write_text('{"providers": [{"registerEntryId": "x", "state": "good", "quorumSources": 30}]}')
    read = documents.read_document(spark, str(doc))
    assert documents.standing_entries(spark, read).first()["state"] == "good"
    assert documents.standing_entries(spark, None).count() == 0
    doc.write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        documents.read_document(spark, str(doc), strict=True)
    assert documents.discovered(None, "NO_SUCH_VARIABLE_X", "default") == "default"


def _hot_ledger(spark):
    """One provider of nearly all rows, numbers and times with gaps, rows without a time, a row without a provider."""
    rows = spark.range(600).select(
        F.when(F.col("id") == 77, None).when(F.col("id") % 40 == 3, "cold").otherwise("hot").alias("provider_id"),
        (F.col("id") * 3 + F.when(F.col("id") > 200, 1000).otherwise(0)).alias("seq"),
        F.when(F.col("id") % 97 == 5, None).otherwise(F.timestamp_micros(F.col("id") * F.col("id") * 700_000_000 - F.col("id") % 7 * 400_000)).alias("at"),
        (F.col("id") * 7919 % 5).alias("instant_score"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("hash"), F.lit("x").alias("us"),
    )
    return rows


def _same(one, other):
    names = sorted(one.columns)
    assert names == sorted(other.columns)
    got, want = (sorted(map(repr, df.select(*names).collect())) for df in (one, other))
    assert got == want and got


@pytest.mark.parametrize("part_rows", [1, 17, 40, 10**6])
def test_split_count_windows_are_whole(spark, part_rows):
    rows, w = _hot_ledger(spark), Window.partitionBy("provider_id").orderBy("seq").rowsBetween(-10, -1)
    want = rows.withColumn("window_score", F.coalesce(F.sum("instant_score").over(w), F.lit(0))).withColumn("window_size", F.count("*").over(w))
    _same(scoring.count_window(rows, 10, part_rows=part_rows), want)
    start = F.date_trunc("day", F.col("at"))
    prior = rows.withColumn("p", F.filter(F.collect_list(F.struct("at", "instant_score")).over(w), lambda r: r["at"] >= start))
    want = prior.withColumn("window_score", F.aggregate("p", F.lit(0).cast("long"), lambda a, r: a + r["instant_score"])).withColumn("window_size", F.size("p").cast("long")).drop("p")
    _same(scoring.count_window(rows, 10, start, part_rows), want)


@pytest.mark.parametrize(("sessions", "part_rows"), [(0, 10**6), (3, 10**6), (0, 100), (3, 0)])
def test_split_time_windows_are_whole(spark, sessions, part_rows):
    session = F.col("seq") % sessions if sessions else None
    rows = _hot_ledger(spark).withColumn("s", F.lit(0) if session is None else session)
    w = Window.partitionBy("provider_id", "s").orderBy(F.unix_micros("at")).rangeBetween(-24 * 3_600_000_000, 999_999)
    want = rows.withColumn("window_score", F.sum("instant_score").over(w) - F.col("instant_score")).withColumn("window_size", F.count("*").over(w) - 1)
    _same(scoring.time_window(rows, 24, session, part_rows), want)


def test_split_numbers_go_on(spark):
    rows = _hot_ledger(spark).drop("seq")
    want = rows.withColumn("seq", F.row_number().over(Window.partitionBy("provider_id").orderBy("at", "hash")).cast("long"))
    _same(ledger.numbered(rows, "at", "hash", part=F.to_date("at")), want)
    assert ledger.numbered(rows.limit(0), "at", part=F.to_date("at")).count() == 0


def test_reload_keeps_rows_of_a_broken_document(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    document = lambda text: spark.createDataFrame([(text,)], "value string")
    rows, gone = tables.reloaded(current, document('[{"id": "a", "n": 7}, {"id": "c", "n": 3}]'), "id")
    assert {tuple(r) for r in rows.collect()} == {("a", 7), ("c", 3)} and [r[0] for r in gone.collect()] == ["b"]
    for broken in ('[{"id": "a", "n": 7}, {"id"', "", None, "no json"):
        rows, gone = tables.reloaded(current, document(broken), "id")
        assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", 2)} and not gone.count()
    rows, gone = tables.reloaded(current, document("[]"), "id")
    assert not rows.count() and {r[0] for r in gone.collect()} == {"a", "b"}


def test_a_hot_day_is_many_ranges(spark):
    """All rows of one provider within an hour, many at the same time."""
    rows = spark.range(20_000).select(F.lit("hot").alias("provider_id"), F.col("id").alias("seq"), F.timestamp_micros(F.floor(F.col("id") / 3) * 540_000).alias("at"), (F.col("id") % 4).alias("instant_score"))
    w = Window.partitionBy("provider_id").orderBy(F.unix_micros("at")).rangeBetween(-3_600_000_000, 999_999)
    want = rows.withColumn("window_score", F.sum("instant_score").over(w) - F.col("instant_score")).withColumn("window_size", F.count("*").over(w) - 1)
    _same(scoring.time_window(rows, 1, part_rows=1000), want)


def test_signed_batch(spark):
    """A changed header or a changed number of rows spoils the header's row, a changed payload its own; another key opens nothing."""
    from assayer.functions import ed25519
    from assayer.operators import scoring

    seed = bytes(range(32))
    at = F.lit("2024-01-11").cast("timestamp")
    rows = spark.range(6).select(F.concat(F.lit("p"), F.col("id") % 3).alias("provider_id"), at.alias("at"), F.expr("cast(array() as array<struct<type: string, severity: int>>)").alias("flags"))
    rated = scoring.rates(rows, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 1)
    batch = scoring.signed_batch(rated, {"version": "1"}, seed)
    pem = ed25519.pem_of(ed25519.public_key(seed))
    valid = lambda b, p=pem: {r["provider_id"]: r["valid"] for r in scoring.checked_batch(b, p).collect()}
    assert valid(batch) == {None: True, "p0": True, "p1": True, "p2": True}
    assert valid(batch.where("provider_id is null or provider_id <> 'p1'")) == {None: False, "p0": True, "p2": True}
    assert valid(batch.withColumn("payload", F.when(F.col("provider_id") == "p2", "{}").otherwise(F.col("payload")))) == {None: True, "p0": True, "p1": True, "p2": False}
    assert not any(valid(batch.withColumn("payload", F.when(F.col("provider_id").isNull(), "{}").otherwise(F.col("payload")))).values())
    assert not any(valid(batch, ed25519.pem_of(ed25519.public_key(seed[::-1]))).values()) and not any(valid(batch.where("provider_id is not null")).values())
    assert valid(scoring.signed_batch(rated.limit(0), {"version": "1"}, seed)) == {None: True} and not valid(batch.limit(0))
