from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer import api
from assayer.operators import ledger
from assayer.sources.documents import DEFAULT_POLICY, TAXONOMY


def responses(spark, texts):
    rows = spark.createDataFrame([("p", i, f"r{i}", t) for i, t in enumerate(texts)], "provider_id string, order_no int, response_id string, content string")
    return ledger.numbered(rows, "order_no").withColumn("at", F.timestamp_seconds(F.col("seq") * 60))


def decided(spark, texts, **k):
    scored = api.score(api.flag(responses(spark, texts)))
    options = {"standing": F.lit("good"), "passed": F.lit(True), "sealed": F.lit(True)} | k
    return [(r["outcome"], r["score"], r["release_authority"]) for r in api.decide(scored, **options).orderBy("seq").collect()]


SECRET = "token = 'abcdefgh12345678'"


def test_flags_to_outcomes(spark):
    got = decided(spark, ["hello", SECRET, "mail a@b.example", SECRET, None])
    assert got == [("deliver", 0.0, None), ("deliver", 3.0, None), ("deliver_with_notice", 5.0, None), ("withhold", 8.0, "self_release"), ("withhold", 8.0, "self_release")]


def test_overlay_and_standing(spark):
    overlay = {"categoryTreatments": {"secret": {"severityFloor": 9, "nonReleasable": True}}}
    assert decided(spark, [SECRET], overlay=overlay) == [("withhold", 9.0, "non_releasable")]
    assert decided(spark, [SECRET], overlay={"categoryTreatments": {"secret": {"mandatoryNonDelivery": True}}}) == [("refuse", 3.0, None)]
    assert decided(spark, ["x"], standing=F.lit("excluded")) == [("refuse", 0.0, None)]
    assert decided(spark, [SECRET], standing=F.lit("elevated_scrutiny")) == [("deliver_with_notice", 5.0, None)]
    assert decided(spark, [SECRET] * 3, rules=DEFAULT_POLICY | {"mode": "observe"})[-1] == ("deliver", 9.0, None)


def test_time_windows_of_sessions(spark):
    rows = api.flag(responses(spark, [SECRET, SECRET, SECRET])).withColumn("session", F.when(F.col("seq") < 2, "a").otherwise("b"))
    hour = DEFAULT_POLICY | {"window": {"kind": "time", "hours": 1, "scope": "session"}}
    assert [r["window_score"] for r in api.score(rows, hour, F.col("session")).orderBy("seq").collect()] == [0, 0, 3]


def test_captured_verdicts(spark):
    rows = responses(spark, ["abc def"]).withColumn("v", F.lit('ok {"flags":[{"type":"secret","reason":"x","evidence":["def","zz"]},{"type":"none"}]}'))
    got = api.flag(rows, api.CapturedVerdicts("v")).first()["flags"]
    assert len(got) == 1 and got[0]["severity"] == 3 and [(s["start"], s["end"]) for s in got[0]["evidence"]] == [(4, 7)]
    assert api.RuleEvaluator().version == "0.1.0+tax." + TAXONOMY["taxonomyVersion"]


def test_released_content_and_dns_entries(spark):
    d = spark.sql("SELECT 'p' AS provider_id, 'r1' AS response_id, 'withhold' AS outcome UNION ALL SELECT 'p', 'r2', 'deliver'")
    t = spark.sql("SELECT 'r1' AS id, 'text' AS content UNION ALL SELECT 'r2', 'other'")
    assert [tuple(r) for r in api.withheld_content(d, d.select("provider_id", "response_id"), t).collect()] == [("r1", "p", "text")]
    r = spark.sql("SELECT 'p' AS provider_id, 'own' AS register_entry_id UNION ALL SELECT 'q', 'own'")
    dns = spark.sql("SELECT 'p' AS provider_id, 'named' AS entry_id, 'k' AS key_set_digest")
    assert {x["provider_id"]: x["register_entry_id"] for x in api.confirmed_entry(r, dns).collect()} == {"p": "named", "q": "own"}
    n = spark.sql("SELECT 'a' AS id, 2 AS raised_at, 'x' AS text UNION ALL SELECT 'a', 1, 'y'")
    assert api.pinned(n).first()["text"] == "y"


def test_evaluator_of_a_configuration():
    assert isinstance(api.evaluator_of(None), api.RuleEvaluator) and isinstance(api.evaluator_of({"kind": "rule"}), api.RuleEvaluator)
    assert api.evaluator_of({"kind": "model", "verdictColumn": "v"}).column == "v"
    for wrong in ({"kind": "model"}, {"kind": "other"}):
        with pytest.raises(ValueError):
            api.evaluator_of(wrong)
