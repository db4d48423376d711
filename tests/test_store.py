from __future__ import annotations

import itertools

import pytest

from assayer import host
from assayer.sources import conformance, sinks
from assayer.sources.store import open_store

SECRETS = {"ledger": bytes(32), "transcript": bytes(range(32)), "preference": bytes(32)}
TOKEN = "token = 'abcdefgh12345678'"


@pytest.mark.parametrize("form", ["parquet", "orc"])
def test_stores_conform(spark, tmp_path, form):
    number = itertools.count()
    conformance.check(spark, lambda: open_store(spark, str(tmp_path / f"{form}{next(number)}"), SECRETS, form))


def test_host(spark, tmp_path):
    own = host.Host(open_store(spark, str(tmp_path / "h"), SECRETS))
    rows = lambda texts, first: spark.createDataFrame([("p", f"r{first + i}", f"2026-01-01 00:0{first + i}:00", t) for i, t in enumerate(texts)], "provider_id string, response_id string, at string, content string")
    first = own.dispatch("ask", {"responses": rows(["hello", TOKEN, TOKEN], 0)})
    assert [(r["response_id"], r["outcome"], r["score"]) for r in first.orderBy("seq").collect()] == [("r0", "deliver", 0.0), ("r1", "deliver", 3.0), ("r2", "deliver_with_notice", 6.0)]
    again = own.dispatch("ask", {"responses": rows([TOKEN], 3)}).collect()
    assert [(r["outcome"], r["score"], r["release_authority"], r["reasons"]) for r in again] == [("withhold", 9.0, "self_release", ["block_line"])]
    state = own.dispatch("state")
    provider = state["providers"].first()
    assert provider["n_rows"] == 4 and provider["window_score"] == 9 and provider["open_blocks"] == 1 and provider["chain_ok"]
    assert not state["attestations"]["isAdult"] and state["effectiveThresholds"] == {"warn": 4, "block": 8}
    ask = {"providerId": "p", "responseId": "r3", "actor": "self", "at": "2026-01-02T00:00:00Z"}
    assert own.dispatch("release", ask) == {"released": False, "reason": "adult_only", "content": None}
    assert own.dispatch("attestations.set", {"isAdult": True}) == {"isAdult": True} and own.dispatch("transport.set", {"withholdUnverifiedContent": True})
    assert own.dispatch("release", ask) == {"released": True, "reason": None, "content": TOKEN}
    assert own.dispatch("release", ask)["reason"] == "no_open_block"
    assert [r["content"] for r in own.dispatch("transcript").orderBy("turn_no").collect()] == ["hello", TOKEN, TOKEN, TOKEN]
    view, summary = own.dispatch("export", {"since": "2026-01-01", "until": "2026-01-02", "floor": 2})
    got = summary.first()
    assert "flagCounts" in view.first()["payload"] and TOKEN not in view.first()["payload"]
    assert (got["providers"], got["ledger_rows"], got["transcript_turns"]) == (1, 4, 4) and got["sealed_bytes"] > 0
    own.dispatch("reputation.reset", {"providerId": "p"})
    assert own.store.ledger.rows().count() == 0 and own.dispatch("session.new")["sessionId"] and own.dispatch("transcript").count() == 0
    with pytest.raises(ValueError):
        own.dispatch("nothing")


def test_what_came_of_a_batch(spark, tmp_path):
    batch = spark.createDataFrame([(None, "{}"), ("p", '{"providerId":"p"}')], "provider_id string, payload string")

    def refuses(rows, endpoint):
        raise OSError(f"{endpoint} is down\nand more")

    assert sinks.emit(batch, None) == {"status": "no_endpoint", "error": None}
    assert sinks.emit(batch, "x", refuses) == {"status": "failed", "error": "x is down"}
    for _ in range(2):
        assert sinks.emit(batch, str(tmp_path / "out")) == {"status": "sent", "error": None}
    assert spark.read.json(str(tmp_path / "out")).count() == 2
