"""State machines cut in parts give what a fold gives, one key holding nearly all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import gate, notices
from assayer.sources.documents import DEFAULT_POLICY

SCORED = "provider_id string, seq long, response_id string, score double, warn double, block double, mode string, fixed string, n_flags int, sent boolean"


def folded(rows, policy):
    out, state = [], {}
    for r in rows:
        state[r["provider_id"]], made = gate.step(state.get(r["provider_id"], 0), r, policy["carryover"])
        out.append((r["provider_id"], r["seq"], r["response_id"], r["score"], *made))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("part_rows", "clean"), [(1, 5), (7, 1), (90, 5), (10**6, 0)])
def test_gate_in_parts(spark, part_rows, clean):
    rng = random.Random(part_rows)
    rows = [
        {"provider_id": rng.choice(["hot"] * 8 + [None, "cold"]), "seq": s, "response_id": f"r{s}", "score": float(rng.randint(0, 10)), "warn": 4.0, "block": float(rng.choice([5, 8])), "mode": rng.choice(["enforce", "enforce", "annotate"]),
         "fixed": rng.choice([None] * 6 + ["refuse", "deliver"]), "n_flags": rng.randint(0, 1), "sent": rng.random() < 0.9}
        for s in range(500)
    ]
    policy = DEFAULT_POLICY | {"carryover": DEFAULT_POLICY["carryover"] | {"cleanResponses": clean}}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCORED)
    got = gate.decisions(df, policy, part_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == folded(rows, policy)
    assert gate.decisions(df.limit(0), policy, part_rows).count() == 0


def test_gate_of_one_long_provider(spark):
    """Two million rows of one provider in 16 parts, against the fold."""
    n = 2_000_000
    rows = spark.range(n).select(F.lit("hot").alias("provider_id"), "id", (F.col("id") * 7919 % 1009 % 9).cast("double").alias("score"), (F.col("id") * 31 % 5 == 0).alias("clean"))
    given = rows.select("provider_id", F.col("id").alias("seq"), F.col("id").cast("string").alias("response_id"), "score", F.lit(4.0).alias("warn"), F.lit(8.0).alias("block"), F.lit("enforce").alias("mode"), F.lit(None).cast("string").alias("fixed"), F.when(F.col("clean"), 0).otherwise(1).alias("n_flags"), F.lit(True).alias("sent"))
    out = gate.decisions(given, DEFAULT_POLICY, n // 16)
    made = out.select("seq", "clean_remaining").orderBy("seq").toPandas()["clean_remaining"].tolist()
    state, want = 0, []
    for i in range(n):
        score = i * 7919 % 1009 % 9
        withheld = score >= (6 if state else 8)
        state = 5 if withheld else max(0, state - 1) if i * 31 % 5 == 0 else state
        want.append(state)
    assert made == want


def levels(rows, half_life):
    out, last = [], {}
    for s, at, order, bump in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        level = 0.0 if s not in last else notices.decayed(last[s][0], at - last[s][1], half_life)
        last[s] = (min(1.0, level + (bump or 0.0)), at)
        out.append((s, at, order, last[s][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("part_half_lives", "pause", "bumps"), [(4096, 60, [0.6]), (1, 60, [0.1, 0.32, None]), (2, 400, [0.0, 0.1, 0.3]), (3, 5, [0.0, 1e-4]), (10, 3000, [0.6])])
def test_levels_in_parts(spark, part_half_lives, pause, bumps):
    """Parts shorter than a level's memory are settled in rounds; all are equal to the last bit."""
    rng, at, rows = random.Random(pause), 0, []
    for i in range(700):
        at += 0 if rng.random() < 0.2 else rng.randint(0, pause) if rng.random() < 0.97 else 40 * pause
        rows.append((rng.choice(["hot"] * 9 + [None]), at, i, rng.choice(bumps)))
    df = spark.createDataFrame(rows, "stream_id string, at_ms long, order_id long, bump double")
    for part_rows in (0, 300) if pause == 400 else (0,):
        got = notices.arrival_levels(df, 350.0, part_half_lives, part_rows)
        assert sorted(map(tuple, got.collect()), key=repr) == levels(rows, 350.0)


def raises(rows, given):
    out, last = [], {}
    for s, at, order, warn in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        up = []
        for n in given:
            trigger, repeat = n.get("trigger") or "session_start", n.get("repeatMinutes")
            before = last.get((s, n["id"]))
            if trigger == "always" or (trigger == "on_warn" and warn) or (trigger not in ("always", "on_warn") and (before is None or (repeat and at - before >= repeat * 60_000))):
                up.append(n["id"])
                last[s, n["id"]] = at
        out.append((s, at, order, up))
    return sorted(out, key=repr)


@pytest.mark.parametrize("minutes", [0.001, 1, 17, 100_000])
def test_notices_by_pointers(spark, minutes):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + [None, "x"]), rng.randint(-(10**7), 10**8) // 50 * 50, i, rng.random() < 0.3) for i in range(900)]
    given = [{"id": "a", "repeatMinutes": minutes}, {"id": "w", "trigger": "on_warn"}, {"id": "b"}, {"id": "z", "trigger": "always"}, {"id": "c", "trigger": "session_start", "repeatMinutes": 3 * minutes}]
    df = spark.createDataFrame(rows, "session_id string, at_ms long, order_id long, in_warn_band boolean")
    for part_rows in (0, 400, 10**6) if minutes == 17 else (0,):
        assert sorted(map(tuple, notices.raised(df, given, part_rows).collect()), key=repr) == raises(rows, given)
        assert notices.raised(df.limit(0), given, part_rows).count() == 0
        assert {tuple(r["raised"]) for r in notices.raised(df, [], part_rows).collect()} == {()}


def test_notices_of_one_long_session(spark):
    """A million deliveries of one session, against the chain walked one by one."""
    n, minutes = 1_000_000, 30
    rows = spark.range(n).select(F.lit("s").alias("session_id"), (F.col("id") * 1700 + F.col("id") * 7919 % 1500).alias("at_ms"), F.col("id").alias("order_id"), F.lit(False).alias("in_warn_band"))
    got = [r[0] for r in notices.raised(rows, [{"id": "a", "repeatMinutes": minutes}], n // 2).where("size(raised) > 0").select("order_id").orderBy("order_id").collect()]
    want, last = [], None
    for i in range(n):
        at = i * 1700 + i * 7919 % 1500
        if last is None or at - last >= minutes * 60_000:
            want.append(i)
            last = at
    assert got == want and len(want) > 900
