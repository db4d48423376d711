"""Keyed state with timers: streams in any cut and order give what the batch operators give, and state goes."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import wire
from assayer.operators import notices, scoring
from assayer.streaming import keyed, reload

T0 = 1_700_000_000


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyed.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def fed(spark, tmp_path, frames, transform, name, mode="append"):
    """(rows, state rows left) after the frames, one micro-batch each."""
    source, started = tmp_path / f"in-{name}", None
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(source))
        if started is None:
            stream = transform(spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
            started = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode(mode).start()
        started.processAllAvailable()
    left = started.lastProgress["stateOperators"][0]["numRowsTotal"]
    started.stop()
    return spark.table(name), left


def at(seconds):
    return F.timestamp_micros((F.lit(T0 * 1_000_000) + seconds * 1_000_000).cast("long"))


def shuffled(rows, cuts, seed):
    """Rows in micro-batches, each row at most a batch away from its place."""
    rng = random.Random(seed)
    place = sorted(range(len(rows)), key=lambda i: i + rng.randint(0, len(rows) // cuts))
    size = len(rows) // cuts + 1
    return [[rows[i] for i in place[k : k + size]] for k in range(0, len(rows), size)]


def test_windows(rocks, tmp_path):
    """Count and time windows in one ledger, late rows within the lateness."""
    rng = random.Random(5)
    times = sorted(rng.choice([0, 1]) * 90_000 + rng.randint(0, 50_000) + rng.random() for _ in range(120))
    rows = [("hot" if i % 6 else "cold", i, t, i * 7 % 4) for i, t in enumerate(times)]
    schema = "provider_id string, seq long, t double, severity int"
    flags = F.array(F.struct(F.lit("x").alias("type"), F.col("severity"), F.lit("e").alias("evidence_ref")))
    frame = lambda r: rocks.createDataFrame(r, schema).select("provider_id", "seq", at(F.col("t")).alias("at"), flags.alias("flags"))
    batch = scoring.with_instant(frame(rows))
    end = [("zz", 10**6, 400_000.0, 0)]
    parts = [frame(r) for r in shuffled(rows, 3, 1)] + [frame(end), frame([("zz", 10**6 + 1, 800_000.0, 0)])]
    for name, stream, want in (("cw", lambda d: keyed.count_window(d, 10, 10**8, "2 days"), scoring.count_window(batch)), ("tw", lambda d: keyed.time_window(d, 24, "2 days"), scoring.time_window(batch))):
        got, left = fed(rocks, tmp_path, parts, stream, name)
        columns = ["provider_id", "seq", "instant_score", "window_score", "window_size"]
        own = sorted(map(tuple, got.where("provider_id <> 'zz'").select(columns).collect()))
        assert own == sorted(map(tuple, want.select(columns).collect())) and len(own) == 120
        assert left < 60 or name == "cw"


def test_notices_and_their_end(rocks, tmp_path):
    rng, given = random.Random(2), [{"id": "a", "repeatMinutes": 10}, {"id": "b"}, {"id": "w", "trigger": "on_warn"}]
    rows = [(f"s{i % 2}", i * 60.0 + rng.random(), i, rng.random() < 0.2) for i in range(60)]
    schema = "session_id string, t double, order_id long, in_warn_band boolean"
    frame = lambda r: rocks.createDataFrame(r, schema).withColumn("at", at(F.col("t"))).drop("t")
    want = notices.raised(frame(rows).withColumn("at_ms", F.unix_millis("at")), given)
    end = [frame([("zz", 10_000.0, 0, False)]), frame([("zz", 40_000.0, 1, False)]), frame([("zz", 80_000.0, 2, False)])]
    again = frame([("s0", 80_100.0, 99, False)])
    got, left = fed(rocks, tmp_path, [*(frame(r) for r in shuffled(rows, 3, 2)), *end, again, frame([("zz", 200_000.0, 3, False)]), frame([("zz", 300_000.0, 4, False)])], lambda d: keyed.raised(d, given, 3_600_000, "20 minutes"), "nt")
    found = [tuple(r) for r in got.where("session_id <> 'zz'").collect()]
    assert sorted(f for f in found if f[2] != 99) == sorted(map(tuple, want.collect()))
    # After an hour without a delivery the session was over: both notices go up again.
    assert [f[3] for f in found if f[2] == 99] == [["a", "b"]]
    assert left <= 6


def test_durations(rocks, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{i % 2}", "m", float(i), f"r{i}", rng.randint(1, 500)) for i in range(70)] + [("q", "m", 3.0, "x", 5)]
    frame = lambda r: rocks.createDataFrame(r, "provider_id string, model string, t double, response_id string, duration_ms long").withColumn("at", at(F.col("t"))).drop("t")
    want = scoring.typical_duration(frame(rows))
    parts = [frame(r) for r in shuffled(rows, 3, 3)]
    got, left = fed(rocks, tmp_path, [*parts, frame([("z", "m", 9_000.0, "z", 1)]), frame([("z", "m", 9_001.0, "y", 1)])], lambda d: keyed.typical_duration(d, 60_000), "du", "update")
    seen = {}
    for r in got.collect():
        if r["provider_id"] != "z" and r["samples"] >= seen.get(r["provider_id"], (0,))[0]:
            seen[r["provider_id"]] = (r["samples"], r["typical_ms"])
    expected = {r["provider_id"]: (r["samples"], r["typical_ms"]) for r in want.collect()}
    assert seen["q"] == expected["q"] and {p: s[0] for p, s in seen.items()} == {p: e[0] for p, e in expected.items()}
    last = {p: [r["typical_ms"] for r in got.where(F.col("provider_id") == p).collect()][-1] for p in ("p0", "p1")}
    assert last == {p: expected[p][1] for p in last}
    assert left <= 5


def body(turns, after="", end="data: [DONE]\n\n"):
    said = "".join(f"data: {json.dumps({'choices': [{'delta': {'content': t}}]}, ensure_ascii=False)}\r\n\r\n" for t in turns)
    return said + "event: seal\ndata: S\n\n" + after + end


@pytest.mark.parametrize("size", [3, 40])
def test_exchanges(rocks, tmp_path, size):
    late = 'data: {"choices":[{"delta":{"content":"late"}}]}\n\n'
    bodies = {"plain": body([" é", "\n", "😀 x"]), "late": body(["a", "b"], late), "twice": body(["a"], "event: seal\ndata: T\n\n"), "empty": body([]), "broken": body(["ok"], "data: {no\n\n")}
    rows = [(x, i // size, bytearray(b.encode()[i : i + size]), i + size >= len(b.encode()), float(i)) for x, b in bodies.items() for i in range(0, len(b.encode()), size)]
    frame = lambda r: rocks.createDataFrame(r, "exchange_id string, chunk_no long, chunk binary, last boolean, t double").withColumn("at", at(F.col("t"))).drop("t")
    rng = random.Random(size)
    rng.shuffle(rows)
    cut = [("cut", 0, bytearray(body(["half", "way"], end="").encode()[:90]), False, 5.0)]
    want = wire.accumulated(wire.whole_chunks(frame(rows).select("exchange_id", "chunk_no", "chunk")), "chat-delta")
    third = len(rows) // 3 + 1
    parts = [frame(rows[:third] + cut), frame(rows[third : 2 * third]), frame(rows[2 * third :]), frame([("plain", 10**6, bytearray(b"x"), True, 6.0)]), frame([("zz", 0, bytearray(b""), True, 50_000.0)]), frame([("zz", 0, bytearray(b""), True, 50_001.0)])]
    got, left = fed(rocks, tmp_path, parts, lambda d: keyed.exchanges(d, "chat-delta", 60_000, lateness="1 hour"), f"ex{size}")
    columns = ["exchange_id", "sealed_content", "terminal_seal", "content_after_seal", "several_seals"]
    found = {r["exchange_id"]: r for r in got.collect()}
    assert sorted(tuple(r[c] for c in columns) for x, r in found.items() if x in bodies) == sorted(map(tuple, want.select(columns).collect()))
    assert got.where("exchange_id <> 'zz'").count() == len(bodies) + 1 and found["late"]["content_after_seal"]
    assert found["cut"]["closed_by"] == "timeout" and found["cut"]["sealed_content"] == "half" and found["cut"]["terminal_seal"] is None
    assert left <= 3


def test_reload_in_a_running_stream(spark, tmp_path):
    """A document that gains, loses and breaks between micro-batches."""
    doc, seen = tmp_path / "register.json", {}

    def use(batch, rows, gone, number):
        joined = batch.join(rows, "id", "left").select("id", "name")
        seen[number] = (sorted(map(tuple, joined.collect()), key=repr), sorted(r[0] for r in gone.collect()))

    def step(text):
        if text is None:
            doc.unlink()
        else:
            doc.write_text(text)
        spark.createDataFrame([("a",), ("b",)], "id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    read = lambda s: doc.read_text() if doc.exists() else None
    start = lambda: reload.reloading(spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), read, str(tmp_path / "log"), "id: string, name: string", "id", use, str(tmp_path / "c"))
    step('[{"id": "a", "name": "A"}]')
    query = start()
    query.processAllAvailable()
    for text in ('[{"id": "a", "name": "A"}, {"id": "b", "name": "B"}]', '[{"id": "a"', None):
        step(text)
        query.processAllAvailable()
    query.stop()
    step('[{"id": "b", "name": "B2"}]')
    query = start()
    query.processAllAvailable()
    query.stop()
    both = [("a", "A"), ("b", "B")]
    assert [seen[i] for i in range(5)] == [([("a", "A"), ("b", None)], []), (both, []), (both, []), (both, []), ([("a", None), ("b", "B2")], ["a"])]
