"""Streams give what the batch operators give."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import wire
from assayer.operators import gate, notices
from assayer.sources.documents import DEFAULT_POLICY
from assayer.streaming import stateful


def run(spark, tmp_path, frames, transform, name):
    """Feeds one file after the other and returns all rows."""
    source = tmp_path / f"in-{name}"
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(source))
        if i == 0:
            schema = f.schema
            stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
            started = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").start()
        started.processAllAvailable()
    started.stop()
    return spark.table(name)


def test_gate(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{p}", s, f"r{p}-{s}", float((s * 7 + p) % 11), 4.0, 8.0, "enforce", "refuse" if s % 6 == 5 else None, s % 3, True) for p in range(3) for s in range(12)], "provider_id string, seq long, response_id string, score double, warn double, block double, mode string, fixed string, n_flags int, sent boolean")
    got = run(spark, tmp_path, [rows.where("seq < 5"), rows.where("seq >= 5")], lambda d: stateful.decisions(d, DEFAULT_POLICY), "gate")
    want = gate.decisions(rows, DEFAULT_POLICY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    late = run(spark, tmp_path, [rows.where("seq >= 5"), rows.where("seq < 5")], lambda d: stateful.decisions(d, DEFAULT_POLICY), "late")
    assert {(r["seq"] < 5, r["outcome"] == "out_of_order") for r in late.collect()} == {(True, True), (False, False)}


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{s}", t * 130, t) for s in range(2) for t in range(10)], "stream_id string, at_ms long, order_id long")
    got = run(spark, tmp_path, [rows.where("order_id < 4"), rows.where("order_id >= 4")], stateful.arrival_levels, "arrivals")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, notices.arrival_levels(rows).collect()))


@pytest.mark.parametrize("size", [3, 7, 24])
def test_chunks_of_any_size(spark, tmp_path, size):
    body = "".join(f"data: {json.dumps({'choices': [{'delta': {'content': t}}]}, ensure_ascii=False)}\r\n\r\n" for t in (" é", "\n", "😀 x")) + "event: seal\r\ndata: S\r\n\r\ndata: [DONE]"
    raw = body.encode()
    parts = [raw[i : i + size] for i in range(0, len(raw), size)]
    rows = spark.createDataFrame([("x", i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)], "exchange_id string, chunk_no int, chunk binary, last boolean")
    half = len(parts) // 2
    got = run(spark, tmp_path, [rows.where(f"chunk_no < {half}"), rows.where(f"chunk_no >= {half}")], stateful.event_blocks, f"chunks{size}")
    streamed = got.groupBy("exchange_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda b: b["body"]), "").alias("body"))
    whole = wire.whole_chunks(rows.select("exchange_id", "chunk_no", "chunk"))
    a, b = (wire.accumulated(d, "chat-delta").first() for d in (streamed, whole))
    assert a == b and a["sealed_content"] == " é\n😀 x" and a["terminal_seal"] == "S"


def test_intervals(spark, tmp_path):
    rows = spark.sql("SELECT 'p' AS provider_id, timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, id) AS at, array(named_struct('type', 'x', 'severity', 2)) AS flags FROM range(4)")
    got = run(spark, tmp_path, [rows.where("at < timestamp'2024-01-02'"), rows.where("at >= timestamp'2024-01-02'")], lambda d: stateful.interval_rates(d, floor=1), "intervals")
    assert [(str(r["window_start"])[:10], r["evaluated_responses"], r["incident_rate"]) for r in got.orderBy("window_start").collect()] == [("2024-01-01", 1, 2.0), ("2024-01-02", 1, 2.0), ("2024-01-03", 1, 2.0)]


def test_progress_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([("scan", 1.7), ("scan", float("nan")), ("done", 0.5)], "stage string, activity double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = stateful.progress_frames(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    started = stateful.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    started.processAllAvailable()
    started.stop()
    assert sorted(r["activity"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [0.0, 0.5, 1.0]
