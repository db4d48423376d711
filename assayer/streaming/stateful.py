"""Structured Streaming forms of the ordered rules; each uses the step function of its batch operator.

Rows of a key must come in order across micro-batches, as they do from a source partitioned by key;
within one they are sorted.  State is what the batch fold carries: a number, a level, a buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.functions.flags import instant_score
from assayer.functions.wire import split_events
from assayer.operators import gate, notices


def decisions(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """``gate.decisions`` on a stream: the state of a provider is its clean responses still to come and the last seq decided.

    A row at or before that seq came too late to be decided in its place: it comes out as ``out_of_order`` and changes nothing.
    """
    carryover = policy["carryover"]

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        remaining, last = state.get if state.exists else (0, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
            row["fixed"] = row["fixed"] if isinstance(row["fixed"], str) else None
            if last is not None and row["seq"] <= last:
                made = ("out_of_order", None, None, remaining)
            else:
                remaining, made = gate.step(remaining, row, carryover)
                last = row["seq"]
            out.append((key[0], row["seq"], row["response_id"], row["score"], *made))
        state.update((remaining, last))
        yield pd.DataFrame(out, columns=["provider_id", "seq", "response_id", "score", "outcome", "effective_warn", "effective_block", "clean_remaining"])

    schema = "provider_id string, seq long, response_id string, score double, outcome string, effective_warn double, effective_block double, clean_remaining int"
    return rows.groupBy("provider_id").applyInPandasWithState(one, schema, "remaining int, last long", "append", GroupStateTimeout.NoTimeout)


def arrival_levels(arrivals: DataFrame, half_life: float = notices.HALF_LIFE_MS) -> DataFrame:
    """``notices.arrival_levels`` on a stream of (stream_id, at_ms, order_id)."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, at = state.get if state.exists else (0.0, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["at_ms", "order_id"]).to_dict("records"):
            level = 0.0 if at is None else notices.decayed(level, row["at_ms"] - at, half_life)
            level, at = min(1.0, level + notices.BUMP), row["at_ms"]
            out.append((key[0], at, row["order_id"], level))
        state.update((float(level), int(at)))
        yield pd.DataFrame(out, columns=["stream_id", "at_ms", "order_id", "level"])

    return arrivals.groupBy("stream_id").applyInPandasWithState(one, "stream_id string, at_ms long, order_id long, level double", "level double, at long", "append", GroupStateTimeout.NoTimeout)


def event_blocks(chunks: DataFrame) -> DataFrame:
    """(exchange_id, at, body): complete event blocks of (exchange_id, chunk_no, chunk binary, last boolean), numbered in
    served order, each to be read by ``wire.events``.

    Bytes are buffered, so a character or a line break cut by a chunk boundary is put together; an exchange's
    ``last`` chunk releases what has no blank line after it and its state.
    """

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, at = state.get if state.exists else (b"", 0)
        buffer, out, closed = bytes(buffer), [], False
        for row in pd.concat(list(frames)).sort_values("chunk_no").to_dict("records"):
            buffer += bytes(row["chunk"])
            closed = closed or bool(row["last"])
        keep = 0 if closed else 4
        # Up to four bytes at the end may be half a character or half a line break.
        cut = max(0, len(buffer) - keep)
        while 0 < cut < len(buffer) and (buffer[cut] & 0xC0 == 0x80 or buffer[cut - 1 : cut + 1] == b"\r\n"):
            cut -= 1
        blocks, rest = split_events(buffer[:cut].decode("utf-8", "replace"))
        if closed and rest.strip():
            blocks, rest = [*blocks, rest], ""
        for block in blocks:
            out.append((key[0], at, block + "\n\n"))
            at += 1
        if closed:
            state.remove()
        else:
            state.update((rest.encode() + buffer[cut:], at))
        yield pd.DataFrame(out, columns=["exchange_id", "at", "body"])

    return chunks.groupBy("exchange_id").applyInPandasWithState(one, "exchange_id string, at long, body string", "buffer binary, at long", "append", GroupStateTimeout.NoTimeout)


def interval_rates(ledger: DataFrame, interval: str = "24 hours", lateness: str = "1 hour", floor: int = 20) -> DataFrame:
    """Telemetry of each provider and interval of a ledger stream, sent when the watermark has passed it."""
    out = ledger.withWatermark("at", lateness).groupBy(F.window("at", interval), "provider_id").agg(F.count("*").alias("evaluated_responses"), F.sum(instant_score(F.col("flags"))).alias("severity_weighted_incidents"))
    suppressed = F.col("evaluated_responses") < floor
    rate = F.when(~suppressed, F.col("severity_weighted_incidents") / F.col("evaluated_responses"))
    return out.select("provider_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "evaluated_responses", "severity_weighted_incidents", rate.alias("incident_rate"), suppressed.alias("suppressed"))


def progress_frames(stages: DataFrame) -> DataFrame:
    """(kind, stage, activity): progress rows for a sink, activity between 0 and 1."""
    return stages.select(F.lit("progress").alias("kind"), "stage", notices.clamped(F.col("activity")).alias("activity"))


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> Any:
    """Appends each micro-batch as JSON under its number, so a repeated batch replaces itself; returns the started query."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").start()
