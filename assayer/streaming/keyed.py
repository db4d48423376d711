"""Keyed state with timers: notices, usual durations, sliding scores and whole exchanges on streams.

Rows may come in any order and any cut in micro-batches: each waits in its key's state until the watermark has passed
it, then rows are taken in the order of their time, so results are those of the batch operators.  Rows later than the
watermark are dropped by Spark and count nowhere; rows without a time are left out.  State goes by timers of event time,
not by the clock, so that a replay gives what the first run gave.

The session needs ``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's (``ROCKS``); inputs have a column ``at``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayer.functions.flags import instant_score
from assayer.operators import notices as rules
from assayer.operators.scoring import AHEAD_US

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame, key: str | list[str], lateness: str, columns: list[F.Column], processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    timed = stream.where("at is not null").withWatermark("at", lateness).select(*keys, "at", F.unix_micros("at").alias("us"), *columns)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")


class InOrder(StatefulProcessor):
    """Holds rows (us, ...) back until the watermark is ``ahead`` past them, then gives them to ``take`` in order, with those still to wait.

    A key idle for ``idle`` ms is forgotten: ``forget`` drops what the subclass keeps.
    """

    fields: list[str]
    kinds: str
    made: list[str]
    ahead = 0
    idle: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.last = handle.getValueState("last", "us long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def take(self, key: tuple, rows: list[tuple], rest: list[tuple], limit: int) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None: ...

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if x is None or x != x else x for x in r) for f in rows for r in f[self.fields].itertuples(index=False, name=None)]
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer((min(r[0] for r in fresh) + self.ahead) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: [(x is not None, x) for x in r]) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] + self.ahead <= limit], [r for r in rows if r[0] + self.ahead > limit]
        if ready:
            out = self.take(key, ready, rest, limit)
            self.last.update((ready[-1][0],))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer((rest[0][0] + self.ahead) // 1000)
            else:
                self.waiting.clear()
            if self.idle is not None:
                self.handle.registerTimer(ready[-1][0] // 1000 + self.idle)
            if out:
                yield pd.DataFrame(out, columns=self.made)
        if not rest and self.idle is not None and self.last.exists() and self.last.get()[0] + self.idle * 1000 <= limit:
            self.last.clear()
            self.forget()

    def close(self) -> None: ...


class _Notices(InOrder):
    fields, kinds = ["us", "order_id", "in_warn_band"], "us long, order_id long, in_warn_band boolean"
    made = ["session_id", "at_ms", "order_id", "raised"]

    def __init__(self, notices: list[dict[str, Any]], idle: int) -> None:
        self.notices, self.idle = notices, idle

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.raised = handle.getMapState("raised", "id string", "at_ms long")

    def take(self, key: tuple, rows: list[tuple], rest: list[tuple], limit: int) -> list[tuple]:
        before = {i[0]: at[0] for i, at in self.raised.iterator()} if self.raised.exists() else {}
        out = []
        for us, order, warn in rows:
            up = [n["id"] for n in self.notices if rules.goes_up(n, before.get(n["id"]), us // 1000, bool(warn))]
            before |= {i: us // 1000 for i in up}
            out.append((key[0], us // 1000, order, up))
        for n in self.notices:
            # ``always`` and ``on_warn`` need no memory.
            if n["id"] in before and (n.get("trigger") or "session_start") not in ("always", "on_warn"):
                self.raised.updateValue((n["id"],), (before[n["id"]],))
        return out

    def forget(self) -> None:
        self.raised.clear()


def raised(deliveries: DataFrame, notices: list[dict[str, Any]], session_idle_ms: int, lateness: str = "1 minute") -> DataFrame:
    """``notices.raised`` on a stream of (session_id, at, order_id, in_warn_band); a session idle for ``session_idle_ms`` is over,
    its state removed, and deliveries under its id begin another one."""
    columns = [F.col("order_id").cast("long").alias("order_id"), "in_warn_band"]
    return _keyed(deliveries, "session_id", lateness, columns, _Notices(notices, session_idle_ms), "session_id string, at_ms long, order_id long, raised array<string>")


class _Durations(StatefulProcessor):
    """The last durations of a provider's model by (time, response), whatever order they come in."""

    def __init__(self, last: int, fewest: int, idle: int) -> None:
        self.count, self.fewest, self.idle = last, fewest, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long, response_id string, duration_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = [r for f in rows for r in f[["us", "response_id", "duration_ms"]].itertuples(index=False, name=None)]
        kept = sorted([*(self.kept.get() if self.kept.exists() else ()), *fresh])[-self.count :]
        self.kept.put(kept)
        self.handle.registerTimer(kept[-1][0] // 1000 + self.idle)
        d, n = sorted(k[2] for k in kept), len(kept)
        typical = None if n < self.fewest else float(d[n // 2]) if n % 2 else float((d[n // 2 - 1] + d[n // 2] + 1) // 2)
        yield pd.DataFrame({"provider_id": [key[0]], "model": [key[1]], "samples": [n], "typical_ms": [typical]})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A timer of an older row fires too; only the last row's says that the key is idle.
        if self.kept.exists() and max(k[0] for k in self.kept.get()) // 1000 + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.kept.clear()
        return iter(())

    def close(self) -> None: ...


def typical_duration(durations: DataFrame, idle_ms: int, last: int = 20, fewest: int = 3, lateness: str = "1 minute") -> DataFrame:
    """``scoring.typical_duration`` on a stream of (provider_id, model, at, response_id, duration_ms): in each micro-batch the
    present row of each key it brings rows of (update mode); a key idle for ``idle_ms`` is forgotten."""
    columns = ["response_id", F.col("duration_ms").cast("long").alias("duration_ms")]
    return _keyed(durations, ["provider_id", "model"], lateness, columns, _Durations(last, fewest, idle_ms), "provider_id string, model string, samples long, typical_ms double", "update")


class _CountWindow(InOrder):
    fields, kinds = ["us", "seq", "instant_score"], "us long, seq long, instant_score long"
    made = ["provider_id", "seq", "instant_score", "window_score", "window_size"]

    def __init__(self, n: int, idle: int | None) -> None:
        self.n, self.idle = n, idle

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "instant_score long")

    def take(self, key: tuple, rows: list[tuple], rest: list[tuple], limit: int) -> list[tuple]:
        ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        out = []
        for _, seq, own in rows:
            out.append((key[0], seq, own, sum(ring), len(ring)))
            ring = [*ring, own][-self.n :]
        self.ring.put([(x,) for x in ring])
        return out

    def forget(self) -> None:
        self.ring.clear()


def count_window(ledger: DataFrame, n: int = 10, idle_ms: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """``scoring.count_window`` on a stream of (provider_id, seq, at, flags), numbered along their time; ``idle_ms`` bounds how long a
    silent provider's last ``n`` are kept (default: for good, ``n`` numbers a provider)."""
    return _keyed(ledger, "provider_id", lateness, ["seq", instant_score(F.col("flags")).alias("instant_score")], _CountWindow(n, idle_ms), "provider_id string, seq long, instant_score long, window_score long, window_size long")


class _TimeWindow(InOrder):
    fields, kinds, made = _CountWindow.fields, _CountWindow.kinds, _CountWindow.made
    ahead = AHEAD_US - 1

    def __init__(self, span: int) -> None:
        self.span, self.idle = span, span // 1000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "us long, instant_score long")

    def take(self, key: tuple, rows: list[tuple], rest: list[tuple], limit: int) -> list[tuple]:
        # What lies ahead still waits; it is read, not taken.
        near = [r for r in rest if r[0] <= rows[-1][0] + self.ahead]
        before = [tuple(r) for r in self.seen.get()] if self.seen.exists() else []
        line = sorted([*before, *((us, own) for us, _, own in rows), *((us, own) for us, _, own in near)])
        sums = [0]
        for _, own in line:
            sums.append(sums[-1] + own)
        out, low, high = [], 0, 0
        for us, seq, own in rows:
            while low < len(line) and line[low][0] < us - self.span:
                low += 1
            while high < len(line) and line[high][0] <= us + self.ahead:
                high += 1
            out.append((key[0], seq, own, sums[high] - sums[low] - own, high - low - 1))
        # Whatever still comes is later than the watermark less what lies ahead.
        oldest = limit - self.ahead - self.span
        taken = sorted([*before, *((us, own) for us, _, own in rows)])
        self.seen.put([r for r in taken if r[0] >= oldest] or [taken[-1]])
        return out

    def forget(self) -> None:
        self.seen.clear()


def time_window(ledger: DataFrame, hours: int = 24, lateness: str = "1 minute") -> DataFrame:
    """``scoring.time_window`` on a stream of (provider_id, seq, at, flags): a row comes out a second after the watermark has passed it, and
    rows older than the window leave the state; a provider silent for as long is forgotten."""
    return _keyed(ledger, "provider_id", lateness, ["seq", instant_score(F.col("flags")).alias("instant_score")], _TimeWindow(hours * 3_600_000_000), "provider_id string, seq long, instant_score long, window_score long, window_size long")


def _text_at(event: Any, path: list[str | int]) -> str | None:
    for step in path:
        try:
            event = event[step]
        except (KeyError, IndexError, TypeError):
            return None
    return event if isinstance(event, str) else None


def _said(binding: str, event: Any) -> str:
    """What an event adds to the text, as ``wire.BINDINGS`` has it."""
    if binding == "chat-delta":
        return _text_at(event, ["choices", 0, "delta", "content"]) or ""
    if _text_at(event, ["type"]) == "content_block_delta" and _text_at(event, ["delta", "type"]) == "text_delta":
        return _text_at(event, ["delta", "text"]) or ""
    return ""


OPEN, SEALED, LATE, CLOSED = "open", "sealed", "late", "closed"


class _Exchanges(StatefulProcessor):
    """An exchange is open until its seal, then sealed, and late once anything follows the seal; its end marker or a pause closes it."""

    def __init__(self, binding: str, seal_event: str, pre_seal_event: str, idle: int) -> None:
        self.binding, self.seal_event, self.pre_seal_event, self.idle = binding, seal_event, pre_seal_event, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, next long, last_us long, buffer binary, seal string, several boolean")
        self.parts = handle.getListState("parts", "text string")
        self.early = handle.getMapState("early", "chunk_no long", "chunk binary, last boolean")

    def _event(self, block: str, m: dict[str, Any]) -> str:
        """What a block adds to the text; the machine moves on."""
        kind, data = "", []
        for line in block.strip().split("\n"):
            if line.startswith("event:"):
                kind = line[6:].strip()
            elif line.startswith("data:"):
                data.append(line[5:].removeprefix(" "))
        value = "\n".join(data)
        if value == "[DONE]" or kind == self.pre_seal_event:
            return ""
        if kind == self.seal_event:
            m["several"], m["seal"] = m["several"] or m["state"] != OPEN, value
            m["state"] = SEALED if m["state"] == OPEN else m["state"]
            return ""
        try:
            event = json.loads(value)
        except ValueError:
            return ""
        if m["state"] != OPEN:
            m["state"] = LATE
            return ""
        return _said(self.binding, event)

    def _read(self, m: dict[str, Any], more: bytes, whole: bool) -> None:
        raw = m["buffer"] + more
        # Up to four bytes at the end may be half a character or half a line break.
        cut = len(raw) if whole else max(0, len(raw) - 4)
        while 0 < cut < len(raw) and (raw[cut] & 0xC0 == 0x80 or raw[cut - 1 : cut + 1] == b"\r\n"):
            cut -= 1
        blocks = raw[:cut].decode("utf-8", "replace").replace("\r\n", "\n").split("\n\n")
        rest = "" if whole else blocks.pop()
        added = "".join(self._event(b, m) for b in blocks if b.strip())
        if added:
            self.parts.appendValue((added,))
        m["buffer"] = rest.encode() + raw[cut:]

    def _closed(self, key: tuple, m: dict[str, Any], how: str) -> pd.DataFrame:
        self._read(m, b"", True)
        text = "".join(p[0] for p in self.parts.get()) if self.parts.exists() else ""
        for state in (self.machine, self.parts, self.early):
            state.clear()
        if how == "end":
            # Remembered until the timer, so that chunks sent again open no second exchange.
            self.machine.update((CLOSED, m["next"], m["last_us"], b"", None, False))
        return pd.DataFrame({"exchange_id": [key[0]], "sealed_content": [text], "terminal_seal": [m["seal"]], "content_after_seal": [m["state"] == LATE], "several_seals": [m["several"]], "closed_by": [how]})

    def _held(self) -> dict[str, Any]:
        names = ("state", "next", "last_us", "buffer", "seal", "several")
        held = self.machine.get() if self.machine.exists() else (OPEN, 0, 0, b"", None, False)
        return dict(zip(names, held)) | {"buffer": bytes(held[3])}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        m, done = self._held(), False
        for f in rows:
            for us, number, chunk, last in f[["us", "chunk_no", "chunk", "last"]].itertuples(index=False, name=None):
                m["last_us"] = max(m["last_us"], us)
                if number >= m["next"] and m["state"] != CLOSED:
                    self.early.updateValue((int(number),), (bytes(chunk), bool(last)))
        # Chunks are read in their order; one that came too early waits for those before it.
        while not done and self.early.exists() and self.early.containsKey((m["next"],)):
            chunk, done = self.early.getValue((m["next"],))
            self.early.removeKey((m["next"],))
            self._read(m, bytes(chunk), False)
            m["next"] += 1
        if done:
            yield self._closed(key, m, "end")
        else:
            self.machine.update(tuple(m.values()))
        self.handle.registerTimer(m["last_us"] // 1000 + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        m = self._held()
        if not self.machine.exists() or m["last_us"] // 1000 + self.idle > timerValues.getCurrentWatermarkInMs():
            return
        if m["state"] == CLOSED:
            self.machine.clear()
        else:
            # What lies beyond a missing chunk can't be read in order and is left out.
            yield self._closed(key, m, "timeout")

    def close(self) -> None: ...


def exchanges(chunks: DataFrame, binding: str, idle_ms: int, seal_event: str = "seal", pre_seal_event: str = "pre-seal", lateness: str = "1 minute") -> DataFrame:
    """``wire.accumulated`` on a stream of (exchange_id, at, chunk_no from 0, chunk binary, last): one row when an exchange closes, by its
    last chunk or, without one, ``idle_ms`` after its latest; ``closed_by`` says which.

    Content after the seal is not kept, only that it came (``content_after_seal``): such an exchange must be refused.
    """
    columns = [F.col("chunk_no").cast("long").alias("chunk_no"), "chunk", F.coalesce("last", F.lit(False)).alias("last")]
    schema = "exchange_id string, sealed_content string, terminal_seal string, content_after_seal boolean, several_seals boolean, closed_by string"
    return _keyed(chunks, "exchange_id", lateness, columns, _Exchanges(binding, seal_event, pre_seal_event, idle_ms), schema)
