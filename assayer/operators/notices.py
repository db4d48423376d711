"""Notices and activity levels over a session's or stream's rows, which may be most of a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ledger import PART_ROWS
from assayer.plans import ordered, parts, stage

#: Arrivals: half-life in ms, what one adds, below what a level is none.
HALF_LIFE_MS, BUMP, FLOOR = 350.0, 0.6, 0.002
#: Composing: half-life in ms, what a character and a word add.
COMPOSE_HALF_LIFE_MS, COMPOSE_CHAR, COMPOSE_WORD = 700.0, 0.1, 0.32


def goes_up(notice: dict[str, Any], before: int | None, at_ms: int, in_warn_band: bool) -> bool:
    """Whether one delivery raises a notice last raised at ``before``."""
    trigger, repeat = notice.get("trigger") or "session_start", notice.get("repeatMinutes")
    if trigger in ("always", "on_warn"):
        return trigger == "always" or in_warn_band
    return before is None or bool(repeat and at_ms - before >= repeat * 60_000)


#: A session's time is cut in this many blocks at most, and a notice's repeat in this many, while next deliveries are looked up.
BLOCKS, OF_REPEAT = 4096, 64


def _next_delivery(times: DataFrame) -> DataFrame:
    """(s, n, at, next) of (s, n, at, repeat, width), distinct: the first time at least ``repeat`` after ``at``, where there is one.

    Times and sought times meet in blocks of ``width``; what a block doesn't hold is the first time of a block after it.
    """
    met = times.select("s", "n", F.col("at").alias("x"), F.lit(None).cast("long").alias("from"), "width").union(times.select("s", "n", F.col("at") + F.col("repeat"), "at", "width"))
    met = met.withColumn("block", F.floor(F.col("x") / F.col("width")))
    down = Window.partitionBy("s", "n", "block").orderBy(F.desc("x"), F.col("from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = met.withColumn("next", F.min(F.when(F.col("from").isNull(), F.col("x"))).over(down)).where("from is not null")
    # One row for each block of a session, so few.
    later = Window.partitionBy("s", "n").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = met.groupBy("s", "n", "block").agg(F.min(F.when(F.col("from").isNull(), F.col("x"))).alias("head")).withColumn("then", F.min("head").over(later))
    found = inside.join(heads.select("s", "n", "block", "then"), ["s", "n", "block"], "left")
    return found.select("s", "n", F.col("from").alias("at"), F.coalesce("next", "then").alias("next")).where("next is not null")


def _raise_times(deliveries: DataFrame, repeating: list[tuple[int, int]]) -> DataFrame:
    """(s, n, at): when each notice (number, repeat in ms) goes up in each session: first, then at the first delivery at least
    ``repeat`` after it last did.

    Each delivery points to the one that would be next after it; the pointers are doubled by self-joins, and the chain of
    the first delivery is found by going the same jumps down, so a session of any length takes log2 of its raises rounds.
    """
    spans = deliveries.groupBy("s").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r).cast("long").alias("repeat")) for n, r in repeating])).alias("k")
    starts = spans.select("s", kinds, F.col("first").alias("at")).select("s", "k.n", "at")
    width = F.greatest(F.lit(1), F.floor(F.col("k.repeat") / OF_REPEAT), F.ceil((F.col("last") - F.col("first")) / BLOCKS))
    times = deliveries.join(spans, "s").select("s", kinds, "at", "first", "last").select("s", "k.n", "at", "k.repeat", width.alias("width"))
    most = spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    jumps = [stage.saved(_next_delivery(stage.saved(times)))]
    # A chain has at most as many raises as repeats fit in its session.
    for _ in range((most // min(r for _, r in repeating)).bit_length()):
        last = jumps[-1]
        onward = last.select("s", "n", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps.append(stage.saved(last.join(onward, ["s", "n", "next"]).select("s", "n", "at", F.col("then").alias("next"))))
    found = stage.saved(starts)
    for jump in reversed(jumps):
        found = stage.saved(found.unionByName(found.join(jump, ["s", "n", "at"]).select("s", "n", F.col("next").alias("at"))))
    return found


def raised(deliveries: DataFrame, notices: list[dict[str, Any]], part_rows: int = PART_ROWS) -> DataFrame:
    """(session_id, at_ms, order_id, raised): ids of the notices each delivery pins.

    ``always`` is raised each time, ``on_warn`` in the warn band, others at a session's first delivery
    and again ``repeatMinutes`` after they were last raised.  Deliveries of one millisecond go by order_id; rows equal
    in session, time and order_id are one delivery.  Sessions of more than ``part_rows`` rows are not run through but
    found by pointers.
    """
    rows = deliveries.select("session_id", F.col("at_ms").cast("long").alias("at_ms"), F.col("order_id").cast("long").alias("order_id"), F.coalesce("in_warn_band", F.lit(False)).alias("in_warn_band"))
    return parts.by_size(rows, "session_id", part_rows, lambda r: _run_through(r, notices), lambda r: _by_pointers(r, notices))


def _run_through(rows: DataFrame, notices: list[dict[str, Any]]) -> DataFrame:
    def step(state: tuple[dict[str, int], Any, list[str]], row: dict[str, Any]) -> tuple[tuple, tuple]:
        last, before, out = state
        now = (row["at_ms"], row["order_id"])
        if now != before:
            out = [n["id"] for n in notices if goes_up(n, last.get(n["id"]), now[0], row["in_warn_band"])]
            last |= {i: now[0] for i in out}
        return (last, now, out), (row["session_id"], *now, out)

    return ordered.fold(rows, "session_id", ["at_ms", "order_id"], lambda: ({}, None, []), step, "session_id string, at_ms long, order_id long, raised array<string>")


def _by_pointers(deliveries: DataFrame, notices: list[dict[str, Any]]) -> DataFrame:
    rows = deliveries.withColumn("s", F.struct("session_id"))
    shown, timed = {}, []
    for i, n in enumerate(notices):
        trigger = n.get("trigger") or "session_start"
        if trigger in ("always", "on_warn"):
            shown[i] = F.lit(True) if trigger == "always" else F.coalesce("in_warn_band", F.lit(False))
        else:
            timed.append((i, int((n.get("repeatMinutes") or 0) * 60_000)))
            shown[i] = F.array_contains(F.coalesce("timed", F.array().cast("array<int>")), F.lit(i))
    if timed:
        rows = stage.saved(rows)
        times = stage.saved(rows.groupBy("s", F.col("at_ms").alias("at")).agg(F.min("order_id").alias("order_id")))
        once = times.groupBy("s").agg(F.min("at").alias("at")).withColumn("n", F.explode(F.array(*[F.lit(i) for i, _ in timed])))
        again = [(i, r) for i, r in timed if r]
        up = once.where(~F.col("n").isin([i for i, _ in again])).select("s", "n", "at") if again else once.select("s", "n", "at")
        if again:
            up = up.unionByName(_raise_times(times.select("s", "at"), again))
        # At most one of each notice comes together.
        at = up.groupBy("s", "at").agg(F.collect_set("n").alias("timed")).join(times, ["s", "at"]).select("s", F.col("at").alias("at_ms"), "order_id", "timed")
        rows = rows.join(at, ["s", "at_ms", "order_id"], "left")
    pinned = F.array_compact(F.array(*[F.when(shown[i], F.lit(n["id"])) for i, n in enumerate(notices)])) if notices else F.array().cast("array<string>")
    return rows.select("session_id", "at_ms", "order_id", pinned.alias("raised"))


def still_displayed(window_minutes: Column, raised_ms: Column, now_ms: Column) -> Column:
    return window_minutes.isNull() | (now_ms - raised_ms < window_minutes * 60_000)


def decayed(level: float, elapsed_ms: float, half_life: float = HALF_LIFE_MS) -> float:
    level *= 0.5 ** (max(0.0, elapsed_ms) / half_life)
    return 0.0 if level < FLOOR else level


#: Half-lives in a part of a stream: many times what a level needs to be forgotten.
PART_HALF_LIVES = 4096


def arrival_levels(arrivals: DataFrame, half_life: float = HALF_LIFE_MS, part_half_lives: int = PART_HALF_LIVES, part_rows: int = PART_ROWS) -> DataFrame:
    """(stream_id, at_ms, order_id, level) after each arrival of (stream_id, at_ms, order_id[, bump]); arrivals without a time are left out.

    A stream of more than ``part_rows`` arrivals is cut in parts of ``part_half_lives``.
    """
    bump = F.coalesce(F.col("bump").cast("double"), F.lit(0.0)) if "bump" in arrivals.columns else F.lit(BUMP)
    rows = arrivals.select("stream_id", F.col("at_ms").cast("long").alias("at_ms"), F.col("order_id").cast("long").alias("order_id"), bump.alias("bump")).where("at_ms is not null")
    part = F.floor(F.col("at_ms") / (half_life * part_half_lives))

    def step(state: tuple[float, int] | None, row: dict[str, Any]) -> tuple[tuple[float, int], tuple]:
        level = 0.0 if state is None else decayed(state[0], row["at_ms"] - state[1], half_life)
        level = min(1.0, level + row["bump"])
        return (level, row["at_ms"]), (row["stream_id"], row["at_ms"], row["order_id"], level)

    def whole(own: DataFrame) -> DataFrame:
        return ordered.fold(own, "stream_id", ["at_ms", "order_id"], lambda: None, step, "stream_id string, at_ms long, order_id long, level double")

    def split(own: DataFrame) -> DataFrame:
        return parts.decaying(own, "stream_id", "at_ms", ["at_ms", "order_id"], part, F.col("bump"), half_life, FLOOR, "level").drop("bump")

    return parts.by_size(rows, "stream_id", part_rows, whole, split)


def compose_bump(kind: Column, text: Column) -> Column:
    """What typing a character, finishing a word or pasting adds."""
    words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return F.when(kind == "char", COMPOSE_CHAR).when(kind == "word", COMPOSE_WORD).when(kind == "paste", COMPOSE_WORD * F.least(F.lit(4), F.greatest(F.lit(1), words)))


def clamped(activity: Column) -> Column:
    return F.when(F.isnan(activity) | activity.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), activity)))
