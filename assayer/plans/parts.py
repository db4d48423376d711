"""State machines over a key's ordered rows, cut in parts that run side by side.

A fold runs through a key's rows one after the other.  Here a part of the rows (a million numbers, an hour) is summed up
as what it makes of the state it is entered with; these summaries, one row for each part, are gone
through in order, and then every part is run again from its own entry.  No task holds a key, and results are those of the fold.
``part`` must not fall along the order; a null key or part is one of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from assayer.plans import ordered, stage


def by_size(rows: DataFrame, key: str, most: int, whole: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the keys of up to ``most`` rows, which one task may run through, and ``split`` of longer ones; both give the same rows."""
    name = stage.free_name(rows, "key")
    long = stage.saved(rows.groupBy(F.struct(key).alias(name)).count().where(F.col("count") > most).select(name))
    if stage.is_empty(long):
        return whole(rows)
    keyed = rows.withColumn(name, F.struct(key))
    # Each has more than ``most`` rows, so there are few.
    return whole(keyed.join(long, name, "left_anti").drop(name)).unionByName(split(keyed.join(long, name, "left_semi").drop(name)))


class _Runs:
    """Runs of equal (key, part) in sorted batches: where each starts and ends, its name, whether it goes on from the batch before."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def __call__(self, part: pa.StructArray) -> Iterator[tuple[int, int, tuple, bool]]:
        changed = np.zeros(max(0, len(part) - 1), bool)
        for field in part.flatten():
            codes = field.dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed |= codes[1:] != codes[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()] if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            name = tuple(part[a].as_py().values())
            yield a, b, name, name == self.last
            self.last = name


def _in_parts(rows: DataFrame, key: str, part: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.struct(F.col(key).alias("k"), part.cast("long").alias("p")))


def _kind(rows: DataFrame, name: str) -> str:
    return f"part {rows.schema[name].dataType.simpleString()}"


def _through(summaries: DataFrame, init: Callable[[], Any], step: Callable[[Any, dict[str, Any]], tuple[Any, tuple]], out: str) -> DataFrame:
    """The summaries (part, ...) of each key gone through in order; ``step`` makes (state, (entry values)) of each."""
    kind = summaries.schema["part"].dataType.simpleString()

    def one(state: Any, row: dict[str, Any]) -> tuple[Any, tuple]:
        state, made = step(state, row)
        return state, (row["part"], *made)

    # Folded by the struct of the key, so that null keys are told apart from none.
    flat = summaries.withColumns({"k": F.struct("part.k"), "p": F.col("part.p")})
    return ordered.fold(flat, "k", ["p"], init, one, f"part {kind}, {out}")


def _replayed(rows: DataFrame, name: str, entries: DataFrame, order: list[str | Column], run: Callable, out: StructType) -> DataFrame:
    """Rows and, first of each part, its entry row, dealt by part and sorted; ``run`` makes the batches of ``out``."""
    entry = stage.free_name(rows, "entry")
    given = entries.select(F.col("part").alias(name), F.struct(*[c for c in entries.columns if c != "part"]).alias(entry))
    both = rows.unionByName(given, allowMissingColumns=True)
    return both.repartition(name).sortWithinPartitions(name, F.col(entry).isNull(), *order).mapInArrow(run(name, entry), out)


def _prefixes(moves: np.ndarray) -> np.ndarray:
    """Of rows of maps from state to state, the map of all rows up to each, by doubling."""
    out, step = moves.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def _moves(column: pa.ListArray, states: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, states)


def automaton(df: DataFrame, key: str, order: list[str | Column], part: Column, moves: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with the state before each row as column ``name``; ``moves[s]`` is the state after a row that finds state s.

    A part's summary is the map of all states through it; maps compose, so they are found without knowing the entry.
    """
    states, p, m = len(moves), stage.free_name(df, "part"), stage.free_name(df, "moves")
    rows = stage.saved(_in_parts(df, key, part, p).withColumn(m, F.array(*[c.cast("int") for c in moves])))
    shape, columns = StructType([*df.schema.fields, StructField(name, IntegerType())]), df.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, now, kind = _Runs(), None, None
        for batch in batches:
            part_of, of_row, done = batch.column(0), _moves(batch.column(1), states), []
            kind = part_of.type
            for a, b, part_name, goes_on in runs(part_of):
                through = _prefixes(of_row[a:b])[-1]
                if not goes_on and now is not None:
                    done.append(now)
                now = (part_name, through[now[1]] if goes_on else through)
            if done:
                yield _maps(done, kind)
        if now is not None:
            yield _maps([now], kind)

    dealt = rows.repartition(p).sortWithinPartitions(p, *order).select(F.col(p).alias("part"), m)
    maps = dealt.mapInArrow(summed, f"{_kind(dealt, 'part')}, moves array<int>")
    entries = _through(maps, lambda: start, lambda state, row: (row["moves"][state], (state,)), "state int")

    def replay(part_name: str, entry: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs, state = _Runs(), start
            for batch in batches:
                part_of, entry_of = batch.column(part_name), batch.column(entry)
                is_row = entry_of.is_null().to_numpy(zero_copy_only=False)
                before = np.zeros(len(batch), np.int32)
                for a, b, _, _ in runs(part_of):
                    if not is_row[a]:
                        state = entry_of[a].as_py()["state"]
                        a += 1
                    if a < b:
                        after = _prefixes(_moves(batch.column(m).slice(a, b - a), states))[:, state]
                        before[a] = state
                        before[a + 1 : b] = after[:-1]
                        state = int(after[-1])
                kept = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(before)], names=[*columns, name])
                yield kept.filter(pa.array(is_row))

        return run

    return _replayed(rows, p, entries, order, replay, shape)


def _maps(found: list[tuple[tuple, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    parts = pa.array([dict(zip(("k", "p"), part)) for part, _ in found], kind)
    return pa.RecordBatch.from_arrays([parts, pa.array([m.tolist() for _, m in found], pa.list_(pa.int32()))], ["part", "moves"])


def _levels(faded: list[float], bumps: list[float], floor: float, level: float) -> list[float]:
    out = []
    for f, bump in zip(faded, bumps):
        level *= f
        if level < floor:
            level = 0.0
        level += bump
        if level > 1.0:
            level = 1.0
        out.append(level)
    return out


def decaying(df: DataFrame, key: str, at: str, order: list[str | Column], part: Column, bump: Column, half_life: float, floor: float, name: str) -> DataFrame:
    """``df`` with a level after each row as column ``name``: what was left of the level before, halved every ``half_life`` of ``at``
    and none below ``floor``, and the row's bump (null: none), 1 at most.

    A part is run from no level and from the highest.  A level never falls when the one before rises, so where both runs meet
    every other does: that is so after a pause that takes any level below the floor, after a stretch at the top,
    and within some 60 half-lives anyway.  Parts whose runs don't meet and that are not entered at none or at the
    top are run again from their entry, in rounds, until every entry is known.
    """
    p, b, faded, columns = stage.free_name(df, "part"), stage.free_name(df, "bump_"), stage.free_name(df, name), df.columns
    rows = stage.saved(_in_parts(df, key, part, p).withColumn(b, F.coalesce(bump.cast("double"), F.lit(0.0))))

    def fade(times: list[int], last: int | None) -> list[float]:
        before = [times[0] if last is None else last, *times[:-1]]
        return [0.5 ** (max(0.0, t - s) / half_life) for s, t in zip(before, times)]

    summary = f"{_kind(rows.select(F.col(p).alias('part')), 'part')}, first long, last long, low double, high double"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, now, kind = _Runs(), None, None
        for batch in batches:
            kind, times, bumps, done = batch.column(0).type, batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            given = batch.column(3).to_pylist()
            for i, j, part_name, goes_on in runs(batch.column(0)):
                if not goes_on:
                    if now is not None:
                        done.append(now)
                    now = {"part": dict(zip(("k", "p"), part_name)), "first": times[i], "last": None, "low": 0.0 if given[i] is None else given[i], "high": 1.0 if given[i] is None else given[i]}
                f = fade(times[i:j], now["last"])
                now |= {"low": _levels(f, bumps[i:j], floor, now["low"])[-1], "high": _levels(f, bumps[i:j], floor, now["high"])[-1], "last": times[j - 1]}
            if done:
                yield _ends(done, kind)
        if now is not None:
            yield _ends([now], kind)

    def summaries(of: DataFrame, entry: Column) -> DataFrame:
        dealt = of.repartition(p).sortWithinPartitions(p, *order)
        return dealt.select(F.col(p).alias("part"), F.col(at).cast("long").alias("at"), F.col(b).alias("bump"), entry.alias("entry")).mapInArrow(summed, summary)

    def entered(state: dict | None, row: dict[str, Any]) -> tuple[dict, tuple]:
        """The level at a part's first row before its bump; null where it hangs on a part not settled yet."""
        if state is None:
            level = 0.0
        else:
            left = 0.5 ** (max(0.0, row["first"] - state["last"]) / half_life)
            level = None if state["level"] is None else state["level"] * left
            # From the top on down nothing is left: the entry is known whatever the level was.
            level = 0.0 if left < floor or (level is not None and level < floor) else level
        met = row["low"] == row["high"]
        leaves = row["low"] if met or level == 0.0 else row["high"] if level == 1.0 else None
        return {"level": leaves, "last": row["last"]}, (level, leaves)

    ends = stage.saved(summaries(rows, F.lit(None).cast("double")))
    while True:
        entries = stage.saved(_through(ends, lambda: None, entered, "level double, leaves double"))
        if stage.is_empty(entries.where("level is null")):
            break
        # Each round settles the first open part of every stretch, at least.
        ready = entries.where("level is not null and leaves is null").select(F.col("part").alias(p), F.col("level").alias(faded))
        again = summaries(rows.join(ready, p), F.col(faded))
        ends = stage.saved(ends.join(again.select("part"), "part", "left_anti").unionByName(again))

    def replay(part_name: str, entry: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs, level, last = _Runs(), 0.0, None
            for batch in batches:
                entry_of = batch.column(entry)
                is_row = entry_of.is_null().to_numpy(zero_copy_only=False)
                times, bumps, out = batch.column(at).to_pylist(), batch.column(b).to_pylist(), [0.0] * len(batch)
                for i, j, _, goes_on in runs(batch.column(part_name)):
                    if not goes_on:
                        level, last = entry_of[i].as_py()["level"], None
                        i += 1
                    if i < j:
                        out[i:j] = _levels(fade(times[i:j], last), bumps[i:j], floor, level)
                        level, last = out[j - 1], times[j - 1]
                kept = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.float64())], names=[*columns, name])
                yield kept.filter(pa.array(is_row))

        return run

    return _replayed(rows, p, entries.select("part", "level"), order, replay, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def _ends(found: list[dict[str, Any]], kind: pa.DataType) -> pa.RecordBatch:
    shape = pa.schema([("part", kind), ("first", pa.int64()), ("last", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
    return pa.RecordBatch.from_pylist(found, shape)
