"""Ordered folds over keys, with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from assayer.plans.stage import free_name


def fold(df: DataFrame, key: str, order: list[str | Column], init: Callable[[], Any], step: Callable[[Any, dict[str, Any]], tuple[Any, tuple]], schema: str) -> DataFrame:
    """One output row for each row, from a state that runs through each key's rows in order.

    For rules whose state depends on their own decisions.  Keys are dealt to tasks once and sorted
    there; a task holds one state and one batch, however long a key's sequence is.  Everything that
    doesn't depend on the state is better computed in columns before.
    """
    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        begun, state = False, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    begun, now, state = True, row[key], init()
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def numbered(df: DataFrame, key: str, order: list[str | Column], part: Column, name: str) -> DataFrame:
    """Row numbers from 1 within each key, where no task holds a key: rows are numbered within (key, part) and each part
    goes on from the sizes of the parts before it.  ``part`` must not fall along the order (a day of the time, a thousand ids).
    """
    own_part, place, size, start = (free_name(df, n) for n in ("part_", "place_", "size_", "start_"))
    own = df.withColumn(own_part, F.struct(F.col(key).alias("k"), part.alias("p")))
    sizes = own.groupBy(own_part).agg(F.count("*").alias(size))
    before = Window.partitionBy(f"{own_part}.k").orderBy(f"{own_part}.p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(own_part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    # Structs are equal where both hold null, so a null key or part finds its start.
    inside = own.withColumn(place, F.row_number().over(Window.partitionBy(own_part).orderBy(*order)))
    return inside.join(starts, own_part).withColumn(name, F.col(start) + F.col(place)).drop(own_part, place, start)


def rolling(df: DataFrame, key: str, order: str, part: Column, n: int, measures: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Columns over a window that reads at most ``n`` rows before each row, where no task holds a key.

    A window within (key, part) is right for all but the first ``n`` rows of a part; these are read again in a window over the
    first and last ``n`` rows of each part, which hold all they need.  ``part`` must not fall along the order.
    """
    own_part, place, last = (free_name(df, n) for n in ("part_", "place_", "last_"))
    inside, across = Window.partitionBy(key, own_part).orderBy(order), Window.partitionBy(key).orderBy(order)
    places = {place: F.row_number().over(inside), last: F.lead(F.lit(True), n).over(inside).isNull()}
    done = df.withColumn(own_part, part).withColumns(places | measures(inside))
    edges = done.where((F.col(place) <= n) | F.col(last)).withColumns(measures(across))
    return done.where(F.col(place) > n).unionByName(edges.where(F.col(place) <= n)).drop(own_part, place, last)
