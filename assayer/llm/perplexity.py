"""Quality by the perplexity of an interpolated modified Kneser-Ney model (operator 8).

The model is one of characters, five in a row: its n-grams cover any script and word form and
stay few beside the text.  All trusted documents but those held out for the thresholds are
counted, each task adding up its own n-grams before the shuffle.  Lower orders count the
different left neighbours of an n-gram; three discounts for each order come from the numbers of
n-grams seen once to four times; probabilities and back-off weights are joins of the count
tables, sharded by n-gram, from order to order.

Scoring looks every position of every whole document up, and the model stays sharded whatever its size.  Documents are dealt
to blocks of some ``BLOCK`` characters and kept, compressed, in a table bucketed by block, so they are never shuffled; the different n-grams of
each block are looked for.  Those of all blocks
are resolved once each, order by order from the lowest, by joins with the count tables: an
n-gram that was seen has its own probability, another one that of its last characters times the weight of its context.  The answers
go back to the blocks that asked, beside their texts, so a task holds the n-grams of one block at most.

A document is kept if its perplexity is at most the ``quantile`` of the held-out trusted documents of
its language (of all of them, where its language has fewer than ``FEWEST``).

Rows: a null or empty text has no perplexity and isn't kept; a null language is one of its own; labels
without a document and null ids are not used; without held-out trusted documents nothing is judged and all but
empty texts are kept; repeated rows are scored each and counted each.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import _graph, _text

ORDER = 5
BLOCK = 1 << 25
#: Buckets of the table of texts, and files it may be written as without a shuffle, at most.
BUCKETS, FILES = 10_000, 100_000
QUANTILE = 0.98
#: So many held-out texts at least set a threshold: with fewer the quantile is their maximum.
FEWEST = 50
HELD_OUT = 5
_FLUSH = 500_000


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``ORDER - 1`` start marks, and where each text begins."""
    parts = [np.frombuffer(("\x02" * (ORDER - 1) + (t or "")).encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
    codes = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint64)
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    real = np.ones(len(codes), bool)
    for j in range(ORDER - 1):
        real[begins[:-1] + j] = False
    codes[real & (codes < 9)] = 0xFFFD
    return codes, begins


_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(ORDER)]


def _last_keys(codes: np.ndarray) -> np.ndarray:
    """For each position, the key of the ``ORDER`` characters that end there."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes), np.uint64)
        for j, factor in enumerate(_FACTORS):
            total[j:] += codes[: len(codes) - j] * factor
        return _text.mix(total)


def _keys_of(grams: np.ndarray) -> np.ndarray:
    """The same keys, of n-grams in rows."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(grams), np.uint64)
        for j, factor in enumerate(_FACTORS):
            total += grams[:, ORDER - 1 - j].astype(np.uint64) * factor
        return _text.mix(total)


def count_ngrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): all runs of ``ORDER`` characters, with start marks before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, grams, counts = np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_names(grams), pa.string()), pa.array(counts, pa.int64())], ["gram", "n"])

        for batch in batches:
            for a, b in _text.runs(batch.column(0)):
                rows, number, _ = _distinct(*_codes(batch.column(0).slice(a, b - a)))
                n = np.bincount(number, minlength=len(rows))
                merged, first, number = np.unique(np.concatenate((keys, _keys_of(rows))), return_index=True, return_inverse=True)
                counts = np.bincount(number, np.concatenate((counts, n)), len(merged)).astype(np.int64)
                grams, keys = np.concatenate((grams, rows))[first], merged
                if len(keys) > _FLUSH:
                    yield out()
                    keys, grams, counts = keys[:0], grams[:0], counts[:0]
        if len(keys):
            yield out()

    return docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05 if i > 1 else 0.95) for i, d in zip((1, 2, 3), raw))


class Model:
    """By order k: ``p[k]`` (gram, p) the logarithm of an n-gram's probability, ``g[k]`` (context, g) that of the weight of what
    follows the context in the order below; ``none`` that of a character that was never seen."""

    def __init__(self) -> None:
        self.p: dict[int, DataFrame] = {}
        self.g: dict[int, DataFrame] = {}
        self.none = 0.0


def build(counts: DataFrame) -> Model:
    orders = {ORDER: _graph.saved(counts)}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = _graph.saved(orders[k + 1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("n")))
    model = Model()
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = orders[k].select("gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), "n", discount.alias("d"))
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        own = own.join(contexts, "context")
        if k == 1:
            # What no character has: shared by all seen ones and one for all others.
            size = orders[1].count() + 1
            lower: Column = F.lit(1.0 / size)
            whole = contexts.first()
            model.none = math.log(whole["taken"] / whole["total"] / size) if whole and whole["taken"] > 0 else -math.log(size)
        else:
            own = own.join(model.p[k - 1].select(F.col("gram").alias("suffix"), F.exp("p").alias("lower")), F.expr(f"substring(gram, 2, {k - 1})") == F.col("suffix"))
            lower = F.col("lower")
            model.g[k] = _graph.saved(contexts.select("context", F.log(F.col("taken") / F.col("total")).alias("g")))
        model.p[k] = _graph.saved(own.select("gram", F.log((F.col("n") - F.col("d") + F.col("taken") * lower) / F.col("total")).alias("p")))
    _graph.free(*orders.values())
    return model


def resolved(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p): the logarithm of the probability of the last character of each of the distinct ``grams`` of ``ORDER``
    characters after the others."""
    asked = {ORDER: grams.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = _graph.saved(asked[k + 1].select(F.expr(f"substring(gram, 2, {k})").alias("gram")).distinct())
    below = None
    for k in range(1, ORDER + 1):
        own = asked[k].join(model.p[k], "gram", "left")
        if below is None:
            out = own.select("gram", F.coalesce("p", F.lit(model.none)).alias("p"))
        else:
            own = own.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})"))
            own = own.join(model.g[k], "context", "left").join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            out = own.select("gram", F.coalesce("p", F.coalesce("g", F.lit(0.0)) + F.col("lower")).alias("p"))
        below = _graph.saved(out)
    return below


def _distinct(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of ``ORDER`` characters (one row each), the number of each position's, and the positions by text."""
    own = np.ones(len(codes), bool)
    for j in range(ORDER - 1):
        own[begins[:-1] + j] = False
    own = np.flatnonzero(own)
    number, keys = pd.factorize(_last_keys(codes)[own])
    first = np.empty(len(keys), np.int64)
    first[number[::-1]] = own[::-1]
    return np.stack([codes[first - ORDER + 1 + j] for j in range(ORDER)], 1).astype(np.uint32), number, np.diff(begins) - (ORDER - 1)


def _names(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().tolist()


_SCORED = "doc_id long, lang string, perplexity double"


def _packed(given: DataFrame, blocks: int) -> DataFrame:
    """(block, texts): runs of rows as compressed Arrow streams, dealt to blocks; a table in the shared folder, bucketed by block, so that
    both its readers find a block's texts in one task without a shuffle.

    Beyond ``BUCKETS`` blocks a bucket holds several.  Each task may write a file for each bucket; where these would be more than
    ``FILES``, the compressed texts are shuffled by block first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(2)):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as stream:
                    stream.write_batch(pa.RecordBatch.from_arrays([c.slice(a, b - a).cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["texts"])

    spark, name, buckets = given.sparkSession, f"assayer_{uuid.uuid4().hex}", min(blocks, BUCKETS)
    rows = given.mapInArrow(run, "texts binary").select(F.pmod(F.xxhash64("texts"), F.lit(blocks)).alias("block"), "texts")
    if buckets * given.rdd.getNumPartitions() > FILES:
        rows = rows.repartition(buckets, "block")
    path = f"{_graph.shared_folder(spark).rstrip('/')}/{name}"
    try:
        rows.write.bucketBy(buckets, "block").format("parquet").option("compression", "uncompressed").option("path", path).saveAsTable(name)
        table = spark.table(name)
    except Exception:
        _drop(spark, name, path)
        raise
    table._named, table._saved_at = name, path
    return table


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _opened(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for packed in texts:
        with pa.ipc.open_stream(packed.as_buffer()) as stream:
            yield from stream


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, perplexity) of every row."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    # Small tables are dealt more finely, to keep all cores busy.
    blocks = 1 + max(chars // block, min(docs.sparkSession.sparkContext.defaultParallelism, 8 * chars // block))
    packed = _packed(given, blocks)

    def ask(texts: pa.Table) -> pa.Table:
        grams, parts = np.zeros((0, ORDER), np.uint32), []

        def merged() -> np.ndarray:
            every = np.concatenate([grams, *parts])
            return every[~pd.Series(_keys_of(every)).duplicated().to_numpy()]

        for part in _opened(texts.column("texts")):
            parts.append(_distinct(*_codes(part.column(2)))[0])
            if sum(map(len, parts)) > len(grams) + _FLUSH:
                grams, parts = merged(), []
        grams = merged()
        number = texts.column("block")[0].as_py()
        return pa.table([pa.array(np.full(len(grams), number), pa.int64()), pa.array(_names(grams), pa.string())], ["block", "gram"])

    def tell(texts: pa.Table, answers: pa.Table) -> pa.Table:
        # A block of empty texts has asked for nothing.
        grams = np.frombuffer("".join(answers.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER) if len(answers) else np.zeros((0, ORDER), np.uint32)
        keys = _keys_of(grams)
        order = np.argsort(keys)
        keys, values = keys[order], answers.column("p").to_numpy()[order].astype(np.float64)
        out = []
        for part in _opened(texts.column("texts")):
            grams, number, n = _distinct(*_codes(part.column(2)))
            found = values[np.searchsorted(keys, _keys_of(grams))] if len(grams) else np.zeros(0)
            sums = np.bincount(np.repeat(np.arange(len(n)), n), found[number], len(n))
            out.append(pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.exp(-sums / np.maximum(n, 1)), mask=n == 0)], ["doc_id", "lang", "perplexity"]))
        return pa.Table.from_batches(out)

    try:
        asked = _graph.saved(packed.groupBy("block").applyInArrow(ask, "block long, gram string"))
        distinct = _graph.saved(asked.select("gram").distinct())
        answers = asked.join(resolved(distinct, model), "gram").select("block", "gram", F.col("p").cast("float").alias("p"))
        scored = _graph.saved(packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell, _SCORED))
        _graph.free(asked, distinct)
    finally:
        _drop(docs.sparkSession, packed._named, packed._saved_at)
    return scored


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row; ``trusted`` has the ids of trusted documents."""
    ids = _graph.saved(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    fitting = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_graph.small(_graph.saved(ids.where(~held))), "doc_id", "left_semi")
    scored = score(docs, build(count_ngrams(fitting)), block=block)
    known = scored.join(_graph.small(_graph.saved(ids.where(held))), "doc_id", "left_semi").where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    general = known.agg(at.alias("general"))
    own = known.groupBy(F.col("lang").alias("language")).agg(at.alias("own"), F.count("*").alias("n")).where(F.col("n") >= FEWEST)
    out = scored.join(F.broadcast(general), F.lit(True)).join(own, F.col("lang").eqNullSafe(F.col("language")), "left")
    threshold = F.coalesce("own", "general")
    kept = F.when(F.col("perplexity").isNull(), False).otherwise(F.coalesce(F.col("perplexity") <= threshold, F.lit(True)))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
