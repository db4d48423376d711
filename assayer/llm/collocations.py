"""Phrases whose words go together more often than apart (operator 12).

Texts are cut in pieces at punctuation and line breaks, pieces in words; every run of 1 to
``max_n`` words within a piece becomes a row (language, phrase, occurrences in this batch), and
Spark adds the rows up by language and phrase.  This is done in three passes, of words,
pairs and longer runs: a phrase can't reach the least count where one of its words or pairs
doesn't, so later passes make no rows of those.  They are told by a bitmap of fixed size of the hashes of what reached it; a
collision only lets a phrase through to the exact count.  Then counts of first and last parts are joined to
each phrase, the score of each cut is exact in Decimal, phrases that one word more would
nearly always complete are anti-joined away, and a window ranks each language.

A language or word may hold a third of all rows: counts are added up in tasks before every shuffle,
and the ranking window takes only each task's first rows of a language.

Rows: a null text is empty, a null language ``und``; texts without a phrase of the least count give nothing;
repeated rows count each time; ids and other columns are not looked at.  Equal scores go by count, then by the
phrase's bytes; equal cuts by the shortest first part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph, _text, decontam

LEAST_BITS, MOST_BITS = 18, 26
#: Bytes of text taken at once, rows in one Arrow batch of phrases: what bounds a task's memory.
RUN, ROWS = _text.CHUNK // 4, 50_000
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

GRAMS = "lang string, phrase string, size int, f long"


class _Words:
    """The words of a run of texts: lower-cased bytes with one space after each word, where each word starts and ends,
    how many words are left to its piece's end, its hash (set apart by language) and its language's place in ``langs``."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = _text.buffer_of(texts)
        starts, ends, rows = _text.word_bounds(raw, offsets, _BETWEEN)
        size = ends - starts
        self.starts = np.cumsum(size + 1) - size - 1
        self.ends = self.starts + size
        self.bytes = np.full(int((size + 1).sum()), 32, np.uint8)
        self.bytes[np.repeat(self.starts - np.cumsum(size) + size, size) + np.arange(size.sum())] = _LOWER[raw[~_BETWEEN[raw]]]
        row = np.repeat(np.arange(len(texts)), np.diff(rows))
        piece = np.cumsum(_ENDS[raw], dtype=np.int32)[starts] if len(raw) else np.zeros(0, np.int32)
        first = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)
        upto = np.append(first[1:], len(row))
        self.left = np.repeat(upto, upto - first) - np.arange(len(row))
        coded = pc.dictionary_encode(langs)
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy()[row]
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            self.hash = _text.word_hashes(raw, starts, ends) + (salt[self.lang] if len(row) else np.zeros(0, np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words, in text order, those over a piece's end too."""
        count = max(0, len(self.hash) - n + 1)
        out = self.hash[:count]
        with np.errstate(over="ignore"):
            for j in range(1, n):
                out = _text.mix(out, j) + self.hash[j : j + count]
        return out

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        starts, ends = self.starts[at], self.ends[at + n - 1]
        size = ends - starts
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _counted(docs: DataFrame, sizes: list[int], known: Broadcast | None = None, known_size: int = 0) -> DataFrame:
    """(lang, phrase, size, f) of runs of ``sizes`` words whose runs of ``known_size`` words are all in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.columns
            for a, b in _text.runs(texts, RUN):
                words = _Words(texts.slice(a, b - a), langs.slice(a, b - a))
                may = decontam._in(known.value, words.grams(known_size)) if known else None
                for n in sizes:
                    hashes = words.grams(n)
                    held = words.left[: len(hashes)] >= n
                    for j in range(n - known_size + 1 if known else 0):
                        held = held & may[j : j + len(hashes)]
                    at = np.flatnonzero(held)
                    _, first, f = np.unique(hashes[at], return_index=True, return_counts=True)
                    at = at[first]
                    for i in range(0, len(at), ROWS):
                        own = at[i : i + ROWS]
                        yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(words.lang[own])), words.phrases(own, n), pa.array(np.full(len(own), n, np.int32)), pa.array(f[i : i + ROWS])], ["lang", "phrase", "size", "f"])

    return docs.mapInArrow(run, GRAMS).groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame) -> Broadcast:
    """The hashes of (lang, phrase, size) with one size, as a bitmap of at most 2^``MOST_BITS`` bits sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch.column(1), batch.column(0))
            n = batch.column(2)[0].as_py() if len(batch) else 1
            yield pa.RecordBatch.from_arrays([pa.array(words.grams(n)[words.left[: max(0, len(words.hash) - n + 1)] == n].view(np.int64))], ["h"])

    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(32 * phrases.count() + 1)))))
    return phrases.sparkSession.sparkContext.broadcast(decontam.bitmap(phrases.select("lang", "phrase", "size").mapInArrow(run, "h long"), bits))


def counts(docs: DataFrame, max_n: int, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of 1 to ``max_n`` words found ``least`` times or more, (lang, n): all words), saved."""
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = _graph.saved(_counted(given, [1]))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [words.where(F.col("f") >= least)]
    for sizes in ([2], list(range(3, max_n + 1))):
        if sizes and sizes[0] <= max_n:
            known = _bitmap(found[-1])
            found.append(_graph.saved(_counted(given, sizes, known, sizes[0] - 1).where(F.col("f") >= least)))
            known.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, total


def phrases(docs: DataFrame, max_n: int = 4, least: int = 30, covered: int = 80, limit: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``limit`` phrases.

    a, l, r count the phrase and the two parts of its weakest cut, n all words; score is 2000000 a / (l + r), rounded down.  A phrase
    goes if a longer one that holds it has ``covered`` per cent of its count: then one word more has too.
    """
    every, total = counts(docs, max_n, least, text_col, lang_col)
    long = every.where("size >= 2").withColumnRenamed("f", "a")
    cut = long.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cut = cut.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A phrase of n words holds two of n - 1: the most frequent of the longer ones decides.
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")))
    longer = long.where("size >= 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    free = best.join(longer, (best["lang"] == longer["lang"]) & (best["phrase"] == longer["phrase"]) & (longer["more"].cast("decimal(20, 0)") * 100 >= best["a"].cast("decimal(20, 0)") * covered), "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = free.withColumn("rank", place).where(F.col("rank") <= limit)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
