"""Rule-based quality: figures of each text, and lines that too many documents of a host repeat (operator 13).

Every line is normalised (A-Z lower-cased, digits to 0, white space to one space) and hashed.  A host's distinct
documents with a line are counted over the whole table; lines in more than ``least`` documents and more than ``percent`` per
cent of the host's are removed, and a document that keeps less than ``keep`` per cent of its words is rejected.  Equal texts of a host count as
one document: copies are not what makes a line a host's furniture.

Each text is read once for its figures and line hashes; the counts move hashes only.  A host may hold a third
of all rows, a line stand in all of its documents: rows are dealt by host, text and line, then counted by host and line,
both after adding up in tasks.  The lines above the limit are sent to all tasks up to a counted size and
joined by a shuffle beyond it.

Rows: a null text has no words and so fails; a null host is a host of its own; lines without a word are not counted
and stay; rows with equal host and text get equal verdicts, whatever their ids (which may be null); an empty
table gives an empty one.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import _graph, _text

#: A line goes when more than this many documents, and this share of its host's documents in per cent, have it.
LEAST, PERCENT = 10, 5
#: A document goes when less than this share of its words stays, in per cent.
KEEP = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NORMAL = _text.lower_values(np.arange(256, dtype=np.uint8))
_NORMAL[48:58] = _NORMAL[48]

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How much of ``flags`` lies between each bound and the next."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[bounds])


class _Texts:
    """A run of texts: bounds and rows of words, the lines with a word (row, bounds, words in them, hash of the normalised line)."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = _text.buffer_of(texts)
        self.starts, self.ends, self.words = _text.word_bounds(self.raw, self.offsets)
        n = len(self.offsets) - 1
        breaks = np.flatnonzero(self.raw == 10)
        inner = np.unique(np.concatenate((breaks + 1, self.offsets[1:-1]))) if len(self.raw) else np.zeros(0, np.int64)
        self.line_starts = np.concatenate(([0], inner[(inner > 0) & (inner < len(self.raw))]))
        line_ends = np.append(self.line_starts[1:], len(self.raw))
        # The line break itself is no part of the line.
        self.line_ends = line_ends - (self.raw[np.maximum(line_ends, 1) - 1] == 10 if len(self.raw) else 0)
        first = np.searchsorted(self.starts, self.line_starts)
        upto = np.append(first[1:], len(self.starts))
        held = np.flatnonzero(upto > first)
        self.line_starts, self.line_ends, first, upto = self.line_starts[held], self.line_ends[held], first[held], upto[held]
        self.line_words = upto - first
        self.line_row = np.searchsorted(self.offsets, self.line_starts, "right") - 1
        self.lines = np.searchsorted(self.line_row, np.arange(n + 1))
        normal = _text.segment_hashes(_NORMAL[self.raw], self.starts, self.ends)
        self.line_hash = _text.segment_hashes(normal, first, upto)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row: lines with a word equal to an earlier one, words in three-word windows found twice or more."""
        values = self.raw.astype(np.uint64) + np.uint64(1)
        words = _text.segment_hashes(values, self.starts, self.ends)
        lines = _text.mix_parts(_text.segment_hashes(values, self.line_starts, self.line_ends), self.line_row)
        again = np.ones(len(lines), bool)
        again[np.unique(lines, return_index=True)[1]] = False
        row = np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))
        n = max(0, len(words) - 2)
        with np.errstate(over="ignore"):
            window = _text.mix_parts(_text.mix(_text.mix(words[:n], 1) + words[1 : n + 1], 2) + words[2 : n + 2], row[:n])
        inside = np.flatnonzero(row[:n] == row[2 : n + 2])
        _, which, count = np.unique(window[inside], return_inverse=True, return_counts=True)
        at = inside[count[which] > 1]
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[at + j] = True
        return _sums(again, self.lines), _sums(covered, self.words)


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, digest, FIGURES, lines, sizes), saved: figures of each row, hashes of its distinct lines and how many words these hold in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(3)):
                part = batch.slice(a, b - a)
                t = _Texts(part.column(3))
                dup, repeated = t.repeated()
                n_words = np.diff(t.words)
                # A byte that goes on with a character is no character.
                letters = (t.raw & 0xC0) != 0x80
                letters &= ~_text._SPACE[t.raw]
                figures = [n_words, _sums(letters, t.offsets), _sums(_SYMBOL[t.raw], t.offsets), dup, repeated]
                lines, sizes = [], []
                for r in range(b - a):
                    own = slice(t.lines[r], t.lines[r + 1])
                    distinct, which = np.unique(t.line_hash[own], return_inverse=True)
                    lines.append(distinct)
                    sizes.append(np.bincount(which, t.line_words[own], len(distinct)).astype(np.int64))
                columns = [*part.columns[:3], *(pa.array(f, pa.int64()) for f in figures), _text.lists(lines, pa.int64()), _text.lists(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "digest", *FIGURES, "lines", "sizes"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return _graph.saved(given.mapInArrow(run, f"doc_id {kind}, host long, digest long, {', '.join(f'{f} long' for f in FIGURES)}, lines array<long>, sizes array<long>"))


def frequent_lines(measured: DataFrame, least: int = LEAST, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((host, line) above the limits, (host, digest, line, size): the distinct lines of each distinct text), both saved."""
    each = measured.select("host", "digest", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select("host", "digest", F.col("l.lines").alias("line"), F.col("l.sizes").alias("size")).distinct()
    each = _graph.saved(each)
    hosts = measured.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    often = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return _graph.saved(often.join(hosts, "host").where(F.col("n") * 100 > F.col("n_docs") * percent).select("host", "line")), each


def judge(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, FIGURES, n_frequent_words, base_failed, kept): one row for each row of ``docs``.

    n_frequent_words counts words on lines above the limits; a text of fewer than 50 words, or with more than half of them
    in repeated windows of three, fails whatever its lines.
    """
    measured = _measured(docs, id_col, text_col, host_col)
    often, each = frequent_lines(measured, least, percent)
    gone = each.join(_graph.small(often), ["host", "line"]).groupBy("host", "digest").agg(F.sum("size").alias("n_frequent_words"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = measured.drop("lines", "sizes").join(_graph.small(_graph.saved(gone)), ["host", "digest"], "left").withColumns({"n_frequent_words": F.coalesce("n_frequent_words", F.lit(0)), "base_failed": failed})
    stays = (F.col("n_words") - F.col("n_frequent_words")) * 100 >= F.col("n_words") * keep
    return out.select("doc_id", *FIGURES, "n_frequent_words", "base_failed", (~F.col("base_failed") & stays).alias("kept"))


def clean(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, text): every row's text without the lines above its host's limits; a null text stays null."""
    measured = _measured(docs, id_col, text_col, host_col)
    often, each = frequent_lines(measured, least, percent)
    # At most the distinct lines of one text come together in a row.
    of_text = each.join(_graph.small(often), ["host", "line"]).groupBy("host", "digest").agg(F.collect_list("line").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2)):
                if text.is_valid and gone.is_valid:
                    t = _Texts(pa.array([text.as_py()]))
                    at = np.isin(t.line_hash.view(np.int64), gone.values.to_numpy())
                    drop = set(t.line_starts[at].tolist())
                    lines = text.as_py().encode().split(b"\n")
                    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])[:-1]))
                    out.append(b"\n".join(x for x, s in zip(lines, starts.tolist()) if s not in drop).decode())
                else:
                    out.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    with_gone = given.join(_graph.small_lists(_graph.saved(of_text), "gone"), ["host", "digest"], "left").select("doc_id", "text", "gone")
    return with_gone.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string")
