"""Repeated runs of three lines, by DataFrame functions only (operator 7).

Every three consecutive lines of a text make a window.  Windows are compared over the whole
table by two 64-bit hashes of their lines; the first one in the order of (doc_id, hash of the
text, line) stays and the lines of all later ones are removed, positions covered by several
windows once.  Each removed line so stands, with its neighbours of that window, at an
earlier place.

Rows: lines end at ``\\n`` only; texts of fewer than three lines, null texts and windows
of blank lines only are left as they are; a text may become empty.  Rows with equal id and text
are one document and get equal results; rows that share only the id are told apart by their texts, null
ids come first.  Other columns are kept and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import _graph


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, line, a, b): id, hash of the text, number of the window's first line from 0, its hashes."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    # A text with two newlines at least has a window; the others never get to the split.
    given = given.where(F.col("text").contains("\n")).select("doc", "mark", _lines(F.col("text")).alias("l")).where(F.size("l") >= 3)
    hashed = given.select(
        "doc", "mark", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(F.translate(x, "\t\r", "  ")) == "").alias("blank"))).alias("l")
    )
    shifted = F.arrays_zip(F.slice("l", 1, F.size("l") - 2).alias("p"), F.slice("l", 2, F.size("l") - 2).alias("q"), F.slice("l", 3, F.size("l") - 2).alias("r"))
    out = hashed.select("doc", "mark", F.posexplode(shifted).alias("line", "w"))
    out = out.where(~(F.col("w.p.blank") & F.col("w.q.blank") & F.col("w.r.blank")))
    return out.select("doc", "mark", "line", F.xxhash64("w.p.a", "w.q.a", "w.r.a").alias("a"), F.xxhash64("w.p.b", "w.q.b", "w.r.b", F.lit(2)).alias("b"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, gone): the numbers of the lines to remove, sorted, of each text that loses any."""
    all_ = _graph.saved(windows(docs, id_col, text_col))
    place = F.struct("doc", "mark", "line")
    first = all_.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("a", "b", "first")
    later = all_.join(first, ["a", "b"]).where(place > F.col("first")).select("doc", "mark", F.explode(F.array(F.col("line"), F.col("line") + 1, F.col("line") + 2)).alias("line"))
    return later.groupBy("doc", "mark").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gone: str = "_gone") -> DataFrame:
    """``docs`` with the text without later occurrences and, as column ``gone`` (a name that ``docs`` lacks), the removed lines' numbers (null: none)."""
    own_doc, own_mark = _graph.free_names(docs, "_doc", "_mark")
    found = _graph.saved(removals(docs, id_col, text_col).select(F.col("doc").alias(own_doc), F.col("mark").alias(own_mark), F.col("gone").alias(gone)))
    # The positions to remove are few beside the texts: sent to all tasks while they are at most some 16 MB.
    places = found.agg(F.coalesce(F.sum(F.size(gone) + 6), F.lit(0))).first()[0]
    found = F.broadcast(found) if places <= 4_000_000 else found
    mark = F.xxhash64(F.col(text_col))
    out = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own_doc)) & (mark == F.col(own_mark)), "left")
    lines = _lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], gone)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` (with n_chars) after removal; all rows and columns stay."""
    (gone,) = _graph.free_names(docs, "_gone")
    out = remove_repeats(docs, gone=gone).drop(gone)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
