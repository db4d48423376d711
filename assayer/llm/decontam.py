"""Benchmark items inside documents: MinHash containment search by size (operator 9).

A short item inside a long document has a tiny Jaccard similarity, so one sketch size
cannot serve all documents.  Documents are parted by their number of shingles (powers of
four); a document of a part is sketched by one permutation whose number of bins is two to
eight times its size, and every item is sketched once for each part with that part's bins.
A shared shingle that is the least of its bin on both sides is a hit; with this load a
shared shingle survives on the document's side with a chance of about four in five, so an
item of 12 shingles escapes in fewer than one of 10^5 cases.  An item of fewer than ``SHORT``
shingles is not sketched: each of its shingles is a key, and so is each shingle of a document that
may be such an item's, so none escapes.  An item of fewer words than a shingle has is its whole sequence of
words, looked for in every document of as many words or more.  Pairs with a hit are verified
by exact containment of the item's shingle set in the document's whole set.

A key that many documents have ("which of the following is") would pair all of them with every item that has it, so an item's
keys of a part are ranked by how many of the documents found hold the key's shingle, and only the rarest are joined: as many as the item
may lack, and one more of a short item, ``SURE`` more of a sketched one.  A document with the item has at least that one (those eight), so no
short item escapes by it, and a sketched one in fewer than one of 10^5 cases.  Documents of more than 2^24 shingles have no bins: all their shingles are keys.

A fixed-size bitmap of the item sketches (at most 2^27 bits, whatever the number of items)
goes to all executors, so only sketch values that may be an item's leave the scan, and with
them the document's shingles that may be an item's.

Rows: null and blank texts and rows without an id are never reported; rows that share an id count as texts of one document
(or item) and the best one counts.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph, _text

#: The last part has the documents above 2^24 shingles.
PARTS = range(0, 28, 2)
LEAST_BITS, MOST_BITS = 20, 27
#: Items of fewer shingles are looked for by each of them; the seed of these keys is no part's.
SHORT, WHOLE = 12, 99
#: Keys of a sketched item that are joined beyond those it may lack: 0.21^8 is below 10^-5.
SURE = 8


def _part(n: np.ndarray) -> np.ndarray:
    """The size part of sets of ``n`` shingles: an even power of two not below it."""
    power = np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.minimum(power + power % 2, PARTS[-1])


def _bins(part: np.ndarray) -> np.ndarray:
    """How many bins documents of the parts have; none in the last."""
    return np.where(part < PARTS[-1], 2 << np.minimum(part, PARTS[-2]), 0)


def _least_of_bins(shingles: np.ndarray, bins: np.ndarray, bases: np.ndarray, total: int) -> np.ndarray:
    """Which shingles are the least of their bin; ``bases`` sets the rows' bins apart, and without bins all are."""
    if not bins.all():
        out, some = np.ones(len(shingles), bool), bins > 0
        out[some] = _least_of_bins(shingles[some], bins[some], bases[some], total)
        return out
    cell = bases + (_text.mix(shingles, 5) & (bins - 1).astype(np.uint64)).astype(np.int64)
    least = np.full(total, np.uint64(2**64 - 1))
    np.minimum.at(least, cell, shingles)
    return least[cell] == shingles


def item_table(items: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n_words, shingles, keys, of, parts): the item's shingle set and its keys (of a long item: its sketch values for all parts)
    with the shingle and the part of each, -1 for a short item's; n_words counts to ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keys, of, parts = [], [], [], []
            for _, own in _text.shingle_sets(batch.column(1), k):
                sets.append(own)
                if len(own) < SHORT:
                    keys.append(_text.mix(own, WHOLE))
                    of.append(own)
                    parts.append(np.full(len(own), -1))
                    continue
                least = []
                for p in PARTS:
                    bins = np.full(len(own), int(_bins(np.array(p))), np.int64)
                    few = 4 * len(own) <= 1 << p
                    least.append(own if few else own[_least_of_bins(own, bins, np.zeros(len(own), np.int64), int(bins[0]))])
                keys.append(np.concatenate([_text.mix(held, 100 + p) for p, held in zip(PARTS, least)]))
                of.append(np.concatenate(least))
                parts.append(np.repeat(np.array(PARTS), [len(held) for held in least]))
            raw, offsets = _text.buffer_of(batch.column(1))
            n_words = np.minimum(np.diff(_text.word_bounds(raw, offsets)[2]), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *(_text.lists(x, pa.int64()) for x in (sets, keys, of, parts))], ["item_id", "n_words", "shingles", "keys", "of", "parts"])

    given = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null")
    return given.mapInArrow(run, "item_id long, n_words long, shingles array<long>, keys array<long>, of array<long>, parts array<long>").where("n_words > 0")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which values modulo 2^``bits`` occur among the 64-bit hashes; its size does not depend on their number."""
    h = F.col(hashes.columns[0])
    low = h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    got = hashes.select(F.shiftright(low, 6).alias("at"), F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return out


def _in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hits(docs: DataFrame, k: int, sketch_map, set_map, fewer: list[int]) -> DataFrame:
    """(doc_id, keys, shingles): keys and shingles that may be an item's, of documents with any such key;
    ``fewer`` has the lengths of the items of less than ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_sketch, of_set = sketch_map.value, set_map.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _text.runs(texts):
                raw, offsets = _text.buffer_of(texts.slice(a, b - a))
                starts, ends, rows = _text.word_bounds(raw, offsets)
                long_enough = np.diff(rows) >= k
                words = _text.word_hashes(raw, starts, ends)
                shingles, begins = _text.shingle_hashes(words, rows, k)
                n = np.where(long_enough, np.diff(begins), 0)
                part = _part(n)
                bins = np.where(n > 0, _bins(part), 0)
                size = np.diff(begins)
                doc = np.repeat(np.arange(b - a), size)
                first = np.cumsum(bins) - bins
                own = long_enough[doc]
                shingles, doc = shingles[own], doc[own]
                least = _least_of_bins(shingles, bins[doc], first[doc], int(bins.sum()))
                keys = _text.mix_parts(shingles[least], 100 + part[doc[least]])
                hit = _in(of_sketch, keys)
                keys, at = keys[hit], doc[least][hit]
                maybe = _in(of_set, shingles)
                shingles, doc = shingles[maybe], doc[maybe]
                whole = _text.mix(shingles, WHOLE)
                short = _in(of_sketch, whole)
                keys, at = np.concatenate((keys, whole[short])), np.concatenate((at, doc[short]))
                for length in fewer:
                    runs, begins = _text.shingle_hashes(words, rows, length)
                    owner = np.repeat(np.arange(b - a), np.diff(begins))
                    held = _in(of_set, runs) & (np.diff(rows)[owner] >= length)
                    runs, owner = runs[held], owner[held]
                    shingles, doc = np.concatenate((shingles, runs)), np.concatenate((doc, owner))
                    keys, at = np.concatenate((keys, _text.mix(runs, WHOLE))), np.concatenate((at, owner))
                order = np.argsort(doc, kind="stable")
                shingles, doc = shingles[order], doc[order]
                if not len(keys):
                    continue
                found = np.unique(at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(found)), _text.lists([np.unique(keys[at == d]) for d in found], pa.int64()), _text.lists([np.unique(shingles[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]) for d in found], pa.int64())],
                    ["doc_id", "keys", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id long, keys array<long>, shingles array<long>")


def candidates(hits: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(doc_id, item_id) of documents that have one of the item's rarest keys."""
    keys = table.select("item_id", F.xxhash64("shingles").alias("text"), F.size("shingles").alias("n"), F.explode(F.arrays_zip("keys", "of", "parts")).alias("z")).select("item_id", "text", "n", "z.*").distinct()
    held = hits.select(F.explode("shingles").alias("of")).join(_graph.small(_graph.saved(keys.select("of").distinct())), "of", "left_semi").groupBy("of").agg(F.count("*").alias("held"))
    lacking = F.expr(f"n * {100 - percent} div 100")
    rank = F.row_number().over(Window.partitionBy("item_id", "text", "parts").orderBy(F.coalesce("held", F.lit(0)), "keys"))
    rarest = keys.join(held, "of", "left").withColumn("rank", rank).where(F.col("rank") <= lacking + F.when(F.col("parts") < 0, 1).otherwise(SURE))
    asked = rarest.select("item_id", F.col("keys").alias("key")).distinct()
    return hits.select("doc_id", F.explode("keys").alias("key")).join(asked, "key").select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of every item of which at least ``percent`` per cent
    of the ``k``-word shingles are in the document; an item of fewer words has one, itself."""
    spark = docs.sparkSession
    table = _graph.saved(item_table(items, k, item_col, item_text_col))
    keys = table.select("item_id", F.explode("keys").alias("key")).distinct()
    n = table.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(32 * n + 1)))))
    sketch_map = spark.sparkContext.broadcast(bitmap(keys.select("key"), bits))
    set_map = spark.sparkContext.broadcast(bitmap(table.select(F.explode("shingles").alias("h")), bits))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    fewer = sorted(r["n_words"] for r in table.where(F.col("n_words") < k).select("n_words").distinct().collect())
    hits = _graph.saved(_hits(given, k, sketch_map, set_map, fewer))
    sketch_map.destroy()
    set_map.destroy()
    both = candidates(hits, table, percent).join(table.select("item_id", F.col("shingles").alias("of_item")), "item_id").join(hits.select("doc_id", "shingles"), "doc_id")
    shared = F.size(F.array_intersect("of_item", "shingles")).cast("long")
    both = both.select("doc_id", "item_id", F.size("of_item").cast("long").alias("n_item"), shared.alias("n_shared")).where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    best = F.max(F.struct("n_shared", "n_item"))
    return both.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.n_item", "best.n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without documents that hold an item; all columns stay."""
    found = _graph.saved(contained_items(docs, items, k, percent).select("doc_id").distinct())
    return docs.join(_graph.small(found), "doc_id", "left_anti").select(*docs.columns)
