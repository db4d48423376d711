"""Near-duplicate documents by fast similarity sketching (operator 3).

The sketch fills its ``t`` coordinates in rounds: in round ``i`` every shingle is
thrown in one of the bins and leaves the value (i, hash); the least value stays.
After ``t`` random rounds, ``t`` more throw every shingle in a bin named by the
round, so every coordinate is filled; a set of a few hundred shingles fills all in one or two
rounds, which makes the sketch linear in the text while its estimate concentrates
like that of ``t`` independent minima.  Bands of coordinates propose pairs and the
whole shingle sets decide.

Texts with equal sets form a class and only its least document is compared.  In a
bucket of a band the least member is compared with the others; buckets that still hold
two components go on to the next round, with ``STEP`` times as many hubs, picked by a hash and
so without ranking a bucket in one task, until no bucket is left or all members were hubs.  So no
pair that shares a band is left unsettled, and members that are already connected
are never compared with each other.

Rows: null or blank texts have no shingles, are linked with nothing and are their
own component; a null doc_id has a null component and is kept; rows that share a
doc_id are one node of the graph.  Other columns are not looked at.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph, _text

BANDS, BAND_ROWS = 24, 4
PARITY = 16
STEP = 32


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The ``t`` coordinates of a non-empty set of hashes."""
    empty = np.uint64(2**64 - 1)
    out = np.full(t, empty, np.uint64)
    for i in range(2 * t):
        thrown = _text.mix(shingles, 1000 + i)
        value = (thrown >> np.uint64(9)) | np.uint64(i << 55)
        if i < t:
            np.minimum.at(out, ((thrown & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if not (out == empty).any():
            break
    return out


def parity(shingles: np.ndarray, words: int = PARITY) -> np.ndarray:
    """Parities of the numbers of shingles that fall in each of ``words`` (a power of two) * 64 bits.

    Two sets' parities differ in at most as many bits as the sets differ in shingles, so they bound
    the similarity from above without error.
    """
    out = np.zeros(words, np.uint64)
    at = _text.mix(shingles, 4)
    np.bitwise_xor.at(out, (at >> np.uint64(6) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    with np.errstate(over="ignore"):
        keys = np.arange(1, bands + 1, dtype=np.uint64)
        for column in coordinates.reshape(bands, rows).T:
            keys = _text.mix(keys ^ column, 7)
    return keys


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, odd, keys): size, 128-bit digest and parities of the shingle set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, odd, keys = [], [], [], [], []
            for _, own in _text.shingle_sets(batch.column(1), k):
                n.append(len(own))
                a.append(int(_text.mix(own, 1).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(_text.mix(own, 2).sum(dtype=np.uint64).view(np.int64)))
                odd.append(parity(own))
                keys.append(band_keys(sketch(own, bands * rows), bands, rows) if len(own) else own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _text.lists(odd, pa.int64()), _text.lists(keys, pa.int64())], ["doc_id", "n_shingles", "set_a", "set_b", "odd", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, odd array<long>, keys array<long>")


def shingle_table(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shingles): the sorted whole set of each document's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(1)):
                own = [x for _, x in _text.shingle_sets(batch.column(1).slice(a, b - a), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _text.lists(own, pa.int64())], ["doc_id", "shingles"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a saved table whose whole shingle sets are similar enough."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    # Of the sets, only those of some pair move.
    right = right.join(_graph.small(_graph.checkpoint(pairs.select("b").distinct())), "b", "left_semi")
    both = F.size(F.array_intersect("of_a", "of_b"))
    all_ = F.size("of_a") + F.size("of_b") - both
    return left.join(_graph.small(pairs), "a").join(right, "b").where(100 * both.cast("long") >= percent * all_.cast("long")).select("a", "b").distinct()


#: Members of a bucket that one task compares with the hubs.
SHARE = 2000


def _candidates(held: DataFrame, done: int, hubs: int, percent: int, words: int) -> DataFrame:
    """Pairs of the hubs of each bucket with its other members, of another component.

    The first hub (``done`` = 0) is the least member, found by an aggregate; later ones are dealt by a hash, some ``hubs``
    of each bucket, so nothing is ranked.  A large bucket is cut in shares of ``SHARE`` members, each with a copy of the hubs.
    """
    if not done:
        hub = held.groupBy("key", "size").agg(F.min(F.struct("class_id", "n_shingles", "component", "odd")).alias("h")).select("key", "size", "h.*")
    else:
        turn = F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40) * F.col("size")
        hub = held.where((turn < hubs) & (turn >= (0 if done == 1 else done)))
    shares = F.ceil(F.col("size") / SHARE)
    hub = hub.select("key", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("component").alias("component_a"), F.col("odd").alias("odd_a"))
    held = held.withColumn("share", F.pmod(F.xxhash64("class_id", F.lit(5)), shares))
    apart = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("odd_a", F.lit(i)))) for i in range(words)), F.lit(0))
    # Similar sets differ in few shingles, so their parities in few bits: an exact bound that spares most comparisons.
    near = apart * (100 + percent) <= (F.col("n_a") + F.col("n_shingles")) * (100 - percent)
    near &= (F.col("n_a") * percent <= F.col("n_shingles") * 100) & (F.col("n_shingles") * percent <= F.col("n_a") * 100)
    both = held.join(hub, ["key", "share"]).where(near & (F.col("component") != F.col("component_a")))
    return both.select(F.least("a", "class_id").alias("a"), F.greatest("a", "class_id").alias("b")).distinct()


def connect(member: DataFrame, sets: DataFrame, percent: int, words: int = PARITY) -> DataFrame | None:
    """Components over verified links of the members of shared buckets, as ``_graph.components`` gives them.

    ``member`` (key, class_id, n_shingles, odd, size) has the buckets of more than one member and their sizes, ``sets``
    (doc_id, shingles) the whole set of each class_id.  None if no two members are linked.
    """
    group, done, hubs = None, 0, 1
    while True:
        held = member.withColumn("component", F.col("class_id"))
        if group is not None:
            held = member.join(group, member.class_id == group.node, "left").withColumn("component", F.coalesce("component", "class_id"))
        # After the first round a bucket of two is done, later on one whose members were all hubs.
        unsettled = held.where(F.col("size") > (2 if done == 1 else max(done, 1))).groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        unsettled = _graph.checkpoint(unsettled)
        if _graph.is_empty(unsettled):
            break
        pairs = _graph.checkpoint(_candidates(held.join(unsettled, "key"), done, hubs, percent, words))
        found = pairs if _graph.is_empty(pairs) else _graph.checkpoint(verified(pairs, sets, percent))
        if not _graph.is_empty(found):
            links = found if group is None else group.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)
            group = _graph.components(links)
        done, hubs = hubs, hubs * STEP
    return group


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) of every row of ``docs``.

    Two documents are linked if 100 * shared shingles >= ``percent`` * shingles of either;
    class_id is the least document with the same set, component_id the least one reachable.
    With 24 bands of 4 rows a link at similarity 0.8 escapes all bands in 3 of 10^6 cases.
    """
    same = ["set_a", "set_b", "n_shingles"]
    base = _graph.saved(sketches(docs, k, bands, rows, id_col, text_col))
    known = base.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.first("odd").alias("odd"), F.first("keys").alias("keys"))
    classes = _graph.saved(classes)
    member = classes.select("class_id", "n_shingles", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = member.join(shared, "key").join(classes.select("class_id", "n_shingles", "odd"), ["class_id", "n_shingles"])
    member = _graph.saved(member)

    inside = _graph.saved(member.select(F.col("class_id").alias("doc_id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = _graph.saved(shingle_table(texts.join(_graph.small(inside), "doc_id", "left_semi"), k).where(F.size("shingles") > 0).distinct())

    group = connect(member, sets, percent)
    _graph.free(member, inside, sets)

    out = base.join(classes.select(*same, "class_id"), same, "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")))
    # Texts of one id are one node, whether or not any near link was found.
    repeated = base.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_a").alias("one"), F.max("set_a").alias("other")).where("one <> other")
    repeated = _graph.saved(repeated.select("doc_id"))
    if not _graph.is_empty(repeated):
        own = out.join(_graph.small(repeated), "doc_id", "left_semi").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
        group = _graph.components(own if group is None else group.select(F.col("component").alias("a"), F.col("node").alias("b")).union(own))
    if group is None:
        return out.select("doc_id", "n_shingles", "class_id", F.col("class_id").alias("component_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = out.join(group, out.class_id == group.node, "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one document of each component; all columns stay."""
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return docs.join(_graph.small(_graph.saved(gone)), "doc_id", "left_anti").select(*docs.columns)
