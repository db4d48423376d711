"""Repeated passages: paragraph MinHash banding and exact verification (operator 6).

Paragraphs are the runs between newlines.  Equal sequences of words (128-bit hash) are one class, whatever
their length.  Classes of six words or more (``banded``) are sketched by minima of their five-word shingles; ``BAND_ROWS``
coordinates make a band, and the number of bands is the least that misses a paragraph at the threshold
in fewer than one of a thousand cases.  Paragraphs that collide are verified by the exact Jaccard similarity of their
whole shingle sets, with hubs as in ``minhash.connect``; a cluster is a connected component.  (Shorter ones
have three shingles at most, so similarity 0.8 means equal sets.)

A passage may also be pasted in the middle of a paragraph.  So each text has anchors: runs of ``ANCHOR`` words
whose hash is the least of ``WINDOW`` neighbouring ones.  Any ``ANCHOR`` + ``WINDOW`` - 1 = 50 words in a row hold one, and
equal passages hold equal ones wherever they stand.  An anchor that stands at several places is compared, word by word,
with its first place, as far as the equal run goes on either side; it goes on for less than a window, or the next anchor
takes over.  The compared words travel as blocks of ``BLOCK`` words, so nothing grows with the length of a text.

Texts that are equal as a whole are one class too, of which only the least is looked into.  Of a
cluster's occurrences the one with the least (doc_id, hash of the text, first word) stays.  Overlapping and adjoining
occurrences of a text are merged, as bits of its words, and reported from ``run`` words on (1: all).

Rows: null and blank texts have no units; rows with equal id and text are one document; rows that share only the
id are told apart by their texts, null ids come first.  Other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import _graph, _text, minhash

SHINGLE = 5
BAND_ROWS = 2
ANCHOR, WINDOW = 15, 36
BLOCK = 128
PARITY = 8
#: Bytes of text taken at once: what bounds a task's working arrays.
RUN = _text.CHUNK // 4


def banded(percent: int) -> int:
    """Words from which on two paragraphs of different words may be near: one of five or fewer has a single shingle, which
    a longer one's shingles can make half of at most."""
    return SHINGLE + 1 if percent > 50 else SHINGLE


def tuned_bands(percent: int, rows: int = BAND_ROWS, miss: float = 1e-3) -> int:
    """The least number of bands that all miss a pair at the threshold at most so often."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of each ``width`` neighbouring values, from running ones of blocks of that width."""
    n = len(values)
    blocks = np.concatenate((values, np.repeat(values[-1:], -n % width))).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors of all rows."""
    n = np.maximum(np.diff(rows) - ANCHOR + 1, 0)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(total) + np.repeat(rows[:-1] - (ends - n), n)
    hashes = _text.segment_hashes(words, at, at + ANCHOR)
    low = np.uint64((1 << 24) - 1)
    # Of equal runs in a window any may be taken: by a hash of the place, so that few are.
    value = (hashes & ~low) | (_text.mix(at.astype(np.uint64), 3) & low)
    chosen = np.zeros(total, bool)
    if total >= WINDOW:
        least = np.zeros(total, np.uint64)
        inside = np.arange(total) + WINDOW <= np.repeat(ends, n)
        least[: total - WINDOW + 1] = _sliding(value, WINDOW, np.minimum)
        least[~inside] = 0
        chosen = _sliding(np.concatenate((np.zeros(WINDOW - 1, np.uint64), least)), WINDOW, np.maximum) == value
    short = np.flatnonzero((n > 0) & (n < WINDOW))
    if len(short):
        edges = np.stack((ends[short] - n[short], ends[short]), 1).ravel()
        least = np.minimum.reduceat(np.append(value, np.uint64(0)), edges)[::2]
        owner = np.repeat(np.arange(len(n)), n)
        of_short = np.zeros(len(n), np.uint64)
        of_short[short] = least
        chosen |= (n[owner] < WINDOW) & (value == of_short[owner])
    return at[chosen], hashes[chosen]


def _bands(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int) -> np.ndarray:
    """Band keys of the paragraphs of words ``starts`` to ``ends``, from the shingles of the whole run of words."""
    # Shingles that begin in a paragraph and end in it: those of the paragraph.
    edges = np.stack((starts, ends - SHINGLE + 1), 1).ravel()
    keys = np.zeros((len(starts), bands), np.uint64)
    padded = np.append(shingles, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for j in range(bands):
            key = np.full(len(starts), np.uint64(j + 1))
            for i in range(BAND_ROWS):
                factor = _text.mix(np.array([j * BAND_ROWS + i], np.uint64), 200) | np.uint64(1)
                key = _text.mix(key ^ np.minimum.reduceat(padded * factor, edges)[::2], 300)
            keys[:, j] = key
    return keys


def _units_of(texts: pa.Array, bands: int, least: int) -> Iterator[tuple]:
    """For each text: number of words; first words and hashes of anchors; first words, sizes and two hashes of
    paragraphs; band keys of those of ``least`` words or more."""
    for a, b in _text.runs(texts, RUN):
        raw, offsets = _text.buffer_of(texts.slice(a, b - a))
        starts, ends, rows = _text.word_bounds(raw, offsets)
        words = _text.word_hashes(raw, starts, ends)
        lines = np.unique(np.concatenate((rows[:-1], np.searchsorted(starts, np.flatnonzero(raw == 10)))))
        lines = lines[lines < len(words)]
        line_ends = np.append(lines[1:], len(words)).astype(np.int64)
        one = _text.segment_hashes(words, lines, line_ends)
        two = _text.segment_hashes(_text.mix(words, 77), lines, line_ends)
        sketched = line_ends - lines >= least
        shingles, _ = _text.shingle_hashes(words, np.array([0, len(words)]), SHINGLE)
        keys = _bands(shingles, lines[sketched], line_ends[sketched], bands) if sketched.any() else np.zeros((0, bands), np.uint64)
        at, hashes = _anchors(words, rows)
        of_anchor, of_line, of_key = np.searchsorted(at, rows), np.searchsorted(lines, rows), np.searchsorted(lines[sketched], rows)
        for r in range(b - a):
            anchors, own, banded_own = slice(of_anchor[r], of_anchor[r + 1]), slice(of_line[r], of_line[r + 1]), slice(of_key[r], of_key[r + 1])
            yield int(rows[r + 1] - rows[r]), at[anchors] - rows[r], hashes[anchors], lines[own] - rows[r], (line_ends - lines)[own], one[own], two[own], keys[banded_own].ravel()


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


_LISTS = {"at": pa.int32(), "anchor": pa.int64(), "first": pa.int32(), "size": pa.int32(), "one": pa.int64(), "two": pa.int64(), "keys": pa.int64()}


def units(docs: DataFrame, bands: int, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, other, n_words, at, anchor, first, size, one, two, keys): a row of arrays for each text with words;
    mark and other are hashes of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_units_of(batch.column(3), bands, least))
            lists = [_text.lists([x[i + 1] for x in found], kind) for i, kind in enumerate(_LISTS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0] for x in found], pa.int64()), *lists], ["doc", "mark", "other", "n_words", *_LISTS])

    given = _given(docs, id_col, text_col).select("doc", "mark", F.xxhash64(F.lit(1), "text").alias("other"), "text")
    kinds = ", ".join(f"{name} array<{'int' if kind == pa.int32() else 'long'}>" for name, kind in _LISTS.items())
    return given.mapInArrow(run, f"doc long, mark long, other long, n_words long, {kinds}").where("n_words > 0")


def _same(a: str, b: str, c: str, d: str) -> Column:
    return F.col(a).eqNullSafe(F.col(c)) & (F.col(b) == F.col(d))


def _texts_of(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``given`` of a saved table of distinct (doc, mark)."""
    ids = wanted.select(F.col("doc").alias("_d"), F.col("mark").alias("_m"))
    return given.join(_graph.small(ids), _same("doc", "mark", "_d", "_m"), "left_semi")


def _paragraph_sets(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, odd, shingles): parities and whole shingle set of each wanted paragraph (doc, mark, first, size, class_id)."""
    lists = _graph.saved(wanted.groupBy(F.col("doc").alias("d"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("first", "size", "class_id")).alias("wanted")))
    texts = _texts_of(given, lists.select(F.col("d").alias("doc"), F.col("m").alias("mark")))
    texts = texts.join(_graph.small_lists(lists, "wanted"), _same("doc", "mark", "d", "m")).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(0), RUN):
                raw, offsets = _text.buffer_of(batch.column(0).slice(a, b - a))
                starts, ends, rows = _text.word_bounds(raw, offsets)
                words = _text.word_hashes(raw, starts, ends)
                ids, sets = [], []
                for r in range(b - a):
                    for w in batch.column(1)[a + r].as_py():
                        at = rows[r] + w["first"]
                        ids.append(w["class_id"])
                        sets.append(np.unique(_text.shingle_hashes(words[at : at + w["size"]], np.array([0, w["size"]]), SHINGLE)[0]))
                odd = [minhash.parity(own, PARITY) for own in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _text.lists(odd, pa.int64()), _text.lists(sets, pa.int64())], ["doc_id", "odd", "shingles"])

    return texts.mapInArrow(run, "doc_id long, odd array<long>, shingles array<long>").dropDuplicates(["doc_id"])


def _blocks(texts: DataFrame) -> DataFrame:
    """(fdoc, fmark, block, piece): texts cut in blocks of ``BLOCK`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.runs(batch.column(2), RUN):
                raw, offsets = _text.buffer_of(batch.column(2).slice(a, b - a))
                starts, ends, rows = _text.word_bounds(raw, offsets)
                data, row, number, pieces = raw.tobytes(), [], [], []
                for r in range(b - a):
                    for k, first in enumerate(range(rows[r], rows[r + 1], BLOCK)):
                        row.append(a + r)
                        number.append(k)
                        pieces.append(data[starts[first] : ends[min(first + BLOCK, rows[r + 1]) - 1]].decode())
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(pieces, pa.string())], ["fdoc", "fmark", "block", "piece"])

    return texts.mapInArrow(run, "fdoc long, fmark long, block int, piece string")


_RUN = "doc long, mark long, first int, size int, fdoc long, fmark long, ffirst int"


def _equal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, mark, text, pieces): the runs of ``ANCHOR`` words or more in which the text equals a piece's text."""
    for batch in batches:
        out = []
        for doc, mark, text, pieces in zip(*(batch.column(i) for i in range(4))):
            own = _words(pa.array([text.as_py()], pa.large_string()))[0]
            struct = pieces.values
            fdoc, fmark, far, block = (struct.field(n) for n in ("fdoc", "fmark", "far", "block"))
            words, rows = _words(struct.field("piece").cast(pa.large_string()))
            far, block = far.to_numpy().astype(np.int64), block.to_numpy().astype(np.int64)
            # Pieces of one text at one distance and then in their order: a run may go over their borders.
            who = np.unique(np.stack((fdoc.fill_null(0).to_numpy(), fdoc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), fmark.to_numpy(), far), 1), axis=0, return_inverse=True)[1].ravel()
            piece = np.repeat(np.arange(len(far)), np.diff(rows))
            there = block[piece] * BLOCK + np.arange(len(words)) - rows[piece]
            order = np.lexsort((there, who[piece]))
            piece, there = piece[order], there[order]
            here = there + far[piece]
            equal = (here >= 0) & (here < len(own))
            equal &= own[np.clip(here, 0, len(own) - 1)] == words[order]
            goes_on = np.zeros(len(here), bool)
            goes_on[1:] = equal[1:] & equal[:-1] & (who[piece[1:]] == who[piece[:-1]]) & (here[1:] == here[:-1] + 1)
            starts = np.flatnonzero(equal & ~goes_on)
            sizes = np.add.reduceat(equal, starts) if len(starts) else starts
            for s, n in zip(starts[sizes >= ANCHOR], sizes[sizes >= ANCHOR]):
                k = int(piece[s])
                out.append((doc.as_py(), mark.as_py(), int(here[s]), int(n), fdoc[k].as_py(), fmark[k].as_py(), int(there[s])))
        names = [f.split()[0] for f in _RUN.split(", ")]
        kinds = [pa.int64() if f.endswith("long") else pa.int32() for f in _RUN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = _text.buffer_of(texts)
    starts, ends, rows = _text.word_bounds(raw, offsets)
    return _text.word_hashes(raw, starts, ends), rows


def _pasted(own: DataFrame, given: DataFrame) -> DataFrame:
    """(doc, mark, first, size, fdoc, fmark, ffirst): runs equal to an earlier one that begins at word ffirst of (fdoc, fmark)."""
    every = own.select("doc", "mark", F.explode(F.arrays_zip("at", "anchor")).alias("u")).select("doc", "mark", "u.*")
    place = F.struct("doc", "mark", "at")
    first = every.groupBy("anchor").agg(F.min(place).alias("f"), F.max(place).alias("last")).where("f < last").select("anchor", "f")
    later = every.join(first, "anchor").where(place > F.col("f"))
    later = later.select("doc", "mark", F.col("f.doc").alias("fdoc"), F.col("f.mark").alias("fmark"), F.col("f.at").alias("fat"), (F.col("at") - F.col("f.at")).alias("far"))
    reach = lambda at, n: F.floor((at + n) / BLOCK).cast("int")
    # An equal run beyond its last shared anchor is shorter than a window.
    blocks = F.sequence(F.greatest(reach(F.col("fat"), -WINDOW), F.lit(0)), reach(F.col("fat"), ANCHOR + WINDOW))
    asked = _graph.saved(later.select("doc", "mark", "fdoc", "fmark", "far", F.explode(blocks).alias("block")).distinct())
    sources = _graph.saved(asked.select(F.col("fdoc").alias("doc"), F.col("fmark").alias("mark")).distinct())
    pieces = _blocks(_texts_of(given, sources)).withColumnsRenamed({"fdoc": "d", "fmark": "m", "block": "b"})
    told = asked.join(pieces, _same("fdoc", "fmark", "d", "m") & (F.col("block") == F.col("b")))
    told = told.groupBy(F.col("doc").alias("d"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("fdoc", "fmark", "far", "block", "piece")).alias("pieces"))
    targets = _graph.saved(asked.select("doc", "mark").distinct())
    texts = _texts_of(given, targets).join(told, _same("doc", "mark", "d", "m")).select("doc", "mark", "text", "pieces")
    found = _graph.saved(texts.mapInArrow(_equal_runs, _RUN))
    _graph.free(asked, sources, targets)
    return found


def _clusters(own: DataFrame, given: DataFrame, percent: int, bands: int) -> DataFrame:
    """(doc, mark, first, size, cluster, removed): the paragraphs that have an equal or a near one elsewhere."""
    every = own.select("doc", "mark", F.explode(F.arrays_zip("first", "size", "one", "two")).alias("u")).select("doc", "mark", "u.*")
    long_ = F.filter(F.arrays_zip("first", "size", "one", "two"), lambda u: u["size"] >= banded(percent))
    rows = F.transform(long_, lambda u, i: F.struct(u["first"].alias("first"), u["size"].alias("size"), u["one"].alias("one"), u["two"].alias("two"), F.slice("keys", i * bands + 1, bands).alias("keys")))
    short = F.transform(F.filter(F.arrays_zip("first", "size", "one", "two"), lambda u: u["size"] < banded(percent)), lambda u: F.struct(u["first"].alias("first"), u["size"].alias("size"), u["one"].alias("one"), u["two"].alias("two"), F.array().cast("array<bigint>").alias("keys")))
    place = F.struct("doc", "mark", "first")
    keyed = own.select("doc", "mark", F.explode(F.concat(rows, short)).alias("u")).select("doc", "mark", "u.*")
    classes = keyed.groupBy("one", "two").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    # Ids of the rows of a saved table: no two classes share one.
    classes = _graph.saved(classes.withColumn("class_id", F.monotonically_increasing_id()))
    member = classes.select("class_id", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = _graph.saved(member.join(shared, "key"))
    inside = _graph.saved(shared.select("class_id").distinct())
    wanted = classes.join(_graph.small(inside), "class_id", "left_semi").select("least.*", "size", "class_id")
    sets = _graph.saved(_paragraph_sets(given, wanted))
    sizes = sets.select(F.col("doc_id").alias("class_id"), F.size("shingles").cast("long").alias("n_shingles"), "odd")
    member = _graph.saved(shared.join(sizes, "class_id"))
    group = minhash.connect(member, sets, percent, PARITY)
    _graph.free(shared, inside, sets, member)

    named = classes.select("one", "two", "class_id", "least", (F.col("least") < F.col("most")).alias("repeated"))
    if group is None:
        named = named.where("repeated").select("one", "two", F.col("one").alias("cluster"), F.col("least").alias("stays"))
    else:
        nodes = group.select("node", "component").union(group.select(F.col("component").alias("node"), "component")).distinct()
        named = named.join(nodes, F.col("class_id") == F.col("node"), "left").where("repeated or node is not null")
        named = named.withColumn("component", F.coalesce("component", "class_id"))
        first = named.groupBy("component").agg(F.min("least").alias("stays"), F.min("one").alias("cluster"))
        named = named.select("one", "two", "component").join(first, "component").select("one", "two", "cluster", "stays")
    found = every.join(named, ["one", "two"]).select("doc", "mark", "first", "size", "cluster", (place > F.col("stays")).alias("removed"))
    found = _graph.saved(found)
    _graph.free(classes)
    return found


def occurrences(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, first, size, cluster, removed): words of every paragraph or passage that stands elsewhere too."""
    bands = tuned_bands(percent)
    given = _given(docs, id_col, text_col)
    table = _graph.saved(units(docs, bands, banded(percent), id_col, text_col))
    texts = table.select("mark", "other", "n_words", F.struct("doc").alias("doc"))
    copied = _graph.saved(texts.groupBy("mark", "other", "n_words").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("mark", "other", "n_words", "least"))
    every = texts.join(copied, ["mark", "other", "n_words"]).select("doc.doc", "mark", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("size"), F.col("mark").alias("cluster"), (F.col("doc") > F.col("least")).alias("removed"))
    every = _graph.saved(every.distinct())
    copies = _graph.saved(every.where("removed").select(F.col("doc").alias("_d"), F.col("mark").alias("_m")))
    own = table.join(_graph.small(copies), _same("doc", "mark", "_d", "_m"), "left_anti")

    near = _clusters(own, given, percent, bands)
    pasted = _pasted(own, given)
    _graph.free(table, copied, copies)
    cluster = F.xxhash64("fdoc", "fmark").alias("cluster")
    later = pasted.select("doc", "mark", "first", "size", cluster, F.lit(True).alias("removed"))
    stays = pasted.select(F.col("fdoc").alias("doc"), F.col("fmark").alias("mark"), F.col("ffirst").alias("first"), "size", cluster, F.lit(False).alias("removed"))
    return every.union(near).union(later).union(stays)


def _spans_of(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, first, size, cluster = [], [], [], []
        for r, blocks in enumerate(batch.column(3)):
            block, bits, names = (blocks.values.field(n).to_numpy() for n in ("block", "bits", "cluster"))
            words = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = (block.astype(np.int64)[:, None] * 64 + np.arange(64))[words.astype(bool)]
            name = np.repeat(names, words.sum(1, dtype=np.int64))
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            sizes = np.diff(np.append(begins, len(at)))
            least = np.minimum.reduceat(name, begins)
            fit = sizes >= run
            row += [r] * int(fit.sum())
            first.append(at[begins[fit]])
            size.append(sizes[fit])
            cluster.append(least[fit])
        at = pa.array(row, pa.int64())
        numbers = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (first, size, cluster)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, batch.column(2).take(at)], ["doc_id", "mark", "first_word", "n_words", "cluster", "removed"])


def repeated_passages(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", run: int = 1) -> DataFrame:
    """(doc_id, mark, first_word, n_words, cluster, removed): merged occurrences of ``run`` words or more; words count from 0."""
    found = occurrences(docs, percent, id_col, text_col)
    block = F.explode(F.sequence(F.floor(F.col("first") / 64).cast("int"), F.floor((F.col("first") + F.col("size") - 1) / 64).cast("int")))
    bits = found.select("doc", "mark", "removed", "cluster", "first", (F.col("first") + F.col("size")).alias("last"), block.alias("block"))
    ones = F.expr("shiftleft(-1L, greatest(first - 64 * block, 0)) & shiftrightunsigned(-1L, 64 - least(last - 64 * block, 64))")
    bits = bits.groupBy("doc", "mark", "removed", "block").agg(F.bit_or(ones).alias("bits"), F.min("cluster").alias("cluster"))
    whole = bits.groupBy("doc", "mark", "removed").agg(F.sort_array(F.collect_list(F.struct("block", "bits", "cluster"))).alias("blocks"))
    return whole.mapInArrow(lambda batches: _spans_of(batches, run), "doc_id long, mark long, first_word long, n_words long, cluster long, removed boolean")


def remove_passages(docs: DataFrame, percent: int = 80, run: int = 15) -> DataFrame:
    """``docs`` with removed occurrences cut from the texts; all rows and columns stay."""
    d, m, gone_col = _graph.free_names(docs, "_d", "_m", "_cut")
    found = repeated_passages(docs, percent, run=run).where("removed").groupBy(F.col("doc_id").alias(d), F.col("mark").alias(m)).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(gone_col))
    at = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(m))
    given = docs.join(_graph.small_lists(_graph.saved(found), gone_col), at, "left").select(*docs.columns, gone_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(gone_col).to_pylist()):
                if gone:
                    raw = text.encode()
                    starts, ends, _ = _text.word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    parts, at = [], 0
                    for c in gone:
                        parts.append(raw[at : starts[c["first_word"]]])
                        at = ends[c["first_word"] + c["n_words"] - 1]
                    text = b"".join([*parts, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in docs_columns], docs_columns)

    docs_columns = list(docs.columns)
    return given.mapInArrow(cut, docs.schema)
