"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections (operator 10).

Paragraphs end at a newline, sections after a paragraph whose digest says so (one in eight), so
neither depends on positions.  A paragraph is cut in blocks of some 32 bytes where a rolling hash
of the last eight bytes says so, after 64 bytes at most, and after 2, 4, 8, 16 and 32 bytes of the
text; the blocks give a likeness even to texts of one paragraph or of a few characters.

The fingerprint is ``root/section;section...`` where a section is ``digest:paragraph,paragraph...``
and a paragraph ``digest.blocks``.  Every node is the SHA-256 of the whole digests below it (a paragraph of its bytes); shown are
32 hexadecimal digits of the root and 16 of sections and paragraphs, and 6 for each block.
Equal texts have equal fingerprints; equal roots mean equal texts but for collisions of 128 bits.
``likeness`` is the share of common blocks, 2 * common / (blocks of one + blocks of the other);
``differences`` follows the branches that differ; ``edits`` does so for a table of pairs.

Rows: a null text is an empty one; its tree has no section.  In ``edited_pairs`` the next document is
the one with the next id; rows that share an id follow each other in the order of their texts' hashes,
null ids come first.  Other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import _graph, _text

MOST = 64
_FIRST = (2, 4, 8, 16, 32)
_GEAR = [np.uint64(pow(0x5851F42D4C957F2D, j + 1, 1 << 64)) for j in range(8)]


ROOT, NODE = 32, 16


def fingerprint(text: str) -> str:
    raw = text.encode()
    if not raw:
        return hashlib.sha256().hexdigest()[:ROOT] + "/"
    data = np.frombuffer(raw, np.uint8)
    values = data.astype(np.uint64)
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(data), np.uint64)
        for j, factor in enumerate(_GEAR[: len(data)]):
            rolling[j:] += values[: len(data) - j] * factor
    newline = data == 10
    cut = (_text.mix(rolling) & np.uint64(31)) == 0
    cut |= newline
    cut[[f - 1 for f in _FIRST if f < len(data)]] = True
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    gaps = (np.diff(ends, prepend=0) - 1) // MOST
    if gaps.any():
        extra = np.arange(gaps.sum()) - np.repeat(np.cumsum(gaps) - gaps, gaps) + 1
        cut[np.repeat(ends - np.diff(ends, prepend=0), gaps) + extra * MOST - 1] = True
        ends = np.flatnonzero(cut) + 1
    starts = np.concatenate(([0], ends[:-1]))
    blocks = (_text.segment_hashes(values + np.uint64(1), starts, ends) >> np.uint64(40)).tolist()
    lines = np.flatnonzero(newline) + 1
    if not len(lines) or lines[-1] != len(data):
        lines = np.append(lines, len(data))
    upto = np.searchsorted(ends, lines, "right").tolist()
    names = ["%06x" % b for b in blocks]
    sections: list[str] = []
    own: list[str] = []
    digests: list[bytes] = []
    heads: list[bytes] = []
    begin = first = 0
    last = len(upto) - 1
    for i, (end, until) in enumerate(zip(lines.tolist(), upto)):
        digest = hashlib.sha256(raw[begin:end]).digest()
        own.append(digest.hex()[:NODE] + "." + "".join(names[first:until]))
        digests.append(digest)
        begin, first = end, until
        if i == last or digest[0] % 8 == 0:
            heads.append(hashlib.sha256(b"".join(digests)).digest())
            sections.append(heads[-1].hex()[:NODE] + ":" + ",".join(own))
            own, digests = [], []
    return hashlib.sha256(b"".join(heads)).hexdigest()[:ROOT] + "/" + ";".join(sections)


def _tree(mark: str) -> list[tuple[str, list[tuple[str, str]]]]:
    body = mark.partition("/")[2]
    return [(s[:NODE], [(p[:NODE], p[NODE + 1 :]) for p in s[NODE + 1 :].split(",")]) for s in body.split(";")] if body else []


def _blocks(mark: str) -> list[str]:
    return [p[i : i + 6] for _, paragraphs in _tree(mark) for _, p in paragraphs for i in range(0, len(p), 6)]


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    a, b = _blocks(one), _blocks(other)
    if not a or not b:
        return 0.0
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def differences(one: str, other: str) -> list[int]:
    """Numbers (from 0) of paragraphs of ``one`` that ``other`` lacks; sections with an equal digest are not opened."""
    if one == other:
        return []
    sections = Counter(d for d, _ in _tree(other))
    paragraphs = Counter(d for _, ps in _tree(other) for d, _ in ps)
    out, at = [], 0
    for digest, ps in _tree(one):
        if sections[digest] > 0:
            sections[digest] -= 1
            paragraphs.subtract(d for d, _ in ps)
            at += len(ps)
            continue
        for d, _ in ps:
            if paragraphs[d] > 0:
                paragraphs[d] -= 1
            else:
                out.append(at)
            at += 1
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edits(pairs: DataFrame, one: str = "fingerprint", other: str = "edited_fingerprint", out: str = "changed") -> DataFrame:
    """``pairs`` with the numbers of the paragraphs of ``one`` that ``other`` lacks as last column; a null fingerprint gives null."""
    kept = [c for c in pairs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(one).to_pylist(), batch.column(other).to_pylist())
            found = [None if a is None or b is None else differences(a, b) for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*kept, out])

    return pairs.select(*kept).mapInArrow(run, T.StructType([*(pairs.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.LongType()))]))


_PAIR = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("changed", pa.list_(pa.int64()))])


def _compare(doc_id: int | None, text: str, mark: str, after: str, next_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, next_mark), differences(changed, mark)


def _bounds(keys: DataFrame, parts: int) -> DataFrame:
    """(stretch, bounds): the least key of each of about ``parts`` ranges of equal size, in stretches of about the root of their
    number, numbered in order; Spark's range partitioning cuts the ranges."""
    ranges = keys.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("key"))
    cut = ranges.agg(F.sort_array(F.collect_set("key")).alias("keys"))
    step = F.greatest(F.lit(1), F.round(F.sqrt(F.size("keys")))).cast("int")
    starts = F.when(F.size("keys") > 0, F.sequence(F.lit(1), F.size("keys"), step))
    return cut.select(F.posexplode(F.transform(starts, lambda i: F.slice("keys", i, step))).alias("stretch", "bounds"))


def _last_not_above(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= key)) - 1


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every text beside its edit: its last half replaced by as many of the next document's first characters; ``changed`` has
    the numbers of the edited text's paragraphs that the text lacks, found by the branches that differ.

    Ids and text hashes cut the documents in ranges; each document goes to its range once and
    the first of each range to the range before it too, so each task walks a whole range in
    order, holds two documents at a time, and needs nothing of other tasks.  Rows of one id are cut too, unless their texts are equal.
    The first bounds of the stretches, the root of the ranges in number, are in the plan, the others in a table joined by stretch.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not parts:
        # Ranges of some 64 MB however large the table is.
        chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars >> 26)
    given = given.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64("text").alias("hash")))
    stretches = _graph.saved(_bounds(given.select("key"), parts))
    heads = sorted((r["stretch"], r["head"], r["n"]) for r in stretches.select("stretch", F.col("bounds")[0].alias("head"), F.size("bounds").alias("n")).collect())
    n = sum(h[2] for h in heads)
    if not n:
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), _SPARK_PAIR)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAIR)], schema=_PAIR)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text, part, guest in zip(*(batch.column(i) for i in range(4))):
                doc_id, text, part, guest = doc_id.as_py(), text.as_py(), part.as_py(), guest.as_py()
                if guest and held is None:
                    continue
                mark = fingerprint(text)
                if held is not None:
                    rows.append(_compare(*held[:3], text, mark))
                held = None if guest else (doc_id, text, mark)
                if len(rows) >= 200:
                    yield out()
        if rows:
            yield out()

    tops = F.array(*[F.struct(F.lit(h["id"]).cast("long").alias("id"), F.lit(h["hash"]).cast("long").alias("hash")) for _, h, _ in heads])
    given = given.withColumn("stretch", _last_not_above(tops, F.col("key"))).join(_graph.small_lists(stretches, "bounds"), "stretch")
    given = given.withColumn("at", _last_not_above(F.col("bounds"), F.col("key")))
    given = given.withColumn("part", F.col("stretch") * heads[0][2] + F.col("at")).withColumn("first", F.element_at("bounds", F.col("at") + 1) == F.col("key"))
    before = F.pmod(F.col("part") - 1, F.lit(n))
    host = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    copies = F.when(F.col("first"), F.array(host, F.struct(before.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(host))
    dealt = given.select("doc_id", "text", "key", F.explode(copies).alias("c")).select("doc_id", "text", "key", "c.part", "c.guest")
    walked = dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("guest", "key").select("doc_id", "text", "part", "guest")
    return walked.mapInArrow(walk, _SPARK_PAIR)


_SPARK_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed array<long>"
