"""Prefix trie of conversations that share their opening turns (operator 11).

Conversation c belongs to the family of c - c % 20 and is rebuilt: the first h turns of that base conversation, h =
crc32(c) % 4, then its own turns after its first h.  A node is a distinct sequence of first turns, named by its depth and
two 64-bit sums (exclusive or) of the hashes of its turns with their places, so that a node's name is found without
walking from the root and its parent's name is its own without the last term.

Family first: base and members come together by base id, and a family's own trie (one row for each of its nodes, its members as bits) is
built where the family lies; only these combined nodes are shuffled to be merged with other families'.  What a
subtree adds up to is taken along the conversations: each node counts for its smallest member alone, the members' running
sums from the end are added up by node.

Texts are read once, for their hash and number of words, and never shuffled.  A long conversation
is cut in blocks of 2^16 turns that go to different tasks, with the totals of earlier blocks added; a node of very many members is a
count, and the ids that end at a node run through one digest in order (SHA-256 can't be split), never held together.

Rows: a null turn comes first; equal turns go by the hash of role and text; null role or text is empty; repeated rows are turns of their own;
rows without conv_id belong to no conversation and are left out; an empty table has no node, not even the root.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph

FAMILY, BORROWED = 20, 4
#: Turns of a conversation that one task takes at once: 2 to this power.
BLOCK_BITS = 16
NODE = ["depth", "a", "b"]


def _running(rows: DataFrame, names: list[str], order: list[Column], block: Column, last_first: bool, total: Callable[[str], Column], plus: Callable[[Column, Column], Column]) -> DataFrame:
    """Saved ``rows`` (family, conv, ..) with running totals of ``names`` in each conversation, this row included.

    A window adds up within a block, the totals of the blocks before are joined: no task holds a conversation.
    """
    cut = rows.withColumn("block", block)
    whole = Window.partitionBy("family", "conv").orderBy(F.desc("block") if last_first else "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("family", "conv", "block").agg(*[total(n).alias(n) for n in names])
    before = sums.select("family", "conv", "block", *[total(n).over(whole).alias(f"{n}_before") for n in names]).where(F.col(f"{names[0]}_before").isNotNull())
    own = Window.partitionBy("family", "block", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.repartition("family", "block").withColumns({n: total(n).over(own) for n in names})
    # Only conversations of more than a block have a row here.
    out = inside.join(_graph.small(_graph.saved(before)), ["family", "conv", "block"], "left")
    return out.withColumns({n: F.when(F.col(f"{n}_before").isNull(), F.col(n)).otherwise(plus(F.col(n), F.col(f"{n}_before"))) for n in names}).drop(*[f"{n}_before" for n in names])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def numbered(conversations: DataFrame) -> DataFrame:
    """(family, conv, pos, ha, hb, words), saved: every turn's place from 1, two hashes of its role and text, its number of words."""
    conv, said = F.col("conv_id").cast("long"), [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(*said).alias("ha"), F.xxhash64(F.lit(1), *said).alias("hb"),
        F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("pos"),
    )
    # A null turn comes before all others, so its block does too.
    block = F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 60)))
    placed = _running(_graph.saved(rows), ["pos"], [F.col("turn"), F.col("ha"), F.col("hb")], block, False, F.sum, lambda x, y: x + y)
    return _graph.saved(placed.select("family", "conv", "pos", "ha", "hb", "words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(family, conv, depth, a, b, words) of every conversation after it took its base's first turns; a and b are the turn's terms."""
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED
    heads = turns.where((F.col("conv") == F.col("family")) & (F.col("pos") < BORROWED))
    lengths = heads.groupBy("family").agg(F.max("pos").alias("n_heads"))
    moved = F.col("pos") - taken + F.least(taken, F.coalesce("n_heads", F.lit(0)))
    own = turns.join(lengths, "family", "left").where((F.col("conv") == F.col("family")) | (F.col("pos") > taken))
    own = own.select("family", "conv", F.when(F.col("conv") == F.col("family"), F.col("pos")).otherwise(moved).alias("depth"), "ha", "hb", "words")
    others = turns.where("pos = 1 and conv <> family").select("family", "conv")
    given = others.join(heads.drop("conv"), "family").where(F.col("pos") <= taken).select("family", "conv", F.col("pos").alias("depth"), "ha", "hb", "words")
    return own.unionByName(given).select("family", "conv", "depth", F.xxhash64("depth", "ha").alias("a"), F.xxhash64("depth", "hb").alias("b"), "words")


def family_nodes(turns: DataFrame) -> DataFrame:
    """(family, block, depth, a, b, up_a, up_b, words, conv, members): the combined nodes of each family's trie.

    ``members`` has the bit conv - family + FAMILY - 1 of each conversation of the family that passes, conv is the least of them.
    """
    rows = _graph.saved(rebuilt(turns).withColumns({"ka": F.col("a"), "kb": F.col("b")}))
    block = F.shiftright("depth", BLOCK_BITS)
    named = _running(rows, ["ka", "kb"], [F.col("depth")], block, False, F.bit_xor, _xor)
    bit = F.expr(f"shiftleft(1L, cast(conv - family + {FAMILY - 1} as int))")
    # Rows of a family and block are in one task since the running totals: no further shuffle.
    return named.groupBy("family", "block", "depth", F.col("ka").alias("a"), F.col("kb").alias("b")).agg(
        F.min(_xor(F.col("ka"), F.col("a"))).alias("up_a"), F.min(_xor(F.col("kb"), F.col("b"))).alias("up_b"), F.max("words").alias("words"), F.min("conv").alias("conv"), F.bit_or(bit).alias("members")
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv): the digest of each node's ids, in order, fed id by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
            ids = batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(ids)] if ids else []
            done = []
            for start, end in zip(cuts, cuts[1:]):
                key, part = tuple(keys[start].tolist()), ",".join(map(str, ids[start:end]))
                if key == now:
                    part = "," + part
                elif now is not None:
                    done.append((*now, state.hexdigest()))
                if key != now:
                    now, state = key, hashlib.sha256()
                state.update(part.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], d)) for d in done], shape)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*now, state.hexdigest())))], shape)

    shape = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    dealt = ends.select(*NODE, "conv").repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a, b) of every node.

    conv_id is the smallest member; saved_tokens adds up, over the subtree, the words of each node's last turn for every member
    but one: what a shared prefix saves.  ``a`` and ``b`` with the depth name the node's sequence of turns.
    """
    turns = numbered(conversations)
    convs = turns.where("pos = 1").select("family", "conv")
    families = _graph.saved(family_nodes(turns))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "words")]
    # The root's part of each task is one row before it is merged.
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(*zero, "n_convs", "conv_id")
    merged = families.groupBy(*NODE).agg(
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("words").alias("words"), F.sum(F.bit_count("members")).cast("long").alias("n_convs"), F.min("conv").alias("conv_id")
    )
    merged = _graph.saved(merged.select(*NODE, "up_a", "up_b", "words", "n_convs", "conv_id").unionByName(root))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = merged.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    worth = (F.col("n_convs") - 1) * F.col("words")
    kept = _graph.saved(merged.join(children, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": worth}).withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    members = F.expr(f"filter(sequence(0, {2 * FAMILY - 2}), i -> getbit(members, i) = 1)")
    passed = families.select("family", *NODE, F.explode(members).alias("bit")).select("family", (F.col("family") + F.col("bit") - (FAMILY - 1)).alias("conv"), *NODE)
    own = kept.where("depth > 0").select(F.col("conv_id").alias("conv"), "depth", "saved", "leaf")
    weighed = _graph.saved(passed.join(own, ["conv", "depth"], "left").fillna(0, ["saved", "leaf"]))
    sums = _running(weighed, ["saved", "leaf"], [F.desc("depth")], F.shiftright("depth", BLOCK_BITS), True, F.sum, lambda x, y: x + y)
    sums = sums.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    whole = kept.agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.count("*").alias("n")).where("n > 0").select(*zero[:3], "saved_tokens", "n_leaves")

    last = weighed.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("end")).select("conv", "end.*")
    ends = convs.select("conv").join(last, "conv", "left").fillna(0, NODE)
    parents = kept.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    # The root has most children of all; its id is one number, so it isn't joined by key.
    top = merged.where("depth = 0").select("conv_id").first()
    below = kept.where("depth > 1").join(parents.withColumn("depth", F.col("depth") + 1).withColumnsRenamed({"a": "up_a", "b": "up_b"}), ["depth", "up_a", "up_b"])
    named = below.select(*kept.columns, "parent_conv_id").unionByName(kept.where("depth = 1").withColumn("parent_conv_id", F.lit(top and top[0]).cast("long")))
    named = named.unionByName(kept.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(sums.unionByName(whole), NODE).join(_digests(ends), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "a", "b")
