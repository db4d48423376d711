"""Reply trees as conversations with a loss mask (operator 1).

Messages (tree, node, parent, score, role, text) form a tree by their parents.  Iterated
self-joins on ids alone double the reach of every message's pointer to an ancestor, so a reply
of depth d takes log2(d) joins; they give the score of every root-to-leaf path.  The best
paths of each tree are kept, their messages are found by going the same jumps down again,
and only then the texts are joined and formatted.

Template: ``<s>[INST]`` role ``[/INST]`` text ``</s>`` for each turn.  Inside roles and texts a
backslash is doubled and one is put after the first character of each of these four strings,
so none of them occurs in a role or text and the output can be read back exactly.  The loss
mask is the spans (code points, end exclusive) of the assistant's escaped texts.

Rows: a null role or text is empty; a null or unknown parent makes a root; messages whose
parents run in a circle are on no path; a null node id is never a parent; messages with equal tree and
node are one message (the greatest by parent, role, text stays); paths of equal score go by the
leaf's id.  Null trees are one tree.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import _graph

BEGIN, SAID, END = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation of (role, text) turns and the spans of its loss mask."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = BEGIN + escape(role) + SAID, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(BEGIN).partition(SAID)
        out.append((unescape(role), unescape(text)))
    return out


def best_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """(tree, leaf, path_score, node, back): the messages of each tree's best root-to-leaf paths.

    ``back`` counts the replies from the message to the leaf; path_score is the sum of the messages' scores (null: 0).
    """
    ids = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("node is not null")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    ids = ids.join(known, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    state = _graph.saved(ids.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total")))
    parents = state.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = state.join(parents, ["tree", "node"], "left_anti").select("tree", "node")
    jumps = []
    for _ in range(2 + math.ceil(math.log2(1 + state.count()))):
        climbing = state.where("up is not null").select("tree", "node", "up")
        if _graph.is_empty(climbing):
            break
        jumps.append(climbing)
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        # Only messages below a root's reach are joined again; every parent is there.  Merged at any size: the pointers grow with the table.
        higher = state.where("up is not null").join(above.hint("merge"), ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))
        state = _graph.saved(state.where("up is null").unionByName(higher))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    ends = state.where("up is null").join(leaves, ["tree", "node"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= paths_per_tree)
    found = ends.select("tree", F.col("node").alias("leaf"), F.col("total").alias("path_score"), "node", F.lit(0).alias("back"))
    for power in reversed(range(len(jumps))):
        up = found.join(jumps[power], ["tree", "node"]).select("tree", "leaf", "path_score", F.col("up").alias("node"), (F.col("back") + (1 << power)).alias("back"))
        found = _graph.saved(found.unionByName(up))
    return found


def format_paths(messages: DataFrame, paths_per_tree: int = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, path_score, formatted, loss): each chosen path as one conversation.

    ``unique`` says that no two messages share tree and node, which spares the texts a shuffle.
    """
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    given = messages.select(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), "node", "parent", "score", *text)
    if not unique:
        one = F.max(F.struct("parent", "role", "text", "score"))
        given = given.groupBy("tree", "node").agg(one.alias("m")).select("tree", "node", "m.*")
    return _formatted(best_paths(given, paths_per_tree).join(given.select("tree", "node", "role", "text"), ["tree", "node"]))


def _formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, path_score, formatted, loss) of paths whose messages (back, role, text) are rows."""
    turn = F.struct((-F.col("back")).alias("at"), "role", "text")
    whole = turns.groupBy("tree", "leaf", "path_score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(3)]
            loss = pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t for t, _ in made], pa.string()), loss], ["tree", "leaf", "path_score", "formatted", "loss"])

    return whole.mapInArrow(run, "tree string, leaf long, path_score double, formatted string, loss array<struct<start: long, end: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted text and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                lost = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch, in the order of turn, role and hash of the text."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "mark")
    node = F.row_number().over(own).cast("long")
    # Where only ids are read, only the hash of the text goes through the shuffle.
    given = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("mark")).withColumn("node", node)
    return given.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_chains(conversations: DataFrame) -> DataFrame:
    """``format_paths`` of ``chains``, with the texts moved twice: to their places on the paths and to their conversations.

    Order and paths are found on ids and hashes; a text is told by a 64-bit hash of its turn, role and words within its conversation,
    and equal rows are sent once.
    """
    tree, blank = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    said = F.xxhash64(F.col("turn").isNull(), F.coalesce("turn", F.lit(0)), *blank)
    own = Window.partitionBy("tree").orderBy("turn", "role", "mark")
    rows = conversations.select(tree.alias("tree"), "turn", "role", F.xxhash64("text").alias("mark"), said.alias("said"))
    ids = _graph.saved(rows.select("tree", F.row_number().over(own).cast("long").alias("node"), "said"))
    messages = ids.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    places = best_paths(messages).join(ids, ["tree", "node"])
    texts = conversations.select(tree.alias("tree"), said.alias("said"), blank[0].alias("role"), blank[1].alias("text"))
    once = texts.groupBy("tree", "said").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return _formatted(places.join(once, ["tree", "said"]).select("tree", "leaf", "path_score", "back", "role", "text"))
