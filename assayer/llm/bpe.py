"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (operator 4).

Long texts are cut before encoding where white space follows another character: every
alternative of the splitting pattern ends there, so the pieces encode to the same ids as the whole.
A long run of white space is one match but for its last character (or whole, at the end of a text); the library's
pattern engine would run out of stack on it, so it is found here and goes to the library as one match.
Ids are decoded to bytes, never through a character decoder, so token boundaries inside a character do no harm.

Rows: a null text is an empty one (no ids, no bytes); every row gives a row, repeated ids
and null ids as well.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import _text

PIECE = 1 << 16
#: White space as the splitting pattern has it (the Unicode property), a fixed value.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NEXT_BREAK = re.compile(f"(?<=[^{_BLANK}])[{_BLANK}]")
_LONG_BLANK = re.compile(f"[{_BLANK}]{{1000,}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _decimals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """``text`` in pieces of about ``size`` characters, cut only where the pattern cuts too, and whether each is one match."""
    begin = 0
    for blank in _LONG_BLANK.finditer(text):
        yield from _parts(text[begin : blank.start()], size)
        begin = blank.end() if blank.end() == len(text) else blank.end() - 1
        yield text[blank.start() : begin], True
    yield from _parts(text[begin:], size)


def _parts(text: str, size: int) -> Iterator[tuple[str, bool]]:
    begin = 0
    while len(text) - begin > size and (found := _NEXT_BREAK.search(text, begin + size)):
        yield text[begin : found.start()], False
        begin = found.start()
    yield text[begin:], False


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PIECE) -> list[int]:
    if len(text) < 1000:
        return enc.encode_ordinary(text)
    return [i for piece, one in pieces(text, size) for i in (enc._encode_single_piece(piece) if one else enc.encode_ordinary(piece))]


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for a, b in _text.runs(batch.column(1)):
                ids = [encode_text(enc, t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _given(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes of (doc_id, ids); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        names = _decimals(enc.n_vocab)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for a, b in _text.runs(batch.column(1)):
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    ids = encode_text(enc, text)
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _given(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
