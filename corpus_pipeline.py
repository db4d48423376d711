"""A training corpus from ``documents``: five stages, each over all the one before kept.

1. toxicity: documents that the ordinal model rejects go.
2. line dedup: later occurrences of three-line windows leave the texts.
3. MinHash near-dedup: one document of each group of near copies stays (five words, similarity 0.8).
4. benchmark decontamination: documents that hold a benchmark item go.
5. byte-level BPE: every remaining text is encoded and decoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import _graph, bpe, decontam, lines, minhash, toxicity
from assayer.shipping import ship

RANKS = "byte_bpe_multi_50k.tiktoken"


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return lines.clean(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("minhash_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("byte_bpe", _bpe),
]

#: The first stage is a trained model and the last a tokenizer, so SQL has no equivalent; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _graph.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
