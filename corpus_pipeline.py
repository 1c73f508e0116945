"""The corpus pipeline: stages over documents, each written and reread as the next one's input.

A stage leaves intermediate tables in the shared folder, which its result reads; the result lists them in its attribute left.
release(result) deletes them once the result is written. A stage that is called also releases the results of earlier calls
that nothing references any more, so stages may be planned and read in any order while their results are held.
"""

from __future__ import annotations

import weakref
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import drop_tables, recorded, stored, table
from tracelake.llm.line_dedup import dedup_lines
from tracelake.llm.mixing import mix
from tracelake.llm.ngram_join import keep_one
from tracelake.llm.quality_rules import keep_good
from tracelake.llm.queries import MIX_DOMAIN, MIX_SEED, MIX_SHARE, MIX_WEIGHTS
from tracelake.llm.sentencepiece_codec import round_trip


_held: list[tuple[weakref.ref, list[str]]] = []  # results and their tables


def release(result: DataFrame) -> None:
    """Delete the intermediate tables of a stage's result, which cannot be read any more then."""
    drop_tables(result.sparkSession, result.left)


def _stage(function):
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for held, left in list(_held):
            if held() is None:
                drop_tables(spark, left)
                _held.remove((held, left))
        left: list[str] = []
        with recorded(left):
            out = function(spark, docs, sf_dir)
        out.left = left
        _held.append((weakref.ref(out), left))
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the log-likelihood ratio keep; trusted are those labelled 1."""
    return keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies of lines; n_chars is that of the new text. Documents left empty go."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word n-grams, similarity 0.8."""
    return keep_one(docs, n=5, percent=80).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded token-prefix of every source by the target weights, no document twice."""
    weights = {k: F.expr(v) for k, v in MIX_WEIGHTS.items()}
    return mix(docs, F.expr(MIX_DOMAIN), weights, MIX_SHARE, epochs=1, seed=MIX_SEED).select(*docs.columns)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text, and whether they decode to it again."""
    rows = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, the last one's rows: doc_id, n_pieces, ids, round_trip.

    Nulls, repeated rows and clashing columns follow the stages' operators; ties in mixing go by a hash of the seed and doc_id.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(result)
            release(result)
    return result
