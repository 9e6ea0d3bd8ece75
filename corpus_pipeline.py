"""A corpus pipeline over ``documents``: each stage's rows are written and read as the next one's.

All stages but the last return the columns of their input. Null texts, ties, repeated rows and
empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, crf, fm_index, kneser_ney, minhash_join
from latticework.llm.common import materialise, read_table

#: A document's language must hold this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that holds half of them, go."""
    model = crf.fit(docs.filter(~crf.held_out()))
    out = crf.identify(docs, model)
    found = F.col(out.columns[-1])
    return out.filter((found["lang"] != crf.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity bands go."""
    return kneser_ney.quality_rules(docs, only_kept=True).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return minhash_join.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go."""
    out = fm_index.find(docs, read_table(spark, sf_dir, "benchmark"))
    return out.filter(~F.col(out.columns[-1])["contaminated"]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: SQL can't express the stages; the tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
