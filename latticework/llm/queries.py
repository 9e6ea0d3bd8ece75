"""The registered queries of this subpackage: thin digests of the operators' results over whole
tables, and SQL that DuckDB runs for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, crf, fm_index, hilbert, kneser_ney, minhash_join, rollup, templates, token_orc
from .common import read_table, scratch


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.extract(read_table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = cotrain.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_orc.write(read_table(spark, sf_dir, "documents"), path)
    return token_orc.digests(token_orc.read(spark, path))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = rollup.RollupStore(spark, scratch(spark, "rollup"))
    return rollup.lifecycle(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), store)


def rollup_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same life of a rollup over tokenizers that SQL can express."""
    store = rollup.RollupStore(spark, scratch(spark, "rollup"))
    return rollup.lifecycle(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), store, count=rollup.word_counts)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.digests(read_table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crf.held_out())
    model = crf.fit(docs.filter(~F.col("held_out")))
    out = crf.identify(docs, model, carry=["doc_id", "held_out"])
    found = F.col(out.columns[-1])
    return out.select("doc_id", "held_out", found["lang"].alias("lang_pred"), found["score"].alias("score"))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = kneser_ney.quality_rules(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = [*kneser_ney.COUNTS, "base_failed", "kept", "log_ppl"]
    return rules.select("doc_id", *[F.col(rules.columns[-1])[c].alias(c) for c in names])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return fm_index.digests(found, hits=found.columns[-1])


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_of")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_cotrained_quality": op2_cotrained_quality,
    "op3_token_orc": op3_token_orc,
    "op4_token_rollup": op4_token_rollup,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_crf_language": op6_crf_language,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fm_index": op9_fm_index,
    "op10_minhash_join": op10_minhash_join,
    "rollup_of_words": rollup_of_words,
}

_SIGNS = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"

ORACLE_SQL: dict[str, str] = {
    "rollup_of_words": rf"""
        WITH live AS (
            SELECT source, lang, regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g') AS text FROM documents
            WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
        ), counted AS (
            SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM live
            UNION ALL
            SELECT source, lang, 'signs-1', len(regexp_extract_all(text, '{_SIGNS}')) FROM live
        )
        SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
        FROM counted GROUP BY source, lang, tokenizer""",
}
