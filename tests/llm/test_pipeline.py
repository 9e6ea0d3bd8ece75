import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from latticework.llm import crf, kneser_ney, queries

from .test_fm_index import brute as brute_hits
from .test_kneser_ney import brute_kept
from .test_minhash_join import brute as brute_links
from .test_minhash_join import sets_of

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def brute_language(model, text):
    """Language and score by forward-backward over one text at a time."""
    words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
    if not words:
        return "und", 0.0
    post, _ = crf.forward_backward(model.scores.of(words), np.array([len(words)]), model.trans)
    mass = (post * np.array([len(w) for w in words])[:, None]).sum(0)
    return model.langs[mass.argmax()], mass.max() / mass.sum()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_against_brute_force(spark, docs, tmp_path):
    at = {}
    now = docs
    for name, stage in cp.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        at[name] = (now, out := spark.read.parquet(str(tmp_path / name)))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        now = out

    before, after = at["language_id"]
    model = crf.fit(before.filter(~crf.held_out()))
    assert set(rows_of(after)) == {(k, t) for k, t in rows_of(before) if brute_language(model, t)[1] >= cp.LEAST_LANGUAGE_SHARE}

    before, after = at["quality_rules"]
    picked, own = kneser_ney.sources(before, [], "text", "lang")
    want, _ = brute_kept(picked, own, [r.doc_id for r in before.select("doc_id").collect()])
    assert {k for k, _ in rows_of(after)} == {k for k, kept in want.items() if kept}
    assert len(rows_of(after)) > 0.7 * before.count()

    before, after = at["near_duplicates"]
    rows = rows_of(before)
    groups = {(c if sets_of(dict(rows)[k]) else k) for k, c, _ in brute_links(rows)}
    assert {k for k, _ in rows_of(after)} == groups and len(rows_of(after)) == len(groups)

    before, after = at["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(after) == [r for r, hit in zip(rows_of(before), brute_hits(rows_of(before), bench)) if not hit[-1]]

    before, after = at["byte_bpe"]
    assert sorted((r.doc_id, r.decoded_sha256) for r in after.collect()) == [(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in rows_of(before)]


def test_odd_rows_pass_through_every_stage(spark, docs):
    odd = docs.limit(60).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "words " * 9, None, None, 5), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, "x " * 40_000, "en", None, 1)], docs.schema))
    odd = odd.withColumn("rules", F.lit(1)).withColumn("hits", F.lit("h")).withColumn("class_id", F.lit(0)).withColumn("first", F.lit(0)).withColumn("_text", F.lit("t"))
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        assert 0 < out.count() <= odd.count()
        if name != "byte_bpe":
            assert out.columns == odd.columns
        stage(spark, odd.limit(0), SF).collect()


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(cp.STAGES) == 5
