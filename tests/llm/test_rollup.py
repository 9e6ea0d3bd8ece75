import base64
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import rollup
from latticework.llm.queries import ORACLE_SQL, op4_token_rollup, rollup_of_words

KINDS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    store = rollup.RollupStore(spark, str(tmp_path / "r"))
    assert totals(store) == {}
    df = lambda *rows: spark.createDataFrame(rows, KINDS)
    first = df(("a", "x", "t", 1, 10), ("a", "x", "t", 1, 5), (None, None, "t", 1, None), ("b", "x", "t", 1, 7))
    assert store.commit("one", first) and not store.commit("one", first)
    assert store.commit("two", df(("a", "x", "t", -1, -5), ("b", "x", "t", 0, 2)))
    want = {("a", "x", "t"): (1, 10), (None, None, "t"): (1, 0), ("b", "x", "t"): (1, 9)}
    assert totals(store) == want
    before = store.totals()
    assert store.compact().startswith("~") and totals(store) == want and store.compact() is None
    assert {tuple(r)[:3]: tuple(r)[3:] for r in before.collect()} == want  # planned before, read after
    assert store.vacuum() == 0 and store.vacuum(-1) == 2 and totals(store) == want
    assert not store.commit("one", first) and not store.commit("two", first) and totals(store) == want
    assert store.commit("three", df(("b", "x", "t", -1, -9))) and store.commit("empty", df())
    del want[("b", "x", "t")]
    assert totals(store) == want and store.totals(zero=True).count() == 3
    assert store.compact() and totals(store) == want and store.covered() == {"one", "two", "three", "empty"}
    for name in ("a/b", "", "~x", ".x"):
        with pytest.raises(ValueError):
            store.commit(name, first)


def test_attempts_without_marker_and_dead_writers_do_not_count(spark, tmp_path):
    store = rollup.RollupStore(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "x", "t", 1, 3)], KINDS)
    store._write("lost", rows)
    assert totals(store) == {}
    store._aside("half a mar")  # a writer that died before it renamed its marker
    assert totals(store) == {} and store.commit("one", rows) and totals(store) == {("a", "x", "t"): (1, 3)}
    assert not store._publish(store._marker("one"), "other") and totals(store) == {("a", "x", "t"): (1, 3)}
    assert store.vacuum(-1) == 2 and totals(store) == {("a", "x", "t"): (1, 3)}


def test_a_crash_in_compaction_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    store = rollup.RollupStore(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "x", "t", 1, 3)], KINDS)
    for name in ("one", "two", "three"):
        store.commit(name, rows)
    want = {("a", "x", "t"): (3, 9)}
    real = rollup.filesystem
    for stop in range(1, 9):  # the n-th use of the file system fails
        uses = iter(range(1, 1000))

        def fails(*a, stop=stop, uses=uses):
            if next(uses) == stop:
                raise RuntimeError("lost")
            return real(*a)

        monkeypatch.setattr(rollup, "filesystem", fails)
        try:
            store.compact()
        except RuntimeError:
            pass
        monkeypatch.setattr(rollup, "filesystem", real)
        assert totals(store) == want and store.covered() == {"one", "two", "three"}
        assert not store.commit("two", rows)
    store.compact()
    assert totals(store) == want


def test_words_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(con.execute(ORACLE_SQL["rollup_of_words"]).fetchall())
    got = rollup_of_words(spark, d).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()
    assert sorted(map(tuple, got)) == want


def test_tokens_against_the_libraries(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    docs = con.execute(f"SELECT source, lang, text FROM '{d}/documents.parquet' WHERE doc_id NOT IN (SELECT doc_id FROM '{d}/labels.parquet' WHERE toxic = 1)").fetchall()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for source, lang, text in docs:
        text = re.sub(r"[#*$%&|<>]", "", text or "")
        for name, n in (("byte_bpe_50k.json", len(plain.encode(text, add_special_tokens=False).ids)), ("byte_bpe_multi_50k.tiktoken", len(multi.encode_ordinary(text)))):
            want[source, lang, name, "docs"] += 1
            want[source, lang, name, "tokens"] += n
    got = op4_token_rollup(spark, d).collect()
    assert {(r.source, r.lang, r.tokenizer, k): v for r in got for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens))} == want


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a #b", "s", None), (1, "a #b", "s", None), (None, None, None, "en"), (3, "", "s", "en"), (4, "x" * 50_000, "s", "en")], "doc_id long, text string, source string, lang string")
    docs = docs.withColumn("docs", F.lit("clash")).withColumn("tokens", F.lit(0))
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.lifecycle(docs, labels, rollup.RollupStore(spark, str(tmp_path / "o")), count=rollup.word_counts).collect()}
    assert got == {("s", None, "words-1"): (2, 4), ("s", None, "signs-1"): (2, 4), (None, "en", "words-1"): (1, 0), (None, "en", "signs-1"): (1, 0), ("s", "en", "words-1"): (1, 0), ("s", "en", "signs-1"): (1, 0)}
    tokens = {tuple(r)[:3]: tuple(r)[3:] for r in rollup.lifecycle(docs, labels, rollup.RollupStore(spark, str(tmp_path / "b"))).collect()}
    assert tokens[None, "en", "byte_bpe_50k.json"] == (1, 0) and tokens["s", None, "byte_bpe_multi_50k.tiktoken"] == (2, 4)
    assert rollup.lifecycle(docs.limit(0), labels, rollup.RollupStore(spark, str(tmp_path / "e"))).collect() == []
