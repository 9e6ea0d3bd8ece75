import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import crf
from latticework.llm.queries import op6_crf_language


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 0, 1, 4])
    emit, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    post, pairs = crf.forward_backward(emit, lengths, trans, count=True)
    want, want_pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        total = 0
        p, q = np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(emit[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                p[i, y] += w
            for a, b in zip(path, path[1:]):
                q[a, b] += w
        want[at : at + n] = p / total
        want_pairs += q / total
        at += n
    assert post == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def speakers():
    random.seed(6)
    made = {}
    for lang, letters in (("aa", "abcdefgh"), ("bb", "ghijklmnop"), ("cc", "opqrstuéñ")):
        made[lang] = ["".join(random.choices(letters, k=random.randint(2, 8))) for _ in range(300)]
    return made


def test_code_switched_words_and_documents(spark):
    made = speakers()
    speak = lambda lang, n: " ".join(random.choices(made[lang], k=n))
    rows = [(i, speak(lang, random.randint(5, 120)), lang) for i, lang in enumerate(random.choices(list(made), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.fit(df, per_language=60)
    mixed = spark.createDataFrame([(1, speak("aa", 30) + ". " + speak("cc", 10)), (2, speak("bb", 700) + speak("aa", 100))], "doc_id long, text string")
    words = {r.doc_id: [w.lang for w in r.words] for r in crf.word_labels(mixed, model).collect()}
    assert np.mean([a == b for a, b in zip(words[1], ["aa"] * 30 + ["cc"] * 10)]) > 0.95
    got = {r.doc_id: r.language for r in crf.identify(mixed, model).collect()}
    assert got[1].lang == "aa" and 0.6 < got[1].score < 0.9 and got[2].lang == "bb"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ! ½ ²"), (None, "ABCDEF"), (5, "x" * 100_000), (5, "x" * 100_000)], "doc_id long, text string").withColumn("language", F.lit(1))
    out = crf.identify(odd, model)
    got = [(r.doc_id, r[out.columns[-1]]) for r in out.collect()]
    assert [g.lang for k, g in got if k in (1, 2, 3)] == ["und"] * 3 and len(got) == 6
    assert all(0 <= g.score <= 1 for _, g in got)
    assert crf.fit(df.limit(0)) is None and crf.identify(mixed, None).first().language.lang == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op6_crf_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r.lang == r.lang_pred for r in out if r.held_out and r.lang]
    assert len(out) == docs.count() and np.mean(held) > 0.99


def test_stretches_give_what_whole_chains_give():
    rng = np.random.default_rng(4)
    for k in (1, 3, 5):
        lengths = np.array([0, 1, 255, 256, 257, 512, 513, 3000, 2, 0, 700])
        emit, trans = rng.normal(size=(int(lengths.sum()), k)) * 0.3, rng.normal(size=(k, k)) * 2
        assert crf.posteriors(emit, lengths, trans) == pytest.approx(crf.forward_backward(emit, lengths, trans)[0], abs=1e-9)
    assert crf.posteriors(np.zeros((0, 3)), np.array([0, 0]), np.zeros((3, 3))).shape == (0, 3)


def test_words_are_letters():
    assert crf.words_of("a½b ² Ⅷ x_y 3z ñÉ 中文 ①") == ["a", "b", "x", "y", "z", "ñé", "中文"]


def test_what_comes_to_the_driver_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "train", lambda rows: seen.append(rows))
    same = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text", "'aa' AS lang")
    equal = spark.range(20_000).selectExpr("7L AS doc_id", "'one text' AS text", "'bb' AS lang")
    more = spark.range(5).selectExpr("id AS doc_id", "concat('rare ', id) AS text", "concat('l', id) AS lang")
    docs = same.unionByName(equal).unionByName(more)
    crf.fit(docs, per_language=200)
    by = {lang: [t for t, x in seen[0] if x == lang] for _, lang in seen[0]}
    assert len(by["aa"]) == len(set(by["aa"])) == 200 and by["bb"] == ["one text"] and all(len(by[f"l{i}"]) == 1 for i in range(5))
    crf.fit(docs, per_language=200, most_languages=2)
    assert {lang for _, lang in seen[1]} == {"aa", "bb"}
