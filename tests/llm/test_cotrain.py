import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from latticework.llm import cotrain as ct


def test_text_rows_and_logits():
    known = ct._Rows()
    a, b = ct.text_rows("One two, TWO 3 one", known), ct.text_rows("", known)
    assert len(a) == 2 and len(b) == 0 and list(a) == sorted(a)
    w = np.zeros(ct.BUCKETS, np.float32)
    w[a] = (1.5, -0.25)
    assert ct.logits(pa.array([a.tobytes(), b.tobytes(), None], pa.binary()), w, 0.5).tolist() == [1.75, 0.5, 0.5]


def test_logistic_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2)) * (100, 0.1)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x[:, 0] / 50 - 10 * x[:, 1] + 0.3)))).astype(int)
    w = ct.logistic(x, y)
    assert np.allclose(w * (50, 0.1, 1), (1, -1, 0.3), atol=0.2)
    assert np.isfinite(ct.logistic(np.array([[0.0], [1.0], [0.0], [1.0]]), np.array([0, 1, 0, 1]))).all()


def make(n):
    random.seed(11)
    good, bad, common = ([f"{p}{i}" for i in range(12)] for p in ("gut", "bad", "wort"))
    letters = lambda w: w.translate(str.maketrans("0123456789", "abcdefghij"))
    rows = []
    for i in range(n):
        q = int(random.random() < 0.6)
        words = random.choices(common, k=30) + random.choices(good if q else bad, k=random.choice([0, 1, 3]))
        random.shuffle(words)
        source = random.choices(["a", "b"], (4, 1) if q else (1, 4))[0]
        rows.append((i, " ".join(map(letters, words)) + (" ###" * random.choice([0, 9]) if not q else ""), source, "en", q))
    return rows


def test_held_out_documents_and_odd_rows(spark):
    rows = make(900)
    docs = spark.createDataFrame([r[:4] for r in rows] + [(None, "gutab", "a", None), (5000, None, None, None), (5001, "", "a", "en"), (3, rows[3][1], "a", "en")], "doc_id long, text string, source string, lang string")
    docs = docs.withColumn("_words", F.lit(1)).withColumn("quality_score", F.lit("x"))
    marks = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:200]] + [(7, None, None), (None, 1, 1), (5001, 0, 1)], "doc_id long, quality int, toxic int")
    out = ct.classify(docs, marks, targets=("quality",))
    got = out.collect()
    assert len(got) == 904 and out.columns == ["doc_id", "quality_score"]
    score = {r.doc_id: r.quality_score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    held = [(score[r[0]] >= 0.5) == r[4] for r in rows[200:]]
    alone = ct.classify(docs, marks, targets=("quality",), rounds=0).collect()
    before = {r.doc_id: r.quality_score for r in alone}
    assert np.mean(held) > 0.8
    brier = lambda s: np.mean([(s[r[0]] - r[4]) ** 2 for r in rows[200:]])
    assert brier(score) < brier(before) + 0.01


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([r[:4] for r in make(20)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.quality_score, r.toxic_score) for r in ct.classify(docs, none).collect()} == {(0.5, 0.5)}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {(r.quality_score, r.toxic_score) for r in ct.classify(docs, one).collect()} == {(1.0, 0.0)}
    assert ct.classify(docs.limit(0), none).collect() == []


def area(scores, y):
    """Area under the ROC curve."""
    place = np.empty(len(scores))
    place[np.argsort(scores, kind="stable")] = np.arange(1, len(scores) + 1)
    y = np.array(y)
    return (place[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_rounds_help_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {}
    for rounds in (0, 2):
        rows = ct.classify(docs, labels.filter(~held), rounds=rounds).join(labels.filter(held), "doc_id").collect()
        got[rounds] = [area([r[f"{t}_score"] for r in rows], [r[t] for r in rows]) for t in ("quality", "toxic")]
        got[rounds].append(np.mean([r.toxic_score >= 0.5 for r in rows if r.toxic]))
    assert got[2][0] > 0.97 and got[2][0] >= got[0][0] - 0.002
    assert got[2][1] > got[0][1] + 0.01 and got[2][1] > 0.95 and got[2][2] > got[0][2] + 0.05, got


def test_one_id_with_very_many_rows_is_bounded(spark, monkeypatch):
    seen = []
    real = ct.cotrain
    monkeypatch.setattr(ct, "cotrain", lambda rows, taken, targets, **how: seen.append(len(taken)) or real(rows, taken, targets, **how))
    rows = make(300)
    hot = spark.range(20_000).selectExpr("3L AS doc_id", "concat('gutab wort', id % 2000) AS text", "'a' AS source", "'en' AS lang")
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string").unionByName(hot)
    marks = spark.createDataFrame([(r[0], r[4]) for r in rows[:100]], "doc_id long, quality int")
    out = ct.classify(docs, marks, targets=("quality",), labelled_limit=60, rounds=1)
    assert out.count() == 20_300 and seen[0] <= 60


def test_very_long_texts(spark):
    rows = [*make(40), (900, "gutab " * 400_000, "a", "en", 1), (901, "x" * 3_000_000, "b", "en", 0)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    assert ct.classify(docs, marks, targets=("quality",)).filter("quality_score BETWEEN 0 AND 1").count() == 42
