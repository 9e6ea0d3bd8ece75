import glob
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from latticework.llm import token_orc
from latticework.llm.common import tokenizer_file


def expected(rows):
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    out, at = [], 0
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_and_digests(spark, tmp_path):
    rows = [(i * 7, f"Text number {i}, it's  fine. " * (i % 9)) for i in range(300)] + [(3, None), (5, ""), (6, "long " * 30_000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, ids int, part int").repartition(5)
    token_orc.write(df, str(tmp_path / "t"))
    got = token_orc.digests(token_orc.read(spark, str(tmp_path / "t"))).collect()
    assert sorted(map(tuple, got)) == expected(sorted(rows, key=lambda r: r[0]))
    one = token_orc.ids_of(spark, str(tmp_path / "t"), [14, 21])
    assert sorted(r.doc_id for r in one.collect()) == [14, 21]
    assert "PushedFilters: [In(doc_id, [14,21])]" in one._jdf.queryExecution().toString()


def test_ties_nulls_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "x"), (None, None)], "doc_id long, text string")
    token_orc.write(df, str(tmp_path / "t"))
    got = sorted(token_orc.digests(token_orc.read(spark, str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1]
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    token_orc.write(df.limit(0), str(tmp_path / "e"))
    schema = spark.read.orc(str(tmp_path / "t")).schema
    assert token_orc.digests(token_orc.read(spark, str(tmp_path / "e"), schema)).collect() == []


def test_added_tokens_are_single_ids(spark, tmp_path):
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = [(1, "plain text"), (2, "a <|endoftext|> b"), (3, "<|endoftext|><|endoftext|>"), (4, None), (5, "<|endoftext|"), (6, "it's <|endoftext|>\n fine")]
    token_orc.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"))
    got = token_orc.ids_of(spark, str(tmp_path / "t"), [k for k, _ in rows]).collect()
    assert {r.doc_id: r.ids for r in got} == {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in rows}
    assert {r.doc_id: r.ids for r in got}[2] == [64, 220, 50256, 275, 0]


def scanned(df):
    """Rows that the scan of ``df`` hands on, after stripes and row groups are skipped."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.fixture
def many_files(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_stripes_row_indexes_and_bloom_filters(spark, tmp_path, many_files):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).selectExpr("id * 2 AS doc_id", "concat('text number ', id, repeat(' and more', 20)) AS text").repartition(4)
    token_orc.write(rows, path, stripe_mb=1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    ranges = []
    for f in glob.glob(f"{path}/part-*"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() > 1000
        records = reader.rows()
        for stripe in reader.getStripes():
            footer = records.readStripeFooter(stripe)
            kinds = [(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()]
            assert (1, "ROW_INDEX") in kinds and (1, "BLOOM_FILTER_UTF8") in kinds and (2, "BLOOM_FILTER_UTF8") not in kinds
            assert [c.getKind().toString() for c in footer.getColumnsList()][-1] == "DIRECT_V2"  # the ids: integer run lengths
        ids = spark.read.orc(f).agg({"doc_id": "min"}).first()[0], spark.read.orc(f).agg({"doc_id": "max"}).first()[0]
        ranges.append(ids)
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert scanned(token_orc.ids_of(spark, path, [20_000])) <= 1000  # one row group of one file
    assert scanned(token_orc.ids_of(spark, path, [20_001])) == 0  # within its ranges, but not in the Bloom filter
    assert scanned(spark.read.orc(path).select("n_tokens")) == 20_000


def test_one_id_lies_in_several_files(spark, tmp_path, many_files):
    path = str(tmp_path / "t")
    token_orc.write(spark.range(3000).selectExpr("7L AS doc_id", "'same text' AS text").repartition(4), path)
    sizes = [r["count"] for r in spark.read.orc(path).groupBy("part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2000
    starts = sorted(r.start for r in token_orc.read(spark, path).collect())
    assert starts == list(range(0, 3000 * 3, 3))
