"""Token ids in ORC: one row a document, ids as an integer list that ORC run-length encodes.

Files are range-partitioned and sorted by document id, so stripe and row-group statistics are
narrow; row indexes and a Bloom filter on the id let a reader skip stripes and row groups. Stripes
are what Spark splits files by, so one large file is read by many tasks.

Each row holds its place within its file; the start over all files is that plus the totals of the
files before, of which there are as many as partitions. Null texts count as empty and hold the end
id only. Rows with equal ids keep one order (by a hash of the text) and may lie in several files, so
one id with very many rows doesn't weigh on a task; null ids come first. Columns
other than ``key`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import library_encoder
from .common import column, field, map_batches, texts_of, tokenizer_file


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", stripe_mb: int = 64, row_index_stride: int = 1000, bloom_fpp: float = 0.01) -> None:
    """Encode every text, append ``end_id`` and write ``key, part, at, n_tokens, ids`` as ORC."""
    file = vocabulary or tokenizer_file("byte_bpe_50k.json")
    kind = docs.schema[key].dataType
    # ranges end within a repeated or null id too, by the text's hash and the row's place
    order = [key, f"{key}_{text}_order", f"{key}_{text}_row"]
    ordered = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias(order[1]), F.monotonically_increasing_id().alias(order[2]))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)
    end = np.array([end_id], "<i4").tobytes()

    def run(batches):
        encoder, at = library_encoder(file), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            ids = [x + end for x in encoder.encode(texts_of(b, text))]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield [column(b, key), pa.array(np.full(len(ids), part, np.int32)), pa.array(at + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)]
            at += int(ends[-1])

    schema = T.StructType([field(key, kind), field("part", "int"), field("at", "bigint"), field("n_tokens", "bigint"), field("ids", "array<int>")])
    out = map_batches(ordered, run, schema, limit=2 << 20, text=text)
    (
        out.write.option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.dictionary.key.threshold", "0")
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of the files with ``start``, the ids of all documents before, instead of ``at``.

    Filters on the id column reach the ORC reader (stripe statistics, row indexes, Bloom filter).
    """
    rows = spark.read.schema(schema).orc(path) if schema else spark.read.orc(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row a file, and a file for each partition of the write at most: that bounds the broadcast
    joined = rows.join(F.broadcast(starts), F.col("part") == F.col("of"))
    return joined.withColumn("start", F.col("base") + F.col("at")).drop("of", "base", "at", "part")


def ids_of(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """The rows of some documents; all other stripes and row groups are pruned by metadata."""
    return spark.read.orc(path).filter(F.col(key).isin(keys)).select(key, "n_tokens", "ids")


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32``: crc32 of the ids as little-endian unsigned 32-bit."""
    kind = rows.schema[key].dataType
    schema = T.StructType([field(key, kind), field("start", "bigint"), field("n_tokens", "bigint"), field("ids_crc32", "bigint")])

    def run(batches):
        for b in batches:
            lists = column(b, "ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            ends = np.concatenate([[0], np.cumsum(column(b, "n_tokens").to_numpy())])
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield [column(b, key), column(b, "start"), column(b, "n_tokens"), pa.array(crc, pa.int64())]

    return map_batches(rows.select(key, "start", "n_tokens", "ids"), run, schema, text=None)
