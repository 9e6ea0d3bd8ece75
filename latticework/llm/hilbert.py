"""Sharding along a Hilbert curve, with DataFrame expressions only.

Several metadata columns are quantised to ``bits`` bits each by their own quantiles, the cell of a
row gives its index on the curve, rows are sorted by it and the sorted run is cut into shards of
equal row counts (at most one apart). Neighbours on the curve are neighbours in every dimension, so
each shard, and each row group of its file, spans narrow ranges in all of them.

Quantiles of strings are of whole strings, however long a prefix they share. Texts that are only
carried are written as they are, whole.

Ties on the curve are broken by the key, so a value that a third of the rows share spreads over as
many range partitions as its rows need. Nulls take the lowest cell of their dimension. Rows that
are equal in everything keep an arbitrary but single order, as the order is written down once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, own_name

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: rows of a partition count in the low 33 bits


def curve_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates (0 to 2**bits - 1 each)."""
    n = len(cells)
    full = (1 << n) - 1
    gray = lambda x: x ^ (x >> 1)
    ones = lambda x: ((x ^ (x + 1)).bit_length() - 1) % n  # noqa: E731  trailing set bits
    entry = F.array(*[F.lit(0 if w == 0 else gray((w - 1) // 2 * 2)) for w in range(full + 1)])
    turn = F.array(*[F.lit(0 if w == 0 else ones(w if w % 2 else w - 1)) for w in range(full + 1)])
    right = lambda x, by: F.call_function("shiftright", x, by)
    left = lambda x, by: F.call_function("shiftleft", x, by)

    def level(state: Column, i: Column) -> Column:
        corner = reduce(Column.bitwiseOR, [left(right(c, i).bitwiseAND(F.lit(1)), F.lit(j)) for j, c in enumerate(cells)])
        by = state["d"] + 1
        flipped = corner.bitwiseXOR(state["e"])
        turned = right(flipped, by).bitwiseOR(left(flipped, F.lit(n) - by)).bitwiseAND(F.lit(full))
        # a struct of one field names the value, so that it is computed once
        w = F.aggregate(F.array(*[F.lit(1 << k) for k in range(n.bit_length())]), turned, lambda x, k: x.bitwiseXOR(right(x, k)))
        return F.struct(state["e"].alias("e"), state["d"].alias("d"), state["h"].alias("h"), w.alias("w"))

    def move(state: Column) -> Column:
        by = state["d"] + 1
        at = F.element_at(entry, state["w"] + 1)
        back = left(at, by).bitwiseOR(right(at, F.lit(n) - by)).bitwiseAND(F.lit(full))
        return F.struct(
            state["e"].bitwiseXOR(back).alias("e"),
            F.pmod(state["d"] + F.element_at(turn, state["w"] + 1) + 1, F.lit(n)).cast("int").alias("d"),
            left(state["h"], F.lit(n)).bitwiseOR(state["w"].cast("bigint")).alias("h"),
            state["w"].alias("w"),
        )

    # two steps a level: even ones find the sub-cell's rank, odd ones turn the frame
    begin = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("w"))
    steps = F.array(*[F.lit(k) for k in range(2 * bits)])
    walk = lambda s, k: F.when(k % 2 == 0, level(s, (F.lit(bits - 1) - right(k, F.lit(1))))).otherwise(move(s))
    return F.aggregate(steps, begin, walk)["h"]


def as_ordered(df: DataFrame, name: str) -> Column:
    """The column in a type whose order counts: numbers and times as doubles, else the whole string."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_timestamp(c.cast("timestamp")).cast("double")
    return c.cast("string")


def boundaries(df: DataFrame, dims: dict[str, Column], bits: int) -> dict[str, list]:
    """Quantile boundaries by dimension, from all rows: fewer than 2**bits values each."""
    slim = df.select(*[c.alias(f"d{i}") for i, c in enumerate(dims.values())])
    texts = [f.name for f in slim.schema if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in slim.schema if f.name not in texts]
    shares = F.array(*[F.lit(k / (1 << bits)) for k in range(1, 1 << bits)])
    found = dict.fromkeys(numbers)
    if numbers:
        found = slim.agg(*[F.percentile_approx(n, shares, F.lit(10_000)).alias(n) for n in numbers]).first().asDict()
    found |= {n: text_boundaries(slim, n, 1 << bits) for n in texts}
    return {name: sorted(set(found[f"d{i}"] or [])) for i, name in enumerate(dims)}


def text_boundaries(df: DataFrame, name: str, parts: int) -> list[str]:
    """The last string of each of ``parts`` equal runs of the sorted rows but the last, from whole
    strings: distinct values with their counts are ranged and summed up, range by range."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).repartitionByRange(name).sortWithinPartitions(name)
    counts = materialise(counts.select(name, "n", F.spark_partition_id().alias("part")), "values")
    sums = counts.groupBy("part").agg(F.sum("n").alias("of"))
    base = sums.select(F.col("part").alias("at"), (F.sum("of").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"), F.sum("of").over(W.partitionBy()).alias("total"))
    within = F.sum("n").over(W.partitionBy("part").orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow))
    # one row a range, as many as partitions
    placed = counts.withColumn("upto", within).join(F.broadcast(base), F.col("part") == F.col("at")).withColumn("upto", F.col("upto") + F.coalesce("before", F.lit(0)))
    runs = placed.groupBy(F.floor((F.col("upto") - 1) * parts / F.col("total")).alias("run")).agg(F.max(name).alias("last"))
    return [r["last"] for r in runs.orderBy("run").collect()][:-1]  # ``parts`` rows at most


def cell(value: Column, cuts: list) -> Column:
    """How many boundaries lie below the value; null counts as lowest."""
    return F.coalesce(reduce(Column.__add__, [(value > F.lit(x)).cast("int") for x in cuts], F.lit(0)), F.lit(0))


def shard(df: DataFrame, dims: list[str], *, shards: int = 8, bits: int = 5, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of ``df`` if None) with ``curve`` long, ``shard`` int and ``slot``
    long, gapless from 0 in each shard. Shards differ by one row at most; fewer rows than shards
    leave shards empty. Columns of ``df`` named like these three are replaced."""
    carry = [c for c in (carry or df.columns) if c.lower() not in ("curve", "shard", "slot")]
    values = {d: as_ordered(df, d) for d in dims}
    cuts = boundaries(df, values, bits)
    index = curve_index([cell(values[d], cuts[d]) for d in dims], bits)
    part, at = own_name(df, "_part"), own_name(df, "_at")
    order = [F.col("curve"), *[F.col(c) for c in dict.fromkeys([key, *carry]) if isinstance(df.schema[c].dataType, T.AtomicType)][:4]]
    rows = df.select(*[F.col(c) for c in dict.fromkeys([*carry, key])], index.alias("curve"))
    rows = materialise(rows, "curve")  # ranging reads its rows twice; the curve is computed once
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias(at))
    rows = materialise(rows, "hilbert")  # ranks hold only if the order is made once
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy(part).count().select(F.col(part).alias("of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    total = rows.count()
    each, over = divmod(total, shards)
    rank = F.col("base") + F.col(at)
    # the first ``over`` shards hold one row more; ``base`` has one row a partition, which bounds it
    wide = F.lit(over * (each + 1))
    out = rows.join(F.broadcast(base), F.col(part) == F.col("of")).withColumn(at, rank)
    long = F.col(at) < wide
    number = F.when(long, F.floor(F.col(at) / (each + 1))).otherwise(F.lit(over) + F.floor((F.col(at) - wide) / max(each, 1)))
    slot = F.when(long, F.pmod(F.col(at), F.lit(each + 1))).otherwise(F.pmod(F.col(at) - wide, F.lit(max(each, 1))))
    return out.select(*carry, "curve", number.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def write(df: DataFrame, path: str, dims: list[str], **how) -> None:
    """Write the shards as Parquet, a folder each, sorted along the curve, so that readers prune
    files and row groups by ranges of any dimension."""
    out = shard(df, dims, **how)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, dims: list[str], *, shards: int = 8, bits: int = 5) -> DataFrame:
    """Where every document goes: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the text's UTF-8 bytes (null: none) plus 1; the law is ``rows``. A shard more moves all
    cuts, so ``grown_shard`` is null."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    slim = docs.select("doc_id", *[d for d in dims if d != "doc_id"], (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(slim, dims, shards=shards, bits=bits, carry=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
