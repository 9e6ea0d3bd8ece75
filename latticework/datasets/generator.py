"""Synthetic snowflakes: dimensions of given depth and fan-out, and the full product as the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ForeignKey


def level_size(start: int, level: int) -> int:
    """Members of a level: every parent has ``start`` children."""
    return start ** (level + 1)


def generate(spark: SparkSession, shapes: list[tuple[int, int]], measures: int = 1) -> tuple[dict[str, DataFrame], list[ForeignKey]]:
    """Tables by name and their foreign keys. ``shapes``: (levels, members under each parent) of each
    dimension. Labels repeat under every parent; each measure is the fact row's number."""
    tables, keys = {}, []
    lowest = []
    for i, (levels, start) in enumerate(shapes):
        for j in range(levels):
            n = level_size(start, j)
            cols = [(F.col("id") + 1).alias(f"level{j}_id"), F.concat(F.lit("member"), (F.col("id") % start + 1).cast("string")).alias(f"level{j}")]
            if j:
                cols.append((F.floor(F.col("id") / start) + 1).cast("bigint").alias(f"level{j - 1}_id"))
                keys.append(ForeignKey(f"dimension{i}_level{j}", f"level{j - 1}_id", f"dimension{i}_level{j - 1}", f"level{j - 1}_id"))
            tables[f"dimension{i}_level{j}"] = spark.range(n).select(*cols)
        lowest.append(level_size(start, levels - 1))
        keys.append(ForeignKey("fact_table", f"dimension{i}_id", f"dimension{i}_level{levels - 1}", f"level{levels - 1}_id"))
    total = 1
    for n in lowest:
        total *= n
    cols, step = [], total
    for i, n in enumerate(lowest):
        step //= n
        cols.append((F.floor(F.col("id") / step) % n + 1).cast("bigint").alias(f"dimension{i}_id"))
    # mixed-radix digits of the row number are the full product, without a join
    tables["fact_table"] = spark.range(total).select(*cols, *[(F.col("id") + 1).cast("double").alias(f"measure{k}") for k in range(measures)])
    return tables, keys


def write(tables: dict[str, DataFrame], path: str, format: str = "parquet", **options: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).options(**options).save(f"{path}/{name}.{format}")


def drop_all(spark: SparkSession, path: str) -> None:
    """Remove a folder of tables, on any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
