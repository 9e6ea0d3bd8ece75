"""Cubes over the TPC-H-like tables: sales lines with their orders, and events."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import CubeModel, Dimension, Level, StoredMeasure
from ..session import Cube
from ..sources.prepared import prepare
from ..sources.tables import FrameSource, parquet


def calendar(name: str, column: str) -> Dimension:
    """Days, months and years computed from a timestamp column: no table, no join."""
    day, year = "CAST({fk} AS DATE)", "year({fk})"
    month = "year({fk}) * 100 + month({fk})"
    return Dimension(name, column, (
        Level("day", "date", "date", ("day_of_month", "day_of_year"), columns=(("date", day), ("day_of_month", "dayofmonth({fk})"), ("day_of_year", "dayofyear({fk})"))),
        Level("month", "year_month", "month_name", ("month_number", "year_month"), columns=(("year_month", month), ("month_name", "date_format({fk}, 'MMMM')"), ("month_number", "month({fk})")), spans=(("year_month", "year_month"),)),
        Level("year", "year", "year", columns=(("year", year),), spans=(("year", "year"),)),
    ))


def geography(role: str, fk: str, prefix: str, table: str) -> Dimension:
    """A party, its nation and its region; the tables of both are shared between roles."""
    return Dimension(role, fk, (
        Level(table, f"{prefix}_{'custkey' if prefix == 'c' else 'suppkey'}", f"{prefix}_name", (f"{prefix}_acctbal",), table, f"{prefix}_nationkey"),
        Level("nation", "n_nationkey", "n_name", (), "nation", "n_regionkey"),
        Level("region", "r_regionkey", "r_name", (), "region"),
    ))


SALES = CubeModel(
    "sales",
    "sales",
    (
        geography("customer", "o_custkey", "c", "customer"),
        geography("supplier", "l_suppkey", "s", "supplier"),
        Dimension("part", "l_partkey", (Level("part", "p_partkey", "p_name", ("p_size", "p_retailprice"), "part"), Level("brand", "p_brand", "p_brand"))),
        Dimension("part_type", "l_partkey", (Level("part", "p_partkey", "p_name", (), "part"), Level("type", "p_type", "p_type"))),
        calendar("order_date", "o_orderdate"),
        calendar("ship_date", "l_shipdate"),
    ),
    tuple(StoredMeasure(m, f"l_{m}") for m in ("quantity", "extendedprice", "discount", "tax")),
    # the keys of these tables are sound, so hierarchies are joined as far as a query needs
    hierarchy_join="needed",
)

EVENTS = CubeModel(
    "events",
    "events",
    (calendar("time", "ts"), Dimension("kind", "event_type", (Level("kind", "event_type", "event_type", columns=(("event_type", "{fk}"),)),))),
    (StoredMeasure("value", "value"),),
)


def sales_cube(spark: SparkSession, path: str, *, prepared: str | None = None) -> Cube:
    """Lines joined with their orders as the fact; the join is skipped where nothing of the order
    is used, as the orders' keys are sound. With a folder ``prepared`` the fact is written there
    once, with its orders and levels and in ranges of the order date, which also checks all keys."""
    files = parquet(spark, path)
    lines, orders = files.table("lineitem"), files.table("orders")
    tables = {t: files.table(t) for t in ("customer", "supplier", "part", "nation", "region")}
    cube = Cube(SALES, _SalesSource(spark, lines, orders, tables))
    return prepare(cube, prepared, sort_by="o_orderdate", rows=files.count("lineitem")) if prepared else cube


class _SalesSource(FrameSource):
    def __init__(self, spark, lines, orders, tables) -> None:
        fact = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        super().__init__(spark, {"sales": fact, "lines": lines, **tables})

    def fact_for(self, columns: set[str]):
        """The lines alone where they have all the columns."""
        lines = self.frames["lines"]
        return lines if columns <= set(lines.columns) else self.frames["sales"]


def events_cube(spark: SparkSession, path: str) -> Cube:
    return Cube(EVENTS, parquet(spark, path))
