"""Star Schema Benchmark: schemas of the generator's files, star to snowflake, and the cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CubeModel, ForeignKey
from ..plans.infer import infer_model
from ..session import Cube
from ..sources.tables import FrameSource, TableSource, delimited

# Columns of the generator's files.
STAR = {
    "part": "p_partkey INT, p_name STRING, p_mfgr STRING, p_category STRING, p_brand1 STRING, p_color STRING, p_type STRING, p_size SMALLINT, p_container STRING",
    "supplier": "s_suppkey INT, s_name STRING, s_address STRING, s_city STRING, s_nation STRING, s_region STRING, s_phone STRING",
    "customer": "c_custkey INT, c_name STRING, c_address STRING, c_city STRING, c_nation STRING, c_region STRING, c_phone STRING, c_mktsegment STRING",
    "date": "d_datekey INT, d_date STRING, d_dayofweek STRING, d_month STRING, d_year SMALLINT, d_yearmonthnum INT, d_yearmonth STRING, d_daynuminweek SMALLINT, d_daynuminmonth SMALLINT, d_daynuminyear SMALLINT, d_monthnuminyear SMALLINT, d_weeknuminyear SMALLINT, d_sellingseason STRING, d_lastdayinweekfl STRING, d_lastdayinmonthfl STRING, d_holidayfl STRING, d_weekdayfl STRING",
    "lineorder": "lo_orderkey INT, lo_linenumber SMALLINT, lo_custkey INT, lo_partkey INT, lo_suppkey INT, lo_orderdate INT, lo_orderpriority STRING, lo_shippriority STRING, lo_quantity SMALLINT, lo_extendedprice INT, lo_ordtotalprice INT, lo_discount SMALLINT, lo_revenue INT, lo_supplycost INT, lo_tax SMALLINT, lo_commitdate INT, lo_shipmode STRING",
}

KEYS = [
    ForeignKey("lineorder", "lo_custkey", "customer", "c_custkey"), ForeignKey("lineorder", "lo_partkey", "part", "p_partkey"),
    ForeignKey("lineorder", "lo_suppkey", "supplier", "s_suppkey"), ForeignKey("lineorder", "lo_orderdate", "date", "d_datekey"),
    ForeignKey("lineorder", "lo_commitdate", "date", "d_datekey"), ForeignKey("customer", "c_citykey", "city", "ci_citykey"),
    ForeignKey("supplier", "s_citykey", "city", "ci_citykey"), ForeignKey("city", "ci_nationkey", "nation", "n_nationkey"),
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("part", "p_brand1key", "brand1", "b_brand1key"),
    ForeignKey("brand1", "b_categorykey", "category", "ca_categorykey"), ForeignKey("category", "ca_mfgrkey", "mfgr", "m_mfgrkey"),
    ForeignKey("date", "d_monthkey", "month", "mo_monthkey"), ForeignKey("month", "mo_yearkey", "year", "y_yearkey"),
]

LABELS = {"supplier": "s_name", "customer": "c_name", "part": "p_name", "date": "d_daynuminmonth", "month": "mo_month"}


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct rows with a surrogate key from 1, in the order of ``order``. Level tables are small:
    one row a member."""
    return rows.distinct().withColumn(key, F.row_number().over(W.orderBy(*order)).cast("int"))


def star_of(files: TableSource) -> dict[str, DataFrame]:
    """The benchmark's star from TPC-H-like tables: brands lie in categories and manufacturers, each
    nation has four cities, dates are numbers like 19970131, and amounts are whole."""
    t = files.table
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    empty = F.lit("")
    b = F.substring("p_brand", 7, 9).cast("int")
    mfgr = F.concat(F.lit("MFGR#"), (F.floor((b - 1) / 10) + 1).cast("string"))
    category = F.concat(mfgr, (F.floor((b - 1) / 5) % 2 + 1).cast("string"))
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int")

    def party(table: str, p: str, key: str, last: list) -> DataFrame:
        rows = t(table).join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        city = F.concat("n_name", F.lit(" "), (F.col(key) % 4).cast("string"))
        return rows.select(F.col(key).cast("int").alias(key), f"{p}_name", empty.alias(f"{p}_address"), city.alias(f"{p}_city"), F.col("n_name").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"), empty.alias(f"{p}_phone"), *last)

    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = F.col("d")
    days = sold.select(F.to_date("o_orderdate").alias("d")).union(sold.select(F.to_date("l_shipdate"))).distinct()
    price = F.round("l_extendedprice").cast("int")
    return {
        "part": t("part").select(F.col("p_partkey").cast("int"), "p_name", mfgr.alias("p_mfgr"), category.alias("p_category"), F.concat(category, F.lit("-"), F.lpad(b.cast("string"), 2, "0")).alias("p_brand1"), empty.alias("p_color"), "p_type", F.col("p_size").cast("smallint"), empty.alias("p_container")),
        "supplier": party("supplier", "s", "s_suppkey", []),
        "customer": party("customer", "c", "c_custkey", [F.col("c_mktsegment")]),
        "date": days.select(day(d).alias("d_datekey"), F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "EEEE"), F.date_format(d, "MMMM"), F.year(d), F.year(d) * 100 + F.month(d), F.date_format(d, "MMMyyyy"), F.dayofweek(d), F.dayofmonth(d), F.dayofyear(d), F.month(d), F.weekofyear(d), empty, *[F.lit("0")] * 4),
        "lineorder": sold.select(F.col("l_orderkey").cast("int"), F.col("l_linenumber").cast("smallint"), F.col("o_custkey").cast("int"), F.col("l_partkey").cast("int"), F.col("l_suppkey").cast("int"), day("o_orderdate"), "o_orderpriority", empty, F.col("l_quantity").cast("smallint"), price, F.round("o_totalprice").cast("int"), F.round(F.col("l_discount") * 100).cast("smallint"), price, F.round(F.col("l_extendedprice") * 0.6).cast("int"), F.round(F.col("l_tax") * 100).cast("smallint"), day("l_shipdate"), empty),
    }


def write_star(star: dict[str, DataFrame], path: str, *, suffix: str = ".tbl") -> None:
    """As the generator writes it: delimited by bars, columns in order, no header."""
    for name, df in star.items():
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.option("sep", "|").csv(f"{path}/{name}{suffix}")


def read_star(spark: SparkSession, path: str, *, suffix: str = ".tbl") -> dict[str, DataFrame]:
    source = delimited(spark, path, STAR, suffix=suffix, trim=True)
    return {t: source.table(t) for t in STAR}


def snowflake(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Level tables with surrogate keys, and dimension tables that refer to them."""
    part, supplier, customer, date = (star[t] for t in ("part", "supplier", "customer", "date"))
    places = customer.select(F.col("c_city").alias("ci_city"), F.col("c_nation").alias("n_nation"), F.col("c_region").alias("r_region")).unionByName(supplier.select(F.col("s_city").alias("ci_city"), F.col("s_nation").alias("n_nation"), F.col("s_region").alias("r_region")))
    out: dict[str, DataFrame] = {}
    out["region"] = numbered(places.select("r_region"), "r_regionkey", ["r_region"]).select("r_regionkey", "r_region")
    nation = places.select("n_nation", "r_region").distinct().join(out["region"], "r_region").withColumnRenamed("r_regionkey", "n_regionkey")
    out["nation"] = numbered(nation.select("n_nation", "n_regionkey"), "n_nationkey", ["n_nation", "n_regionkey"]).select("n_nationkey", "n_nation", "n_regionkey")
    city = places.select("ci_city", "n_nation").distinct().join(out["nation"], "n_nation").withColumnRenamed("n_nationkey", "ci_nationkey")
    out["city"] = numbered(city.select("ci_city", "ci_nationkey"), "ci_citykey", ["ci_city", "ci_nationkey"]).select("ci_citykey", "ci_city", "ci_nationkey")
    out["mfgr"] = numbered(part.select(F.col("p_mfgr").alias("m_mfgr")), "m_mfgrkey", ["m_mfgr"]).select("m_mfgrkey", "m_mfgr")
    category = part.select(F.col("p_category").alias("ca_category"), F.col("p_mfgr").alias("m_mfgr")).distinct().join(out["mfgr"], "m_mfgr").withColumnRenamed("m_mfgrkey", "ca_mfgrkey")
    out["category"] = numbered(category.select("ca_category", "ca_mfgrkey"), "ca_categorykey", ["ca_category"]).select("ca_categorykey", "ca_category", "ca_mfgrkey")
    brand = part.select(F.col("p_brand1").alias("b_brand1"), F.col("p_category").alias("ca_category")).distinct().join(out["category"], "ca_category").withColumnRenamed("ca_categorykey", "b_categorykey")
    out["brand1"] = numbered(brand.select("b_brand1", "b_categorykey"), "b_brand1key", ["b_brand1"]).select("b_brand1key", "b_brand1", "b_categorykey")
    out["year"] = numbered(date.select(F.col("d_year").alias("y_year")), "y_yearkey", ["y_year"]).select("y_yearkey", "y_year")
    month = date.select(F.col("d_month").alias("mo_month"), F.col("d_yearmonthnum").alias("mo_yearmonthnum"), F.col("d_yearmonth").alias("mo_yearmonth"), F.col("d_monthnuminyear").alias("mo_monthnuminyear"), F.col("d_year").alias("y_year")).distinct().join(out["year"], "y_year").withColumnRenamed("y_yearkey", "mo_yearkey")
    out["month"] = numbered(month.drop("y_year"), "mo_monthkey", ["mo_yearmonthnum"]).select("mo_monthkey", "mo_month", "mo_yearmonthnum", "mo_yearmonth", "mo_monthnuminyear", "mo_yearkey")

    def placed(df: DataFrame, p: str) -> DataFrame:
        keys = out["city"].join(out["nation"].withColumnRenamed("n_nationkey", "ci_nationkey"), "ci_nationkey").select("ci_city", "n_nation", F.col("ci_citykey").alias(f"{p}_citykey"))
        joined = df.join(keys, (F.col(f"{p}_city") == F.col("ci_city")) & (F.col(f"{p}_nation") == F.col("n_nation")))
        return joined.drop("ci_city", "n_nation", f"{p}_city", f"{p}_nation", f"{p}_region")

    out["supplier"], out["customer"] = placed(supplier, "s"), placed(customer, "c")
    brands = out["brand1"].select(F.col("b_brand1").alias("p_brand1"), F.col("b_brand1key").alias("p_brand1key"))
    out["part"] = part.join(brands, "p_brand1").drop("p_brand1", "p_category", "p_mfgr")
    months = out["month"].select(F.col("mo_yearmonthnum").alias("d_yearmonthnum"), F.col("mo_monthkey").alias("d_monthkey"))
    flags = {c: F.col(c).cast("boolean") for c in ("d_lastdayinweekfl", "d_lastdayinmonthfl", "d_holidayfl", "d_weekdayfl")}
    out["date"] = date.join(months, "d_yearmonthnum").withColumns(flags).select("d_datekey", "d_dayofweek", "d_daynuminweek", "d_daynuminmonth", "d_daynuminyear", "d_sellingseason", *flags, "d_monthkey")
    out["lineorder"] = star["lineorder"]
    return out


def ssb_cube(spark: SparkSession, tables: dict[str, DataFrame], *, name: str = "ssb") -> Cube:
    """The cube over the snowflake tables: ``date1`` is the order's date, ``date`` the commitment's."""
    source = FrameSource(spark, tables)
    model: CubeModel = infer_model(source, name=name, tables=sorted(tables), keys=KEYS, fact="lineorder", labels=LABELS, exclude=("lo_orderkey", "lo_linenumber"))
    return Cube(model, source)
