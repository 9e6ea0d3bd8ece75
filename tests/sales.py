"""The sales snowflake of the fixtures: 25 fact rows that give the golden values."""

from latticework import Cube, CubeModel, Dimension, Level, StoredMeasure
from latticework.model import ForeignKey
from latticework.sources.tables import FrameSource

MONTHS = "January February March April May June July August September October November December".split()
PRICE = {2021: [14971, 14078, 13096, 12210, 17347, 14928, 16620, 15645, 14497, 16609, 13732, 12604], 2022: [16654, 13420, 18942, 14512, 15614, 17445, 16470, 13669, 14342, 16351, 16706, 16445]}
UNITS = {2021: [291, 286, 285, 277, 310, 349, 292, 257, 266, 289, 274, 322], 2022: [300, 259, 329, 314, 262, 261, 381, 360, 300, 303, 299, 299]}

KEYS = [
    ForeignKey("sales", "supplier", "supplier_name", "name_id"), ForeignKey("sales", "store", "store_address", "address_id"),
    ForeignKey("sales", "product", "product_name", "name_id"), ForeignKey("sales", "sale_date", "date_day", "day_id"),
    ForeignKey("date_day", "month_id", "date_month", "month_id"), ForeignKey("date_month", "year_id", "date_year", "year_id"),
    ForeignKey("product_name", "category_id", "product_category", "category_id"),
    ForeignKey("store_address", "city_id", "store_city", "city_id"), ForeignKey("store_city", "county_id", "store_county", "county_id"),
    ForeignKey("supplier_name", "nation_id", "supplier_nation", "nation_id"), ForeignKey("supplier_nation", "continent_id", "supplier_continent", "continent_id"),
]
ROLES = {"supplier": "supplier", "store": "store", "product": "product", "sale_date": "date"}


def tables(spark, extra=()):
    sales = []
    for y, year in enumerate((2021, 2022)):
        for m in range(12):
            day = y * 12 + m + 1
            if (year, m) == (2022, 0):
                sales += [(1, 2, 1, day, 13981.0, 273), (1, 1, 1, day, 2673.0, 27)]
            else:
                sales.append((1, 2, 1, day, float(PRICE[year][m]), UNITS[year][m]))
    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    return {
        "sales": make([*sales, *extra], "supplier long, store long, product long, sale_date long, total_sales_price double, unit_sales long"),
        "date_day": make([(i, 1, i) for i in range(1, 25)], "day_id long, day int, month_id long"),
        "date_month": make([(i, MONTHS[(i - 1) % 12], 1 + (i - 1) // 12) for i in range(1, 25)], "month_id long, month string, year_id long"),
        "date_year": make([(1, 2021), (2, 2022)], "year_id long, year int"),
        "product_name": make([(1, "Basic", 1), (2, "Kid's", 2)], "name_id long, name string, category_id long"),
        "product_category": make([(1, "Blouse"), (2, "Shirt ")], "category_id long, category string"),
        "store_address": make([(1, "Jyllandsgade 1", 1), (2, "Jyllandsgade 2", 1)], "address_id long, address string, city_id long"),
        "store_city": make([(1, "Town", 1)], "city_id long, city string, county_id long"),
        "store_county": make([(1, "North")], "county_id long, county string"),
        "supplier_name": make([(1, "POMPdeLUX", 1), (2, "Other", 2)], "name_id long, name string, nation_id long"),
        "supplier_nation": make([(1, "Denmark", 1), (2, "Sweden", 1)], "nation_id long, nation string, continent_id long"),
        "supplier_continent": make([(1, "Europe")], "continent_id long, continent string"),
    }


def model(join="full"):
    lv = lambda table, key, label, up=None: Level(table, key, label, (), table, up)
    return CubeModel("sales", "sales", (
        Dimension("supplier", "supplier", (lv("supplier_name", "name_id", "name", "nation_id"), lv("supplier_nation", "nation_id", "nation", "continent_id"), lv("supplier_continent", "continent_id", "continent"))),
        Dimension("store", "store", (lv("store_address", "address_id", "address", "city_id"), lv("store_city", "city_id", "city", "county_id"), lv("store_county", "county_id", "county"))),
        Dimension("product", "product", (lv("product_name", "name_id", "name", "category_id"), lv("product_category", "category_id", "category"))),
        Dimension("date", "sale_date", (lv("date_day", "day_id", "day", "month_id"), lv("date_month", "month_id", "month", "year_id"), lv("date_year", "year_id", "year"))),
    ), (StoredMeasure("total_sales_price", "total_sales_price"), StoredMeasure("unit_sales", "unit_sales")), join)


def cube(spark, extra=(), join="full", **how):
    return Cube(model(join), FrameSource(spark, tables(spark, extra), **how))
