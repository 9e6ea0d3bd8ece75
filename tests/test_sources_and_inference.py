"""Sources, inference by name, the SSB conversion and the generator."""

import pytest
from pyspark.sql import functions as F

from latticework import Cube, CubeSession, ModelError
from latticework.datasets import generator, ssb
from latticework.model import ForeignKey
from latticework.plans.infer import candidate_keys, edit_distance, fact_table, infer_model, label_of, role_names, stem, verified
from latticework.sources.tables import CatalogSource, FileSource, FrameSource, JdbcSource, delimited, parquet, postgres

from .sales import KEYS, tables


def test_small_rules():
    assert edit_distance("kitten", "sitting") == 3 and edit_distance("", "ab") == 2 and edit_distance("a", "a") == 0
    assert label_of(["s_name", "s_address", "s_phone"], "supplier") == "s_phone"  # why labels can be declared
    assert role_names(["date", "part", "date", "date"]) == ["date1", "part", "date2", "date"]
    assert fact_table({"a": 3, "b": 9, "c": 9}) == "b" and stem("c_custkey") == "cust" and stem("nation_id") == "nation"
    with pytest.raises(ModelError):
        fact_table({})


def test_keys_are_found_by_name_and_checked(spark):
    source = parquet(spark, "/root/testdata/sf0.001")
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    found = {(k.table, k.column, k.to_table) for k in verified(source, candidate_keys(source, names))}
    assert {("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("supplier", "s_nationkey", "nation"), ("customer", "c_nationkey", "nation"), ("nation", "n_regionkey", "region"), ("orders", "o_custkey", "customer")} <= found
    assert ("nation", "n_regionkey", "nation") not in found and not any(b == "l_linenumber" for _, b, _ in found)
    assert set(names) <= set(source.names()) and source.count("region") == 5
    bad = FrameSource(spark, {"f": spark.createDataFrame([(1,), (9,)], "d_id long"), "d": spark.createDataFrame([(1, "x")], "d_id long, d string"), "e": spark.createDataFrame([(1, "x"), (1, "y")], "d_id long, e string")})
    assert verified(bad, [ForeignKey("f", "d_id", "d", "d_id"), ForeignKey("f", "d_id", "e", "d_id")]) == []


def test_a_cube_of_the_files_without_declared_keys(spark):
    source = parquet(spark, "/root/testdata/sf0.001")
    session = CubeSession.infer(spark, source, name="lines", tables=["region", "nation", "supplier", "part", "lineitem"], exclude=["l_orderkey", "l_linenumber"])
    c = session.cube("lines")
    assert c.dimensions() == ["part", "supplier"] and c["supplier"].hierarchies() == ["supplier", "nation", "region", "ALL"]
    assert c.measures() == ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    got = c.view().columns(c.supplier.region["r_name"].members()).measures("l_quantity").to_df().agg(F.sum("l_quantity")).first()[0]
    assert got == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]


def test_inference_errors(spark):
    t = tables(spark)
    source = FrameSource(spark, t)
    with pytest.raises(ModelError, match="no table"):
        infer_model(source, keys=KEYS, fact="nothing")
    with pytest.raises(ModelError, match="refers to no other"):
        infer_model(source, keys=[])
    with pytest.raises(ModelError, match="linear"):
        infer_model(source, keys=[*KEYS, ForeignKey("date_month", "month_id", "store_city", "city_id")])
    with pytest.raises(ModelError, match="circle"):
        infer_model(source, keys=[*KEYS, ForeignKey("date_year", "year_id", "date_day", "day_id")])
    with pytest.raises(ModelError, match="besides its keys"):
        infer_model(FrameSource(spark, {**t, "store_county": t["store_county"].select("county_id")}), keys=KEYS)
    with pytest.raises(ModelError, match="label"):
        infer_model(source, keys=KEYS, labels={"store_city": "nothing"})


def test_delimited_catalog_and_jdbc(spark, tmp_path):
    spark.createDataFrame([(1, "ASIA   "), (2, "O'Brien")], "k int, name string").coalesce(1).write.option("sep", "|").option("ignoreTrailingWhiteSpace", "false").csv(str(tmp_path / "region.tbl"))
    files = delimited(spark, str(tmp_path), {"region": "k INT, name STRING"}, trim=True)
    assert files.names() == ["region"] and sorted(r.name for r in files.table("region").collect()) == ["ASIA", "O'Brien"]
    assert FileSource(spark, str(tmp_path), format="csv", suffix=".tbl", options={"sep": "|"}).count("region") == 2
    spark.range(3).write.mode("overwrite").saveAsTable("latticework_three")
    try:
        source = CatalogSource(spark)
        assert "latticework_three" in source.names() and source.count("latticework_three") == 3
    finally:
        spark.sql("DROP TABLE latticework_three")
    db = postgres(spark, "db", "me", "secret", "host", 5432, ["a"])
    assert isinstance(db, JdbcSource) and db.url == "jdbc:postgresql://host:5432/db" and db.names() == ["a"]


def test_generated_snowflake(spark, tmp_path):
    made, keys = generator.generate(spark, [(2, 3), (3, 2)], measures=2)
    assert made["fact_table"].count() == 9 * 8 and made["dimension1_level2"].count() == 8
    assert made["fact_table"].select("dimension0_id", "dimension1_id").distinct().count() == 72
    generator.write(made, str(tmp_path / "g"))
    source = parquet(spark, str(tmp_path / "g"))
    c = Cube(infer_model(source, keys=keys), source)
    assert c.dimensions() == ["dimension0_level1", "dimension1_level2"] and c.measures() == ["measure0", "measure1"]
    out = c.view().columns(c.dimension1_level2.dimension1_level1["level1"].members()).measures("measure0").output()
    assert out.shape == (1, 4) and out.to_numpy().sum() == 72 * 73 / 2  # labels repeat under each parent
    generator.drop_all(spark, str(tmp_path / "g"))
    assert not (tmp_path / "g").exists()


def star(spark):
    row = {
        "part": [(1, "p1", "MFGR#1", "MFGR#12", "MFGR#121", "red", "t", 1, "c"), (2, "p2", "MFGR#2", "MFGR#22", "MFGR#221", "red", "t", 1, "c")],
        "supplier": [(1, "s1", "a", "CITY1", "PERU", "AMERICA", "1"), (2, "s2", "a", "CITY2", "CHINA", "ASIA", "2")],
        "customer": [(1, "c1", "a", "CITY1", "PERU", "AMERICA", "1", "m"), (2, "c2", "a", "CITY3", "PERU", "AMERICA", "2", "m")],
        "date": [(19970101, "d", "Monday", "January", 1997, 199701, "Jan1997", 1, 1, 1, 1, 1, "w", "0", "0", "1", "1"), (19980201, "d", "Sunday", "February", 1998, 199802, "Feb1998", 1, 1, 32, 2, 5, "w", "1", "0", "0", "0")],
        "lineorder": [(1, 1, 1, 1, 1, 19970101, "1", "0", 10, 100, 100, 5, 95, 60, 1, 19980201, "AIR"), (1, 2, 2, 2, 2, 19980201, "1", "0", 20, 200, 300, 5, 190, 90, 1, 19980201, "AIR"), (2, 1, 2, 1, 1, 19980201, "1", "0", 30, 300, 300, 5, 285, 90, 1, 19970101, "AIR")],
    }
    return {t: spark.createDataFrame(rows, ssb.STAR[t]) for t, rows in row.items()}


def test_star_to_snowflake(spark):
    flake = ssb.snowflake(star(spark))
    assert sorted(r.n_nation for r in flake["nation"].collect()) == ["CHINA", "PERU"] and flake["city"].count() == 3
    assert flake["lineorder"].count() == 3 and flake["date"].schema["d_holidayfl"].dataType.typeName() == "boolean"
    c = ssb.ssb_cube(spark, flake)
    assert c.dimensions() == ["customer", "part", "supplier", "date1", "date"]
    assert c.measures() == ["lo_quantity", "lo_extendedprice", "lo_ordtotalprice", "lo_discount", "lo_revenue", "lo_supplycost", "lo_tax"]
    view = c.view().columns(c.date1.year.members()).rows(c.customer.nation.members()).where((c.customer.region["r_region"] == "AMERICA") & (c.supplier.region["r_region"] == "AMERICA")).measures(profit=c.lo_revenue - c.lo_supplycost)
    assert sorted(map(tuple, view.to_df().collect())) == [(1997, "PERU", 35), (1998, "PERU", 195)]
    roles = c.view().columns(c.date1.year.members()).rows(c.date.year.members()).measures("lo_quantity")
    assert sorted(map(tuple, roles.to_df().collect())) == [(1997, 1998, 10), (1998, 1997, 30), (1998, 1998, 20)]
    assert c.view().where(c.date1.date["d_holidayfl"] == True).measures("lo_quantity").to_df().first()[0] == 10  # noqa: E712
