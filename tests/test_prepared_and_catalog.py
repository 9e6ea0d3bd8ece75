"""Facts written with their levels, pruned scans, and keys from a database's catalog."""

from datetime import datetime

import pytest

from latticework import CubeSession, ModelError
from latticework.datasets.star import sales_cube
from latticework.model import ForeignKey
from latticework.plans.infer import infer_model
from latticework.plans.planner import spans
from latticework.queries import VIEWS
from latticework.sources.prepared import prepare
from latticework.sources.tables import FrameSource, JdbcSource

SF = "/root/testdata/sf0.001"


def pushed(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [x for x in df._jdf.queryExecution().explainString(mode).split("\n") if x.startswith(("PushedFilters", "ReadSchema"))]


def cells(df):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cubes(spark, tmp_path_factory):
    return sales_cube(spark, SF), sales_cube(spark, SF, prepared=str(tmp_path_factory.mktemp("p") / "fact"))


@pytest.mark.parametrize("name", ["q11", "q31", "q43", "five_axes_role_dates", "two_axes_lowest_level", "member_path", "column_comparison", "six_axes"])
def test_prepared_cubes_give_the_same_cells(cubes, name):
    plain, written = (cells(VIEWS[name][0](c).to_df()) for c in cubes)
    assert plain == written


def test_scans_are_pruned_and_prepared_cubes_do_not_join(cubes):
    plain, written = cubes
    for c in cubes:
        text = "\n".join(pushed(VIEWS["q11"][0](c).to_df()))
        assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00), LessThan(o_orderdate,1998-01-01T00:00)" in text
    wide = pushed(VIEWS["q31"][0](written).to_df())
    assert len(wide) == 2 and "EqualTo(customer__region__r_name,ASIA)" in wide[0] and "c_name" not in wide[1]
    assert len(pushed(VIEWS["two_axes_lowest_level"][0](written).to_df())) == 4  # a supplier's name is in its table


def test_spans_say_no_more_than_the_predicate(cubes):
    c = cubes[0]
    y, m = c.order_date.year["year"], c.order_date.month.year_month
    day = datetime
    assert spans(c, y == 1997) == [("o_orderdate", day(1997, 1, 1), day(1998, 1, 1))]
    assert spans(c, (y > 1996) & (m <= 199712)) == [("o_orderdate", day(1997, 1, 1), day.max), ("o_orderdate", day.min, day(1998, 1, 1))]
    assert spans(c, y.isin(1995, 1999)) == [("o_orderdate", day(1995, 1, 1), day(2000, 1, 1))]
    assert spans(c, (y == 1997) | (c.quantity < 3)) == spans(c, ~(y == 1997)) == spans(c, y != 1997) == spans(c, m == 199713) == spans(c, y == "1997") == []
    sliced = c.view().columns(c.part.brand.members()).slice(c.order_date.year[1998]["March"])
    assert spans(c, sliced.predicate) == [("o_orderdate", day(1998, 1, 1), day(1999, 1, 1))]


def test_facts_without_targets_are_not_prepared(spark, tmp_path):
    tables = {"f": spark.createDataFrame([(1, 5), (2, 7), (9, 1)], "d_id long, v int"), "d": spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "d_id long, d string, e_id long"), "e": spark.createDataFrame([(1, "x")], "e_id long, e string")}
    keys = [ForeignKey("f", "d_id", "d", "d_id"), ForeignKey("d", "e_id", "e", "e_id")]
    c = CubeSession.infer(spark, FrameSource(spark, tables), keys=keys, fact="f").cube("cube")
    with pytest.raises(ModelError, match="3 facts but 2"):
        prepare(c, str(tmp_path / "f"))


def test_tables_and_keys_of_a_catalog(spark):
    url = "jdbc:derby:memory:catalog"
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    for sql in (
        "CREATE TABLE TOP (ID INT PRIMARY KEY, NAME VARCHAR(9))",
        "CREATE TABLE LOW (NR INT PRIMARY KEY, LABEL VARCHAR(9), UP INT REFERENCES TOP(ID))",
        "CREATE TABLE SALE (LOW_NR INT REFERENCES LOW(NR), OTHER INT REFERENCES LOW(NR), AMOUNT INT)",
        "INSERT INTO TOP VALUES (1, 'x'), (2, 'y')", "INSERT INTO LOW VALUES (1, 'a', 1), (2, 'b', 2), (3, 'c', 2)",
        "INSERT INTO SALE VALUES (1, 1, 10), (2, 3, 20), (3, 3, 30), (3, 2, 40)",
    ):
        connection.createStatement().execute(sql)
    source = JdbcSource(spark, url, schema="APP")
    assert source.names() == ["LOW", "SALE", "TOP"] and source.primary_key("LOW") == ["NR"] and source.primary_key("SALE") == []
    assert set(source.keys()) == {ForeignKey("LOW", "UP", "TOP", "ID"), ForeignKey("SALE", "LOW_NR", "LOW", "NR"), ForeignKey("SALE", "OTHER", "LOW", "NR")}
    model = infer_model(source, name="sold")
    assert model.fact == "SALE" and [d.name for d in model.dimensions] == ["LOW1", "LOW"] and [m.name for m in model.measures] == ["AMOUNT"]
    c = CubeSession.infer(spark, source).cube("cube")
    got = c.view().columns(c.LOW1.TOP.members()).measures("AMOUNT").to_df().collect()
    assert sorted(map(tuple, got)) == [("x", 10), ("y", 90)]
    connection.close()
