"""Golden values of the sales cube, and the semantics of views, members and cross-tabs."""

import pytest
from pyspark.sql import functions as F

from latticework import CubeSession, ModelError, NoSuchMember
from latticework.operators.crosstab import AmbiguousLabelError, ordered

from .sales import KEYS, MONTHS, PRICE, ROLES, UNITS, cube, tables
from latticework.sources.tables import FrameSource


@pytest.fixture(scope="module")
def c(spark):
    return cube(spark)


def cells(view):
    return {tuple(r)[:-1]: r[-1] for r in view.to_df().collect()}


def test_years_and_shapes(c):
    year = c.date.date_year.year
    view = c.view().columns(year.members())
    out = view.output()
    assert out.shape == (1, 4) and out.loc[0, (2022, "total_sales_price")] == 190570 and out.loc[0, (2021, "unit_sales")] == 3498
    assert list(out.columns.get_level_values(0)) == [2021, 2021, 2022, 2022]
    one = view.with_measures(c.unit_sales)
    assert one.output().shape == (1, 2) and one.output().iloc[0].tolist() == [3498, 3667]
    assert view.output().shape == (1, 4)  # the first view is as it was
    assert view.columns([year[2022], year[2021]]).measures("unit_sales").output().iloc[0].tolist() == [3667, 3498]


def test_months_of_a_year_and_of_all(c):
    year, month = c.date.date_year.year, c.date.date_month.month
    for y in (2021, 2022):
        out = c.view().columns(year[y].children()).measures("total_sales_price").output()
        assert out.shape == (1, 12) and out.iloc[0].tolist() == PRICE[y]
        assert [x[0] for x in out.columns] == MONTHS
    out = c.view().columns(month.members()).measures("unit_sales").output()
    assert out.shape == (1, 24) and out.iloc[0].tolist() == UNITS[2021] + UNITS[2022]
    assert out.columns[0][0] == "2021/January" and out.columns[23][0] == "2022/December"
    assert c.view().columns(year[2021].children()).output().shape == (1, 24)


def test_unqualified_member_is_every_member_of_that_name(c):
    january = c.view().columns([c.date.date_month.month["January"]]).measures("total_sales_price")
    assert sorted(r[1] for r in january.to_df().collect()) == [14971, 16654]
    only = c.view().columns([c.date.date_year.year[2022]["January"], c.date.date_year.year[2022].March]).measures("total_sales_price")
    assert only.output().iloc[0].tolist() == [16654, 18942]


def test_stores_and_missing_cells(c):
    address = c.store.store_address.address
    view = c.view().columns(c.date.date_year.year.members()).rows(address.members()).measures("total_sales_price")
    out = view.output()
    assert out.shape == (2, 2)
    assert out.loc["Jyllandsgade 1", (2022, "total_sales_price")] == 2673 and out[(2021, "total_sales_price")].isna().tolist() == [True, False]
    assert out.loc["Jyllandsgade 2"].tolist() == [176337, 187897]
    wide = {r.store_store_address if "store_store_address" in r else r[0]: r for r in view.crosstab().collect()}
    assert wide["Jyllandsgade 1"]["2021_total_sales_price"] is None and wide["Jyllandsgade 2"]["2022_total_sales_price"] == 187897
    assert view.columns(c.date.date_month.month.members()).output().shape == (2, 24)
    assert view.columns(c.date.date_year.year[2022].children()).output().shape == (2, 12)
    units = cells(view.columns([c.date.date_year.year[2022]["January"]]).measures("unit_sales"))
    assert units == {("January", "Jyllandsgade 1"): 27, ("January", "Jyllandsgade 2"): 273}


def test_no_axes_default_measures_and_rows_without_measures(c):
    assert c.view().output().iloc[0].tolist() == [366907, 7165]
    assert c.view().default_measure("unit_sales").output().iloc[0].tolist() == [7165]
    assert c.view().where(c.date.date_year.year == 1990).output(flat=True).iloc[0].isna().all()
    assert c.view().columns(c.store.store_address.members()).no_measures().to_df().count() == 2
    with pytest.raises(ModelError):
        c.view().no_measures().to_df()


def test_predicates(c):
    year, month, price = c.date.date_year.year, c.date.date_month.month, c.total_sales_price
    total = lambda p: c.view().where(p).measures(n=c.unit_sales.aggregated("count")).to_df().first().n
    assert total(year == 2022) == 13 and total(year != 2022) == 12 and total(year < 2022) == 12 and total(year >= 2021) == 25 and total(year <= 2021) == 12 and total(year > 2021) == 13
    assert total((month == "January") | (month == "February") & (year == 2021)) == 4
    assert total(~(year == 2022)) == 12 and total(month.isin("May", "June")) == 4 and total(month.like("J%")) == 7
    assert total(price.between(12000, 13000)) == 2 and total(price > 15000.5) == sum(p > 15000.5 for y in PRICE for p in PRICE[y]) - 1
    assert total(price < c.unit_sales * 45) == sum(p < u * 45 for y in PRICE for p, u in zip(PRICE[y], UNITS[y]) if (y, p) != (2022, 16654)) + sum((13981 < 273 * 45, 2673 < 27 * 45))
    assert total(month.is_null()) == 0 and total(month.is_not_null()) == 25 and total(year == "2022") == 13
    assert total(c.product.product_name["name"] == "Kid's") == 0 and total(month == month) == 25
    with pytest.raises(TypeError):
        bool(year == 2022)
    view = c.view().where(year == 2022)
    assert view.where(year == 2021).predicate is not view.predicate and view.and_where(month == "May").measures("unit_sales").output().iloc[0, 0] == 262


def test_calculated_measures(c):
    row = c.view().measures(c.unit_sales, p=c.total_sales_price * c.unit_sales, d=c.total_sales_price - c.unit_sales, s=c.total_sales_price + 1, q=c.total_sales_price / (c.unit_sales - 27), h=2 * c.unit_sales, m=c.unit_sales.aggregated("max"), n=c.unit_sales.aggregated("count_distinct")).to_df().first()
    raw = [(p, u) for y in PRICE for p, u in zip(PRICE[y], UNITS[y]) if (y, p) != (2022, 16654)] + [(13981, 273), (2673, 27)]
    assert (row.unit_sales, row.h, row.m, row.n) == (7165, 14330, 381, len({u for _, u in raw}))
    assert row.p == sum(p * u for p, u in raw) and row.d == 366907 - 7165 and row.s == 366907 + 25
    assert row.q == pytest.approx(sum(p / (u - 27) for p, u in raw if u != 27))
    assert list(c.view().measures(c.unit_sales, x=c.unit_sales * 2).to_df().columns) == ["unit_sales", "x"]
    with pytest.raises(ModelError):
        c.view().measures(c.unit_sales * 2)
    with pytest.raises(ValueError):
        c.unit_sales.aggregated("median")


def test_views_never_change(c):
    base = c.view().columns(c.date.date_year.year.members())
    base.rows(c.store.store_address.members()).where(c.date.date_year.year == 2021).measures("unit_sales")
    assert list(base.axes) == [0] and base.predicate is None and base.chosen is None
    c.date.date_year.year.members()  # doesn't touch later selections
    assert base.columns([c.date.date_year.year[2021]]).to_df().count() == 1
    pages_first = c.view().pages(c.product.product_category.members()).rows(c.store.store_address.members()).columns(c.date.date_year.year.members())
    assert pages_first.to_df().columns[:3] == ["date_date_year", "store_store_address", "product_product_category"]
    with pytest.raises(ModelError):
        c.view().rows(c.store.store_address.members()).to_df()  # a gap
    with pytest.raises(ValueError):
        c.view().columns([])
    with pytest.raises(ModelError):
        base.rows(c.date.date_year.year.members())  # the same level twice


def test_members(c):
    year = c.date.date_year.year
    assert year[2022].exists() and not year[1999].exists() and year["2022"].exists()
    with pytest.raises(NoSuchMember):
        year[1999].checked()
    kids = year[2022].children().load()
    assert sorted(m.value for m in kids) == sorted(MONTHS) and kids[0].parent.value == 2022 and kids[0].parent.parent is None
    day = year[2022]["January"][1]
    assert [s.value for s in day.path] == [2022, "January"] and day.exists() and not year[2022]["Nonsense"].exists()
    assert c.date.date_month.month.frame().count() == 24 and c.date.date_month.month.distinct_labels().count() == 12
    with pytest.raises(ModelError):
        day.children()
    a, b = (c.view().columns(x).axes[0] for x in ([year[2021], year[2022]], [year[2022]]))
    assert [m.value for m in (a & b).listed] == [2022] and [m.value for m in (a - b).listed] == [2021] and len((a | b).listed) == 2


def test_navigation(c):
    assert c.dimensions() == ["supplier", "store", "product", "date"] and c.measures() == ["total_sales_price", "unit_sales"]
    assert c.date.hierarchies() == ["date_day", "date_month", "date_year", "ALL"] and c.date.lowest_level() == "date_day"
    assert c["date"]["date_month"]["month"].name == "month" and c.date.date_month.parent() == "date_year" and c.date.date_day.child() is None
    assert c.view().date.date_year.year.name == "year" and c.view().unit_sales.name == "unit_sales" and c.date.date_year.attributes() == []
    for bad in (lambda: c.nothing, lambda: c.date.nothing, lambda: c.date.date_day.nothing):
        with pytest.raises(AttributeError):
            bad()


def test_broken_hierarchy_full_and_needed(spark):
    extra = [(1, 2, 1, None, 5.0, 1), (1, 2, 1, 1, 7.0, 2)]
    full, need = cube(spark, extra), cube(spark, extra, join="needed")
    by_store = lambda k: sum(r[1] for r in k.view().columns(k.store.store_address.members()).measures("unit_sales").to_df().collect())
    by_year = lambda k: sum(r[1] for r in k.view().columns(k.date.date_year.members()).measures("unit_sales").to_df().collect())
    assert by_store(full) == by_store(need) == 7168 and by_year(full) == by_year(need) == 7167
    orphan = cube(spark)
    orphan.source.frames["date_month"] = orphan.source.frames["date_month"].withColumn("year_id", F.when(F.col("month_id") > 1, F.col("year_id")))
    loose = cube(spark, join="needed")
    loose.source.frames["date_month"] = orphan.source.frames["date_month"]
    by_month = lambda k: k.view().columns(k.date.date_month.members()).measures("unit_sales").to_df().count()
    assert by_month(orphan) == 23 and by_month(loose) == 24


def test_trailing_blanks(spark):
    extra = [(1, 2, 2, 1, 5.0, 1)]
    hits = lambda k: k.view().columns([k.product.product_category.category["Shirt"]]).to_df().count()
    assert hits(cube(spark, extra)) == 0 and hits(cube(spark, extra, trim=True)) == 1


def test_order_having_limit_subtotals_shares(c):
    year = c.date.date_year.year
    view = c.view().columns([year[2022], year[2021]]).measures("unit_sales")
    assert [r[0] for r in ordered(view).collect()] == [2022, 2021]
    months = c.view().columns(c.date.date_month.members()).rows(year.members()).measures("unit_sales")
    assert months.having(c.unit_sales > 340).to_df().count() == 3
    assert [r.unit_sales for r in months.limit(2, "unit_sales").to_df().collect()] == [381, 360]
    total = {(r.date_date_year, r.store_store_address): r.unit_sales for r in c.view().columns(year.members()).rows(c.store.store_address.members()).measures("unit_sales").subtotals().collect()}
    assert total[(None, None)] == 7165 and total[(2022, None)] == 3667 and total[(2022, "Jyllandsgade 1")] == 27
    assert c.view().columns(year.members()).rows(c.store.store_address.members()).subtotals(how="cube").count() == 8
    share = months.shares("unit_sales", of="date_date_year").groupBy("date_date_year").agg(F.sum("share").alias("s")).collect()
    assert [r.s for r in share] == pytest.approx([1, 1])


def test_ambiguous_labels(spark):
    k = cube(spark)
    k.source.frames["date_year"] = k.source.frames["date_year"].withColumn("year", F.lit(2000))
    with pytest.raises(AmbiguousLabelError):
        k.view().columns(k.date.date_month.members()).output()


def test_olap_operators(c):
    year = c.date.date_year.year
    months = c.view().columns(c.date.date_month.members()).rows(c.store.store_address.members()).measures("unit_sales")
    up = months.rollup(date="date_year")
    assert cells(up) == cells(c.view().columns(year.members()).rows(c.store.store_address.members()).measures("unit_sales"))
    bag = lambda v: sorted(map(tuple, v.to_df().collect()))
    assert bag(up.drilldown(date="date_month")) == bag(months)
    assert cells(months.rollup(date="ALL")) == {("Jyllandsgade 1",): 27, ("Jyllandsgade 2",): 7138}
    assert cells(months.slice(year[2022])) == {("Jyllandsgade 1",): 27, ("Jyllandsgade 2",): 3640}
    diced = months.rollup(date="date_year").dice({"column": [year[2022]], "row": [c.store.store_address.address["Jyllandsgade 1"]]})
    assert cells(diced) == {(2022, "Jyllandsgade 1"): 27}
    assert len(bag(months.dice({0: [c.date.date_year.year[2022]]}))) == 13
    for bad in (lambda: up.rollup(date="date_day"), lambda: months.drilldown(date="date_year"), lambda: months.rollup(date="week"), lambda: months.rollup(nothing="x"), lambda: months.dice({"page": [year[2022]]}), lambda: months.dice({"row": [year[2022]]})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises((ModelError, AttributeError)):
        up.date.date_day  # rolled away


def test_model_rollup_and_drilldown(c):
    m = c.model
    up = m.rollup(date="date_year", product="ALL")
    assert up.dimension("date").hierarchies() == ["date_year", "ALL"] and up.dimension("product").hierarchies() == ["ALL"]
    assert up.dimension("store").hierarchies() == m.dimension("store").hierarchies() and m.dimension("date").lowest == 0
    assert up.rollup(date="date_year") == up and up.drilldown() == up and m.rollup() == m
    assert up.drilldown(date="date_day", product="product_name") == m and up.drilldown(product="ALL") == up
    for bad in (lambda: up.rollup(date="date_day"), lambda: m.drilldown(date="date_year"), lambda: m.rollup(week="x"), lambda: m.drilldown(date="week")):
        with pytest.raises(ValueError):
            bad()


def test_inference(spark, c):
    source = FrameSource(spark, tables(spark))
    session = CubeSession.infer(spark, source, name="sales", keys=KEYS, roles=ROLES)
    assert session.views == ["sales"] and session.sales.cube.model == c.model
    with pytest.raises(KeyError):
        session.load_view("other")
    plain = CubeSession.infer(spark, source, keys=KEYS).cube("cube")
    assert plain.dimensions() == ["supplier_name", "store_address", "product_name", "date_day"]
    assert plain.view().output().iloc[0].tolist() == [366907, 7165]


def test_metadata_triples(c):
    rows = {tuple(r) for r in c.metadata().collect()}
    eg, q4 = "http://example.org/", "http://purl.org/qb4olap/cubes/"
    assert (eg + "date_month", q4 + "parentLevel", eg + "date_year") in rows and (eg + "store_city", q4 + "inDimension", eg + "store") in rows
    assert ("_:measure_unit_sales", q4 + "hasAggregateFunction", q4 + "sum") in rows
    levels = 11
    assert len(rows) == 1 + 4 * 3 + levels * 2 + (levels - 4) + (levels - 1) + levels + 2 * 4


def test_plan_has_one_shuffle_and_reads_what_it_needs(c, spark, tmp_path):
    from latticework import Cube
    from latticework.sources.tables import parquet

    from .sales import model

    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    k = Cube(model(), parquet(spark, str(tmp_path)))
    assert len(k.source.names()) == 12 and k.source.count("sales") == 25
    view = k.view().columns(k.date.date_year.members()).rows(k.store.store_county.members()).where((k.date.date_month.month == "May") & (k.unit_sales > 3)).measures("unit_sales")
    plan = view.to_df()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 6
    assert "ReadSchema: struct<store:bigint,sale_date:bigint,unit_sales:bigint>" in plan and "GreaterThan(unit_sales,3)" in plan and "EqualTo(month,May)" in plan
