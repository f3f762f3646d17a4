import datetime as dt
import random

import pytest

from martlens.operators.filters import dashboard_filter, filter_options, has_rows
from martlens.plans import reports
from martlens.plans.audit import audit, clean_sales
from martlens.plans.dashboard import build_rollup, correlations, dashboard
from martlens.plans.star import Lookup, Star, left_join, merge_growth, retail_star

REGIONS, DIVISIONS = ["North", "South", None], ["Snacks", "Drinks", "Other", None]


def make_sales(spark, n=400, seed=4):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        p = rng.randint(1, 9)
        ordered = dt.datetime(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 1_200))
        sales = float(rng.randint(1, 100)) if rng.random() > 0.05 else None
        data.append(
            (
                i, f"o{i // 3}", ordered, ordered + dt.timedelta(days=rng.randint(1, 9)),
                rng.choice(["Air", "Sea"]), f"c{i % 5}", "US", "City", "ST", "00501",
                "Snacks" if p < 6 else "Drinks", rng.choice(REGIONS), f"p{p}", f"Name {p}",
                sales, rng.randint(1, 5), None if sales is None else sales * 0.25,
                None if sales is None else sales * 0.75,
            )
        )
    return spark.createDataFrame(
        data,
        "row_id bigint, order_id string, order_date timestamp, ship_date timestamp, "
        "ship_mode string, customer_id string, country string, city string, state string, "
        "postal_code string, division string, region string, product_id string, "
        "product_name string, sales double, units int, gross_profit double, cost double",
    )


@pytest.fixture(scope="module")
def star(spark):
    products = spark.createDataFrame(
        [
            (f"p{p}", f"Name {p}", "Snacks" if p < 6 else "Drinks", f"f{p % 2}", 2.0 + p, 1.0 + p)
            for p in range(1, 9)  # p9 is missing
        ],
        "product_id string, product_name string, division string, factory string, "
        "unit_price double, unit_cost double",
    )
    factories = spark.createDataFrame(
        [("f0", 1.0, 2.0)], "factory string, latitude double, longitude double"
    )
    targets = spark.createDataFrame([("Snacks", 5_000.0)], "division string, target double")
    return retail_star(make_sales(spark), products, factories, targets)


@pytest.fixture(scope="module")
def frame(star):
    return star.merged().toPandas()


def test_chain_keeps_the_fact(star, frame):
    assert len(frame) == 400 == star.merged().count()
    assert [r["n_rows"] for r in merge_growth(star).orderBy("step").collect()] == [400] * 4
    assert frame.loc[frame.product_id == "p9", "unit_price"].isna().all()
    assert frame.loc[frame.division == "Drinks", "target"].isna().all()
    star.check_keys()


def test_select_equals_merged(star, rows):
    names = ["row_id", "latitude", "target", "unit_price", "shipping_days", "quarter"]
    assert repr(rows(star.select(*names))) == repr(rows(star.merged(), *names))


def test_select_skips_unused_lookups(star):
    plan = star.select("sales", "region")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = star.select("sales", "latitude")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # products lead to factories; no targets


def test_chain_is_joined_among_the_lookups(spark):
    fact = spark.createDataFrame(
        [(1, "o1"), (2, "o2"), (3, "o9"), (4, None), (5, "o3")], "id int, o string"
    )
    orders = spark.createDataFrame([("o1", "c1"), ("o2", None), ("o3", "c9")], "o string, c string")
    customers = spark.createDataFrame([("c1", "n1"), ("c2", "n2")], "c string, n string")
    nations = spark.createDataFrame([("n1", "Narnia"), (None, "Nowhere")], "n string, name string")
    chained = Star(
        fact,
        (
            Lookup("orders", orders, ("o",)),
            Lookup("customers", customers, ("c",)),
            Lookup("nations", nations, ("n",)),
        ),
    )
    got = {r["id"]: r["name"] for r in chained.merged().collect()}
    assert got == {1: "Narnia", 2: None, 3: None, 4: None, 5: None}
    got = {r["id"]: r["name"] for r in chained.merged(nulls_match=True).collect()}
    assert got == {1: "Narnia", 2: "Nowhere", 3: "Nowhere", 4: "Nowhere", 5: "Nowhere"}
    assert [x.name for x in chained._folded(chained.lookups)] == ["orders"]
    rolled = {r["name"]: r["n_rows"] for r in chained.rollup(["name"], []).collect()}
    assert rolled == {"Narnia": 1, None: 4}
    matched = chained.rollup(["name"], [], nulls_match=True).collect()
    assert {r["name"]: r["n_rows"] for r in matched} == {"Narnia": 1, "Nowhere": 4}


def test_repeated_lookup_key(spark, star):
    twice = star.lookups[2].table.union(star.lookups[2].table)
    bad = Star(star.fact, (*star.lookups[:2], Lookup("targets", twice, ("division",))))
    with pytest.raises(ValueError, match="targets: key occurs more than once"):
        bad.check_keys()
    assert bad.merged().count() > 400


def test_null_keys(spark, rows):
    left = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    right = spark.createDataFrame([(None, "none"), ("a", "A")], "k string, v string")
    assert rows(left_join(left, right, ["k"]), "id", "v") == [(1, None), (2, "A")]
    assert rows(left_join(left, right, ["k"], nulls_match=True), "id", "v") == [
        (1, "none"), (2, "A"),
    ]


@pytest.mark.parametrize("by", [["target"], ["factory", "region"], ["division"], ["order_year"]])
def test_rollup_equals_plain_grouping(star, frame, by):
    got = {
        tuple(r[c] for c in by): (r["n_rows"], r["n_sales"], r["sales"])
        for r in star.rollup(by, ["sales"]).collect()
    }
    want = {}
    for record in frame.astype(object).where(frame.notna(), None).to_dict("records"):
        n, m, s = want.get(tuple(record[c] for c in by), (0, 0, None))
        sale = record["sales"]
        want[tuple(record[c] for c in by)] = (
            n + 1,
            m + (sale is not None),
            s if sale is None else (s or 0.0) + sale,
        )
    assert got == want


def both(star, *by, sums=("sales",)):
    """The plain fact and its roll-up: every report must agree on the two."""
    return [star.merged(), star.rollup(by, sums)]


def test_monthly_trend(star, frame):
    want = frame.groupby(["order_year", "order_month"])["sales"].sum()
    for df in both(star, "order_year", "order_month"):
        got = reports.monthly_trend(df).collect()
        assert {(r["order_year"], r["order_month"]): r["sales"] for r in got} == want.to_dict()
        assert all(r["period"] == dt.date(r["order_year"], r["order_month"], 1) for r in got)


def test_pivot(star, frame):
    want = frame.groupby(["order_month", "order_year"])["sales"].sum().unstack()
    got = {r["order_month"]: r.asDict() for r in reports.month_year_pivot(star.fact).collect()}
    assert len(got) == 12
    assert got[1]["sales_2021"] == want.loc[1, 2021]
    assert reports.years_in(star.fact) == [2021, 2022, 2023, 2024]


def test_growth_needs_the_preceding_year(spark):
    df = spark.createDataFrame(
        [(2020, 10.0), (2021, 15.0), (2023, 30.0), (2024, 0.0), (2025, 1.0)],
        "order_year int, sales double",
    )
    got = {r["order_year"]: r["growth"] for r in reports.yoy_growth(df).collect()}
    assert got == {2020: None, 2021: 0.5, 2023: None, 2024: -1.0, 2025: None}


def test_groups_leave_out_missing_keys(star, frame):
    want = frame.groupby("region")["sales"].sum().to_dict()
    for df in both(star, "region"):
        got = reports.region_sales(df).collect()
        assert {r["region"]: r["sales"] for r in got} == want
        assert [r["sales"] for r in got] == sorted(want.values(), reverse=True)
    leaders = reports.region_leaders(star.fact).first()
    assert leaders["leading_region"] == max(want, key=want.get)
    assert leaders["smallest_region"] == min(want, key=want.get)


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "region string, sales double")
    assert {r["region"]: r["sales"] for r in reports.region_sales(df).collect()} == {
        "a": 0.0, "b": 1.0,
    }


def test_shares_sum_to_one(star):
    for df in both(star, "division"):
        assert reports.sales_share(df, "division").groupBy().sum("share").first()[0] == (
            pytest.approx(1)
        )
        counted = {r["division"]: r for r in reports.transaction_share(df).collect()}
        assert sum(r["n_transactions"] for r in counted.values()) == 400
        assert sum(r["share"] for r in counted.values()) == pytest.approx(1)


def test_top_products_break_ties_by_name(spark):
    df = spark.createDataFrame(
        [("b", 5.0), ("a", 5.0), ("c", 9.0), (None, 99.0), ("d", 1.0)],
        "product_name string, sales double",
    )
    got = [r["product_name"] for r in reports.top_products(df, 3).collect()]
    assert got == ["c", "a", "b"]


def test_target_achievement(star, frame):
    got = {r["division"]: r for r in reports.target_achievement(star.merged()).collect()}
    total = frame.loc[frame.division == "Snacks", "sales"].sum()
    assert got["Snacks"]["achievement_pct"] == pytest.approx(round(total / 5_000 * 100, 1))
    assert got["Drinks"]["target"] is None and got["Drinks"]["achievement_pct"] is None


def test_quarter_ranks(star):
    got = reports.quarter_season(star.fact).collect()
    for year in {r["order_year"] for r in got}:
        inside = sorted((r for r in got if r["order_year"] == year), key=lambda r: -r["sales"])
        assert [r["season_rank"] for r in inside] == list(range(1, len(inside) + 1))


def test_kpis(star, frame):
    for df in both(star, "division", sums=("sales", "gross_profit", "units")):
        got = reports.kpi_dashboard(df).first()
        assert got["revenue"] == frame.sales.sum()
        assert got["average_sale"] == pytest.approx(frame.sales.mean())
        assert got["margin_pct"] == pytest.approx(25)
        assert got["margin_text"] == "25.0%"
    head = reports.kpi_headline(star.fact).first()
    assert head["median_sale"] == frame.sales.median()
    assert head["n_transactions"] == 400
    assert head["first_order"] == frame.order_date.min().date()


def test_decimal_money_sums_exactly(spark):
    df = spark.range(1_000).selectExpr(
        "CAST(0.1 AS DECIMAL(18,2)) AS sales", "CAST(0.05 AS DECIMAL(18,2)) AS gross_profit",
        "1 AS units", "IF(id % 2 = 0, 'a', 'b') AS region",
    )
    got = reports.kpi_dashboard(df).first()
    assert str(got["revenue"]) == "100.00" and got["margin_pct"] == 50.0
    assert {str(r["sales"]) for r in reports.region_sales(df).collect()} == {"50.00"}


def test_kpis_without_sales(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1)], "sales double, gross_profit double, units int"
    )
    assert reports.kpi_dashboard(df).first()["margin_pct"] == 0.0


def test_filter(star, frame):
    chosen = dashboard_filter(star.fact, [2022, 2023], "North", "Drinks", "order_date")
    want = frame[
        frame.order_year.isin([2022, 2023]) & (frame.region == "North") & (frame.division == "Drinks")
    ]
    assert sorted(r["row_id"] for r in chosen.collect()) == sorted(want.row_id)
    assert dashboard_filter(star.fact).count() == 400
    assert not has_rows(dashboard_filter(star.fact, []))


def test_filter_options(star, frame):
    got = [tuple(r) for r in filter_options(star.fact, ["region", "order_year"]).collect()]
    assert got == [("order_year", str(y)) for y in (2021, 2022, 2023, 2024)] + [
        ("region", "North"), ("region", "South"),
    ]


def test_dashboard_from_rollup(star, frame):
    rollup = build_rollup(star).cache()
    page = dashboard(rollup, [2022], "North")
    want = frame[(frame.order_year == 2022) & (frame.region == "North")]
    assert page["kpis"].first()["revenue"] == want.sales.sum()
    got = {r["product_name"]: r["sales"] for r in page["top_products"].collect()}
    assert got == want.groupby("product_name")["sales"].sum().to_dict()
    assert dashboard(rollup, [1900]) == {}
    assert len(page) == 14 and all(df.count() for df in page.values())
    matrix = {(r["a"], r["b"]): r["r"] for r in correlations(star, [2022], "North").collect()}
    assert matrix["sales", "units"] == pytest.approx(want.sales.corr(want.units))


def test_audit_runs_every_check(star):
    found = audit(star)
    counted = {name: df.count() for name, df in found.items()}
    assert counted["orphan_products"] == 1 and counted["orphan_factories"] == 1
    assert counted["exact_copies"] == 0 and counted["broken_totals"] == 0
    assert counted["missing_values"] == 1


def test_clean_sales(spark):
    sales = make_sales(spark, 60)
    dirty = sales.unionByName(sales.withColumn("row_id", sales.row_id + 1_000))
    clean = clean_sales(dirty)
    assert clean.groupBy().sum("sales").first()[0] == sales.groupBy().sum("sales").first()[0]
    assert clean.groupBy("order_id", "product_id").count().filter("count > 1").count() == 0
    assert clean.groupBy().max("row_id").first()[0] < 1_000


def test_a_rollup_skips_nan_like_the_fact(spark):
    fact = spark.createDataFrame(
        [("a", 10.0), ("a", float("nan")), ("b", 5.0)], "product_id string, sales double"
    )
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "product_id string, kind string")
    star = Star(fact, (Lookup("names", names, ("product_id",)),))
    for by in (["product_id"], ["kind"]):
        rows = star.rollup(by, ["sales"]).orderBy(by).collect()
        assert [(r["sales"], r["n_sales"], r["n_rows"]) for r in rows] == [(10, 1, 2), (5, 1, 1)]


def test_merge_growth_counts_repeated_keys(spark):
    fact = spark.createDataFrame([(i, i % 4) for i in range(40)], "a int, b int")
    first = spark.createDataFrame(
        [(0, 7), (0, 8), (1, 7), (2, None), (None, 9)], "b int, c int"
    )
    second = spark.createDataFrame([(7, "x"), (7, "y"), (9, "z")], "c int, d string")
    third = spark.createDataFrame([(i, i) for i in range(5)] + [(3, 9)], "a int, e int")
    lookups = (
        Lookup("first", first, ("b",)), Lookup("second", second, ("c",)),
        Lookup("third", third, ("a",)),
    )
    star, df, want = Star(fact, lookups), fact, [40]
    for lookup in lookups:
        df = left_join(df, lookup.table, lookup.keys)
        want.append(df.count())
    got = merge_growth(star).orderBy("step").collect()
    assert [r["n_rows"] for r in got] == want
    assert [r["n_columns"] for r in got] == [2, 3, 4, 5] and want[-1] > want[0]
    plan = merge_growth(Star(fact, ()))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_null_keys_are_checked_where_they_match(spark):
    table = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, v int")
    star = Star(spark.createDataFrame([(3,)], "k int"), (Lookup("t", table, ("k",)),))
    star.check_keys()
    with pytest.raises(ValueError, match="more than once"):
        star.check_keys(nulls_match=True)
