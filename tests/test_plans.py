"""The shape of the plans that matter at scale."""

import pytest
from conftest import SF

from martlens.operators import integrity, statistics
from martlens.operators.filters import dashboard_filter
from martlens.plans import reports
from martlens.plans.star import retail_star
from martlens.testbed.bindings import input_tables, sales_lines, star, table, with_profit
from martlens.testbed.catalog import QUERIES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "enrich_star", "monthly_trend", "division_share", "top10_products", "null_audit",
    "orphan_facts", "late_shipments", "consolidate_lines", "exact_dedup", "sample_pairs",
    "histogram", "standardize", "filter_dashboard",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cartesian_product(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoopJoin"):
        assert word not in plan


def test_top_n_keeps_n_rows_per_task(spark):
    lines = star(spark, SF).select("product_name", "sales")
    assert "TakeOrderedAndProject(limit=10" in physical(reports.top_products(lines, 10))
    sampled = statistics.sample_rows(sales_lines(spark, SF), ["order_id"], 300)
    assert "TakeOrderedAndProject(limit=300" in physical(sampled)


def test_orphans_are_an_anti_join(spark):
    plan = physical(
        integrity.orphan_keys(
            table(spark, SF, "orders"), table(spark, SF, "lineitem"), "o_orderkey", "l_orderkey"
        )
    )
    assert "LeftAnti" in plan


def test_filters_and_columns_reach_the_scan(spark):
    lines = star(spark, SF).select("sales", "order_date", "order_year", "division", "region")
    plan = dashboard_filter(lines, [1996], "ASIA", "PROMO", "order_date")
    text = physical(plan)
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "EqualTo(p_type,PROMO)" in text and "EqualTo(r_name,ASIA)" in text
    assert "l_extendedprice" in text and "l_tax" not in text and "l_shipdate" not in text


def test_rollup_sums_before_the_join(spark):
    plan = physical(star(spark, SF).rollup(["order_year"], ["sales"]))
    join = plan.index("Join")
    assert plan.index("partial_sum", join) > join  # a partial sum below the join
    assert plan.count("keys=[order_id") == 2


def test_rollup_sums_before_a_join_on_several_keys(spark):
    merged = retail_star(**input_tables(spark, SF))
    plan = physical(merged.rollup(["unit_price", "target"], ["sales"]))
    assert "partial_sum" in plan[plan.index("Join") :]


def test_hot_key_is_split_in_a_shuffle_join(spark):
    """A third of the fact on one key: the join splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fact = spark.range(300_000).selectExpr(
            "IF(id % 3 = 0, 7, id % 5000) AS k", "id AS v", "uuid() AS pad"
        )
        lookup = spark.range(5_000).selectExpr("id AS k", "id * 2 AS w")
        joined = fact.join(lookup, "k", "left")
        assert joined.selectExpr("v", "w", "pad").filter("w >= 0").count() == 300_000
        counted = joined.agg({"w": "sum", "pad": "max"})
        counted.collect()
        assert "skew=true" in physical(counted)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "by", [("order_year",), ("division", "target"), ("order_year", "division")]
)
def test_rollup_holds_on_a_shuffle_join(spark, rows, by):
    small = rows(star(spark, SF).rollup(by, ["units"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(star(spark, SF).rollup(by, ["units"])) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_joins_of_enrich_star_carry_no_column_that_can_be_computed_later(spark, rows):
    whole, lean = star(spark, SF), star(spark, SF, lean=True)
    assert not {"gross_profit", "cost"} & set(lean.fact.columns)
    assert not {"order_year", "order_weekday"} & set(lean.lookups[0].table.columns)
    want = whole.merged()
    assert rows(with_profit(lean.merged()), *want.columns) == rows(want)
    plan = QUERIES["enrich_star"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join"):]
    assert "dayofmonth" not in below and "gross_profit" not in below
