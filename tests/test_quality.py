import random

import pytest

from martlens.operators import cleaning, integrity, profiling


@pytest.fixture(scope="module")
def lines(spark):
    data = [
        (1, "o1", "p1", "Bar", 10.0, 2),
        (2, "o1", "p1", "Bar", 10.0, 2),
        (3, "o1", "p1", "bar", 5.0, 1),
        (4, "o2", "p2", None, -1.0, 0),
        (5, "o2", "p9", "Gum", float("nan"), None),
        (6, None, None, None, None, None),
        (7, None, None, None, None, None),
    ]
    return spark.createDataFrame(
        data,
        "row_id bigint, order_id string, product_id string, product_name string, "
        "sales double, units int",
    )


BUSINESS = ["order_id", "product_id", "product_name", "sales", "units"]


def test_shape_and_preview(spark, lines, rows):
    assert rows(profiling.table_shape({"a": lines, "b": spark.range(3)})) == [
        ("a", 7, 6),
        ("b", 3, 1),
    ]
    assert [r["row_id"] for r in profiling.preview(lines, ["row_id"], 2).collect()] == [1, 2]


@pytest.mark.parametrize("wide", [False, True])
def test_duplicates(lines, rows, wide):
    assert rows(profiling.duplicate_keys(lines, "order_id", "product_id")) == [
        ("o1", "p1", 3), (None, None, 2),
    ]
    assert profiling.duplicate_row_count(lines.drop("row_id"), wide).first()[0] == 2
    assert profiling.duplicate_row_count(lines.limit(0), wide).first()[0] == 0
    assert tuple(profiling.distinct_count(lines, "order_id", "product_id").first()) == (2, 3)


def test_nulls_count_nan(lines, rows):
    got = profiling.null_counts(lines).first().asDict()
    assert got["null_sales"] == 3 and got["null_row_id"] == 0 and got["null_product_name"] == 3
    profile = {r["column_name"]: r for r in profiling.schema_profile(lines).collect()}
    assert profile["sales"]["non_null"] == 4 and profile["sales"]["data_type"] == "double"
    assert [r["position"] for r in profiling.schema_profile(lines).collect()] == list(range(1, 7))


def test_frequencies_and_variants(lines, rows):
    assert ("order_id", "o1", 3) in rows(profiling.value_frequency(lines, ["order_id", "units"]))
    assert ("units", None, 3) in rows(profiling.value_frequency(lines, ["order_id", "units"]))
    assert rows(profiling.keys_with_several_names(lines, "product_id", "product_name")) == [
        ("p1", 2, 3)
    ]
    assert len(profiling.distinct_values(lines, "order_id").collect()) == 3


def test_summaries_of_single_row(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    wide = profiling.numeric_summary(df, ["x"]).first().asDict()
    assert wide == {"min_x": 2.0, "max_x": 2.0, "avg_x": 2.0, "median_x": 2.0, "stddev_x": None}
    assert profiling.describe_numeric(df).first()["p25"] == 2.0


def test_describe_against_pandas(spark):
    rng = random.Random(1)
    data = [(rng.gauss(0, 5), rng.randint(0, 9)) for _ in range(500)] + [(float("nan"), None)]
    df = spark.createDataFrame(data, "a double, b int")
    expected = df.toPandas().describe().T
    for row in profiling.describe_numeric(df).collect():
        want = expected.loc[row["column_name"]]
        got = [row[k] for k in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert got == pytest.approx(list(want))


def test_orphans(spark, lines, rows):
    products = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,)], "product_id string")
    assert [tuple(r) for r in integrity.orphan_keys(lines, products, "product_id").collect()] == [
        (None, 2), ("p9", 1),
    ]


def test_value_rules(lines):
    assert [r["row_id"] for r in integrity.negative_rows(lines, "sales").collect()] == [4]
    assert [r["row_id"] for r in integrity.negative_rows(lines, "sales", "units").collect()] == [4]
    assert [r["row_id"] for r in integrity.nonpositive_rows(lines, "units").collect()] == [4]


def test_sum_rule(spark):
    data = [(0.3, 0.1, 0.2), (1.0, 0.5, 0.4), (None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "sales double, gross_profit double, cost double")
    assert integrity.rule_violations(df, tolerance=None).count() == 2  # 0.1 + 0.2 is not 0.3
    assert integrity.rule_violations(df).count() == 1
    assert integrity.rule_violations(df, decimals=2).count() == 1


@pytest.mark.parametrize("wide", [False, True])
def test_exact_copies(lines, rows, wide):
    kept = cleaning.drop_exact_copies(lines, "row_id", BUSINESS, wide)
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert kept.columns == lines.columns
    copies = cleaning.exact_copies(lines, "row_id", BUSINESS, wide)
    assert sorted(r["row_id"] for r in copies.collect()) == [2, 7]
    again = cleaning.drop_exact_copies(kept, "row_id", BUSINESS)
    assert repr(rows(again)) == repr(rows(kept))  # a NaN differs from itself


@pytest.mark.parametrize("wide", [False, True])
def test_exact_copies_carry_other_columns(spark, rows, wide):
    df = spark.createDataFrame(
        [(2, "a", "second"), (1, "a", "first"), (3, "b", "third")], "id int, k string, note string"
    )
    assert rows(cleaning.drop_exact_copies(df, "id", ["k"], wide)) == [
        (1, "a", "first"), (3, "b", "third"),
    ]


@pytest.mark.parametrize("sparse", [False, True])
def test_consolidation_keeps_totals(spark, sparse):
    rng = random.Random(5)
    data = [
        (
            i,
            rng.choice("abc"),
            rng.choice("xyz") + str(i % 9 or i),
            float(rng.randint(1, 99)),
            rng.randint(1, 5),
        )
        for i in range(200)
    ]
    df = spark.createDataFrame(
        data, "row_id int, order_id string, product_id string, sales double, units int"
    )
    out = cleaning.consolidate_lines(df, summed=("sales", "units"), sparse=sparse)
    assert out.columns == df.columns
    assert out.count() == len({(d[1], d[2]) for d in data})
    want = df.groupBy().sum("sales", "units").first()
    assert tuple(out.groupBy().sum("sales", "units").first()) == tuple(want)
    best = {}
    for d in data:
        best[d[1], d[2]] = min(best.get((d[1], d[2]), d[0]), d[0])
    assert {(r["order_id"], r["product_id"]): r["row_id"] for r in out.collect()} == best


def test_consolidation_mixes_attributes(spark):
    df = spark.createDataFrame(
        [("o", "p", "z", 2, 1.0), ("o", "p", "a", 9, 1.0)],
        "order_id string, product_id string, city string, row_id int, sales double",
    )
    row = cleaning.consolidate_lines(df, summed=("sales",)).first()
    assert (row["city"], row["row_id"], row["sales"]) == ("a", 2, 2.0)


def test_drop_incomplete(lines):
    kept = cleaning.drop_incomplete(lines, ["sales", "units"])
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 3, 4]
