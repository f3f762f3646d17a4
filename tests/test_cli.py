import pytest
from test_star import make_sales

from martlens import cli
from martlens.sources import schemas


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The four CSV files, with the headings of the input contract."""
    base = tmp_path_factory.mktemp("csv")
    sales = make_sales(spark, 300).fillna("West", ["region"])
    headings = {name: heading for heading, (name, _) in schemas.SALES.items()}
    pdf = sales.toPandas().rename(columns=headings)
    pdf.to_csv(base / "sales.csv", index=False)
    (base / "products.csv").write_text(
        "Division,Product Name,Factory,Product ID,Unit Price,Unit Cost\n"
        + "".join(
            f"{'Snacks' if p < 6 else 'Drinks'},Name {p},f{p % 2},p{p},{2 + p}.5,{1 + p}\n"
            for p in range(1, 10)
        )
    )
    (base / "factories.csv").write_text("Factory,Latitude,Longitude\nf0,1,2\nf1,3,4\n")
    (base / "targets.csv").write_text("Division,Target\nSnacks,5000\nDrinks,3000\n")
    flags = [x for n in cli.INPUTS for x in (f"--{n}", str(base / f"{n}.csv"))]
    return flags, pdf


def result(spark, out, name):
    return spark.read.parquet(f"{out}/{name}")


def test_merge(spark, inputs, tmp_path):
    flags, pdf = inputs
    cli.main(["merge", *flags, "--out", str(tmp_path)], spark)
    merged = result(spark, tmp_path, "merged")
    assert merged.count() == 300 and {"target", "latitude", "quarter"} <= set(merged.columns)
    assert result(spark, tmp_path, "preview").count() == 50
    assert result(spark, tmp_path, "schema").count() == len(merged.columns)
    one_year = merged.filter("order_year = 2022").select("sales")
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def test_audit(spark, inputs, tmp_path):
    flags, pdf = inputs
    cli.main(["audit", *flags, "--out", str(tmp_path)], spark)
    assert result(spark, tmp_path, "missing_values").first()["null_sales"] == pdf.Sales.isna().sum()
    assert result(spark, tmp_path, "orphan_products").count() == 0
    assert [r["n_rows"] for r in result(spark, tmp_path, "merge_growth").collect()] == [300] * 4
    assert result(spark, tmp_path, "describe").count() == 4


def test_dashboard(spark, inputs, tmp_path):
    flags, pdf = inputs
    cli.main(["dashboard", *flags, "--region", "North", "--out", str(tmp_path)], spark)
    want = pdf.loc[pdf.Region == "North", "Sales"].sum()
    assert result(spark, tmp_path, "kpis").first()["revenue"] == want
    assert result(spark, tmp_path, "correlations").count() == 49
    assert result(spark, tmp_path, "top5_products").columns[:2] == ["product_id", "product_name"]
    assert result(spark, tmp_path, "annual_sales").agg({"sales": "sum"}).first()[0] == want
    assert result(spark, tmp_path, "month_year_pivot").count() <= 12
    options = result(spark, tmp_path, "options")
    assert options.filter("column_name = 'region'").count() == pdf.Region.nunique()


def test_dashboard_without_match(spark, inputs, tmp_path, capsys):
    flags, _ = inputs
    cli.main(["dashboard", *flags, "--years", "1900", "--out", str(tmp_path)], spark)
    assert "no data" in capsys.readouterr().out


def test_train_and_score(spark, inputs, tmp_path):
    flags, pdf = inputs
    model = str(tmp_path / "model")
    extra = ["--algorithm", "linear", "--with-profit", "--missing", "drop", "--clean"]
    cli.main(["train", *flags, *extra, "--model", model, "--out", str(tmp_path)], spark)
    metrics = {r["side"]: r for r in result(spark, tmp_path, "metrics").collect()}
    assert metrics["test"]["r2"] == pytest.approx(1)
    assert result(spark, tmp_path, "coefficients").count() == 12
    scenarios = tmp_path / "scenarios.csv"
    scenarios.write_text(
        "Division,Region,Ship Mode,Units,Unit Price,Unit Cost,Shipping Days,Order Month,Quarter\n"
        "Drinks,North,Sea,10,4,3,4,5,2\n"
    )
    cli.main(
        ["score", "--model", model, "--scenarios", str(scenarios), "--out", str(tmp_path / "s")],
        spark,
    )
    row = result(spark, tmp_path / "s", "predictions").first()
    assert row["predicted_sales"] == pytest.approx(40) and row["gross_profit"] == 10


def test_train_with_the_defaults_and_score(spark, inputs, tmp_path):
    flags, _ = inputs
    model = str(tmp_path / "model")
    cli.main(["train", *flags, "--trees", "3", "--model", model, "--out", str(tmp_path)], spark)
    assert result(spark, tmp_path, "folds").count() == 5
    scenarios = tmp_path / "scenarios.csv"
    scenarios.write_text(
        "Division,Region,Ship Mode,Units,Unit Price,Unit Cost,Shipping Days,Order Month,Quarter\n"
        "Drinks,North,Sea,10,4,3,4,5,2\n"
    )
    out = tmp_path / "s"
    cli.main(["score", "--model", model, "--scenarios", str(scenarios), "--out", str(out)], spark)
    assert result(spark, out, "predictions").first()["gross_profit"] == 10


def test_merged_table_is_used_again(spark, inputs, tmp_path):
    flags, pdf = inputs
    cli.main(["merge", *flags, "--out", str(tmp_path)], spark)
    merged = ["--merged", str(tmp_path / "merged")]
    cli.main(["dashboard", *merged, "--years", "2022", "--out", str(tmp_path / "d")], spark)
    want = pdf.loc[pdf["Order Date"].astype(str).str.contains("2022"), "Sales"].sum()
    assert result(spark, tmp_path / "d", "kpis").first()["revenue"] == pytest.approx(want)
    more = ["--algorithm", "linear", "--model", str(tmp_path / "m"), "--out", str(tmp_path / "t")]
    cli.main(["train", *merged, *more], spark)
    assert result(spark, tmp_path / "t", "folds").count() == 5


def test_inputs_are_asked_for(spark, tmp_path):
    with pytest.raises(SystemExit, match="--sales"):
        cli.main(["audit", "--out", str(tmp_path)], spark)


def test_clean_replaces_a_table(spark, inputs, tmp_path):
    _, pdf = inputs
    for name in ("raw_sales", "raw_sales_backup"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sales = make_sales(spark, 300)
    copied = sales.unionByName(sales.withColumn("row_id", sales.row_id + 1000))
    copied.write.saveAsTable("raw_sales")
    job = ["clean", "--format", "table", "--sales", "raw_sales", "--out", str(tmp_path)]
    cli.main(job, spark)
    cleaned = spark.table("raw_sales")
    assert cleaned.groupBy("order_id", "product_id").count().filter("count > 1").isEmpty()
    assert 0 < cleaned.count() <= 300 and spark.table("raw_sales_backup").count() == 600


def test_append_and_dashboard_from_the_store(spark, inputs, tmp_path, tmp_path_factory):
    flags, pdf = inputs
    base, store = tmp_path_factory.mktemp("days"), str(tmp_path / "store")
    rest = flags[2:]
    for k in range(3):
        pdf.iloc[k::3].to_csv(base / f"{k}.csv", index=False)
        day = ["--sales", str(base / f"{k}.csv"), *rest, "--store", store, "--batch", f"day {k}"]
        more = ["--compact"] if k == 1 else []
        cli.main(["append", *day, *more, "--out", str(tmp_path / f"a{k}")], spark)
    assert result(spark, tmp_path / "a2", "batches").count() == 3
    choice = ["--region", "North", "--store", store]
    cli.main(["dashboard", *choice, "--out", str(tmp_path / "p")], spark)
    cli.main(["dashboard", "--region", "North", *flags, "--out", str(tmp_path / "q")], spark)
    for name in ("kpis", "annual_sales", "region_sales", "correlations"):
        got, want = (
            sorted(map(tuple, result(spark, tmp_path / x, name).collect()), key=repr)
            for x in "pq"
        )
        for a, b in zip(got, want, strict=True):
            assert [x if isinstance(x, str) else pytest.approx(x, rel=1e-9, abs=1e-9) for x in a] == [*b]
    north = pdf[pdf.Region == "North"]
    assert result(spark, tmp_path / "p", "orders").first()[0] == north["Order ID"].nunique()
    cli.main(["dashboard", *choice, *flags, "--out", str(tmp_path / "h")], spark)
    assert result(spark, tmp_path / "h", "headline").first()["median_sale"] == pytest.approx(
        north.Sales.median())


def test_rejects_are_set_aside(spark, inputs, tmp_path):
    flags, pdf = inputs
    path = tmp_path / "sales.csv"
    pdf.to_csv(path, index=False)
    with open(path, "a") as file:
        file.write("not,a,row\n")
    bad = str(tmp_path / "rejects")
    given = ["--sales", str(path), *flags[2:], "--rejects", bad]
    cli.main(["merge", *given, "--out", str(tmp_path / "m")], spark)
    assert result(spark, tmp_path / "m", "merged").count() == len(pdf)
    assert [r["line"] for r in spark.read.parquet(bad).collect()] == ["not,a,row"]
    with pytest.raises(SystemExit, match="CSV"):
        cli.main(["merge", *given, "--format", "parquet", "--out", str(tmp_path / "m")], spark)
