"""Batch jobs for spark-submit: clean, merge, append, audit, dashboard, train, score.

    spark-submit martlens/cli.py audit --sales s.csv --products p.csv \
        --factories f.csv --targets t.csv --out reports/

Inputs are CSV files with the usual headings, parquet folders or catalog
tables (``--format``).  Every result is written below ``--out`` as parquet.
``dashboard`` and ``train`` can read the table that ``merge`` wrote instead
(``--merged``).  ``append`` adds new lines to a stored roll-up (``--store``), from which
``dashboard`` then answers a filter choice; it reads the lines only to finish the median.
With ``--rejects`` bad CSV rows of the sales are set aside instead of stopping the job.
Intermediate copies are removed when a job ends.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from martlens.functions.columns import col  # noqa: E402
from martlens.models import features  # noqa: E402
from martlens.models.evaluation import residual_histogram  # noqa: E402
from martlens.models.scoring import score_scenarios  # noqa: E402
from martlens.models.training import (  # noqa: E402
    ModelConfig,
    cross_validate,
    load,
    model_features,
    save,
    train,
)
from martlens.operators import profiling  # noqa: E402
from martlens.operators.filters import ALL, filter_options  # noqa: E402
from martlens.operators.statistics import (  # noqa: E402
    box_stats,
    histogram,
    iqr_outliers,
    quartiles,
    sample_rows,
    scatter_bins,
)
from martlens.plans import audit, dashboard, reports  # noqa: E402
from martlens.plans.rollups import RollupStore  # noqa: E402
from martlens.plans.star import Star, merge_growth, retail_star  # noqa: E402
from martlens.session import build_session, scratch_scope  # noqa: E402
from martlens.sources import readers, schemas  # noqa: E402
from martlens.sources.tables import materialize, replace_table  # noqa: E402

INPUTS = {
    "sales": schemas.SALES_TABLE,
    "products": schemas.PRODUCTS_TABLE,
    "factories": schemas.FACTORIES_TABLE,
    "targets": schemas.TARGETS_TABLE,
}
SCENARIOS = schemas.TableSpec(
    "scenarios",
    {
        "Division": ("division", "string"),
        "Region": ("region", "string"),
        "Ship Mode": ("ship_mode", "string"),
        "Units": ("units", "bigint"),
        "Unit Price": ("unit_price", "double"),
        "Unit Cost": ("unit_cost", "double"),
        "Shipping Days": ("shipping_days", "bigint"),
        "Order Month": ("order_month", "bigint"),
        "Quarter": ("quarter", "bigint"),
    },
    (
        "division", "region", "ship_mode", "units", "unit_price", "unit_cost", "shipping_days",
        "order_month", "quarter",
    ),
)


def read(spark: SparkSession, source: str, spec: schemas.TableSpec, kind: str) -> DataFrame:
    reader = {
        "csv": readers.read_csv,
        "parquet": readers.read_parquet,
        "table": readers.read_table,
    }[kind]
    return reader(spark, source, spec)


def load_star(spark: SparkSession, args: argparse.Namespace) -> Star:
    if getattr(args, "merged", None):
        return Star(spark.read.parquet(args.merged), ())  # every column is on the fact
    lacking = [f"--{n}" for n in INPUTS if not getattr(args, n)]
    if lacking:
        raise SystemExit(f"missing: {' '.join(lacking)}")
    if getattr(args, "rejects", None) and args.format != "csv":
        raise SystemExit("--rejects is for CSV files")
    tables = {n: read(spark, getattr(args, n), spec, args.format) for n, spec in INPUTS.items()
              if n != "sales"}
    if getattr(args, "rejects", None):
        tables["sales"], bad = readers.read_csv_checked(spark, args.sales, INPUTS["sales"])
        bad.write.mode("overwrite").parquet(args.rejects)
    else:
        tables["sales"] = read(spark, args.sales, INPUTS["sales"], args.format)
    if args.clean:
        tables["sales"] = audit.clean_sales(tables["sales"])
    if args.clean or args.format == "csv":
        # many results read the fact: parse the text, or clean, only once
        tables["sales"] = materialize(tables["sales"], "sales")
    star = retail_star(**tables)
    star.check_keys()
    return star


def write(results: dict[str, DataFrame], out: str) -> None:
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def run_clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """The sales table without copies and split lines.

    A catalog table is replaced, its old contents stay as ``<name>_backup``; files are
    left alone and the result is written out.
    """
    cleaned = audit.clean_sales(read(spark, args.sales, INPUTS["sales"], args.format))
    if args.format == "table":
        cleaned = replace_table(cleaned, args.sales)
        write({"schema": profiling.schema_profile(cleaned)}, args.out)
    else:
        write({"sales": cleaned}, args.out)


def run_merge(spark: SparkSession, args: argparse.Namespace) -> None:
    """The merged table, one folder per order year, with its preview and schema."""
    path = f"{args.out.rstrip('/')}/merged"
    merged = load_star(spark, args).merged()
    merged.write.mode("overwrite").partitionBy("order_year").parquet(path)
    saved = spark.read.parquet(path)
    first = [c for c in ("row_id", "order_id", "product_id") if c in saved.columns]
    write(
        {"preview": profiling.preview(saved, first, 50), "schema": profiling.schema_profile(saved)},
        args.out,
    )


def run_audit(spark: SparkSession, args: argparse.Namespace) -> None:
    star = load_star(spark, args)
    write({**audit.audit(star), "merge_growth": merge_growth(star)}, args.out)


def run_append(spark: SparkSession, args: argparse.Namespace) -> None:
    """New lines into the stored roll-up, as the batch of the given name."""
    store = RollupStore(spark, args.store)
    store.append(load_star(spark, args), args.batch)
    if args.compact:
        store.compact()
    batches = spark.createDataFrame([(b,) for b in store.batches()], "batch string")
    write({"batches": batches, "annual_sales": reports.annual_sales(store.sums())}, args.out)


def stored_dashboard(spark: SparkSession, args: argparse.Namespace) -> None:
    """The page of a choice from the stored roll-up; the headline if the lines are given."""
    store = RollupStore(spark, args.store)
    choice = (args.years, args.region, args.division)
    rollup = materialize(store.sums(), "rollup")
    results = dashboard.dashboard(rollup, *choice)
    if not results:
        print("no data matches the filter")
        return
    results["correlations"] = store.correlations(*choice)
    results["orders"] = store.distinct_orders((), *choice)
    results["options"] = filter_options(rollup, ("order_year", "region", "division"))
    if args.merged or args.sales:
        results["headline"] = store.headline(load_star(spark, args), *choice)
    write(results, args.out)


def run_dashboard(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.store:
        return stored_dashboard(spark, args)
    star = load_star(spark, args)
    choice = (args.years, args.region, args.division)
    rollup = materialize(dashboard.build_rollup(star), "rollup")
    results = dashboard.dashboard(rollup, *choice)
    if not results:
        print("no data matches the filter")
        return
    results["correlations"] = dashboard.correlations(star, *choice)
    results["top5_products"] = reports.top_products(
        star.rollup(("product_id", "product_name"), ("sales",)), 5, ("product_id", "product_name")
    )
    results["options"] = filter_options(rollup, ("order_year", "region", "division"))
    known = quartiles(star.fact, "sales")  # searched once for three results
    results["headline"] = reports.kpi_headline(star.fact, median=known[1])
    results["sales_box"] = box_stats(star.fact, "sales", known=known)
    results["sales_outliers"] = iqr_outliers(star.fact, "sales", known=known)
    results["sales_histogram"] = histogram(star.fact, "sales")
    results["units_sales_scatter"] = scatter_bins(star.fact, "units", "sales")
    write(results, args.out)


def run_train(spark: SparkSession, args: argparse.Namespace) -> None:
    star = load_star(spark, args)
    config = ModelConfig(
        args.algorithm,
        features.FEATURES_WITH_PROFIT if args.with_profit else features.FEATURES,
        trees=args.trees,
        depth=args.depth,
        missing=args.missing,
    )
    lines = star.select(*config.features, config.label, *args.keys)
    fitted = train(lines, config, args.keys, args.test_share)
    save(fitted, args.model)
    scored = fitted.predict(fitted.test)
    sample = sample_rows(fitted.test, args.keys)
    results = {
        "metrics": fitted.metrics(),
        "residuals": residual_histogram(scored, config.label),
        "actual_vs_predicted": fitted.predict(sample).select(
            *[col(k) for k in args.keys], config.label, "prediction"
        ),
    }
    if args.folds:
        results["folds"] = cross_validate(fitted.train, config, args.keys, args.folds)
    forest = args.algorithm == "forest"
    results["importances" if forest else "coefficients"] = (
        fitted.importances() if forest else fitted.coefficients()
    )
    write(results, args.out)


def run_score(spark: SparkSession, args: argparse.Namespace) -> None:
    model = load(args.model)
    scenarios = read(spark, args.scenarios, SCENARIOS, args.format)
    write({"predictions": score_scenarios(model, scenarios, model_features(model))}, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, run, star: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--format", choices=["csv", "parquet", "table"], default="csv")
        p.add_argument("--out", required=True)
        if star:
            for source in INPUTS:
                p.add_argument(f"--{source}")
            p.add_argument("--clean", action="store_true", help="drop copies, merge lines first")
            p.add_argument("--rejects", help="where bad CSV rows of the sales go")
        return p

    p = job("clean", run_clean, star=False)
    p.add_argument("--sales", required=True)
    job("merge", run_merge)
    job("audit", run_audit)
    p = job("append", run_append)
    p.add_argument("--store", required=True, help="folder of the stored roll-up")
    p.add_argument("--batch", required=True, help="name of the new lines; a repeated one replaces")
    p.add_argument("--compact", action="store_true", help="merge all batches afterwards")
    p = job("dashboard", run_dashboard)
    p.add_argument("--store", help="folder of a stored roll-up that answers the choice")
    p.add_argument("--merged", help="a table written by merge, instead of the four inputs")
    p.add_argument("--years", type=int, nargs="*")
    p.add_argument("--region", default=ALL)
    p.add_argument("--division", default=ALL)
    p = job("train", run_train)
    p.add_argument("--merged", help="a table written by merge, instead of the four inputs")
    p.add_argument("--folds", type=int, default=5, help="folds of the training side, 0 for none")
    p.add_argument("--model", required=True)
    p.add_argument("--algorithm", choices=["forest", "linear"], default="forest")
    p.add_argument("--with-profit", action="store_true", help="add the leaking gross profit")
    p.add_argument("--missing", choices=["impute", "drop"], default="impute")
    p.add_argument("--test-share", type=float, default=0.2)
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--depth", type=int, default=5)
    p.add_argument("--keys", nargs="+", default=["row_id"], help="columns that identify a row")
    p = job("score", run_score, star=False)
    p.add_argument("--model", required=True)
    p.add_argument("--scenarios", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or build_session(f"martlens-{args.job}")
    with scratch_scope(session):
        args.run(session, args)


if __name__ == "__main__":
    main()
