"""Encoding, splitting, regression and scoring over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.models import features
from martlens.models.evaluation import regression_metrics, residual_histogram, with_residual
from martlens.models.scoring import derive_scenarios, score_scenarios
from martlens.models.training import (
    ModelConfig,
    cross_validate,
    load,
    save,
    train,
    training_frame,
)
from martlens.operators.statistics import sample_rows
from martlens.session import scratch_path
from martlens.sources.tables import materialize
from martlens.testbed.bindings import LINE_KEYS, sales_lines, star, table
from martlens.testbed.registry import finish, register

# -- encoding and scaling -----------------------------------------------------


_CODES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS label, "
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS code, count(*) AS n_rows "
    f"FROM star WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in features.CATEGORICAL
)


def _encoded(spark, sf_dir):
    """The categories' roll-up with codes, and the fitted encoder."""
    labels = materialize(star(spark, sf_dir).rollup(features.CATEGORICAL, []), "labels")
    model = features.label_indexer(features.CATEGORICAL).fit(labels)
    return model.transform(labels), model


def _per_label(df, suffix):
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}{suffix}").alias("label"),
            F.col(f"{c}_code").cast("bigint").alias("code"),
            "n_rows",
        )
        for c in features.CATEGORICAL
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column_name", "label", "code")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


@register("label_encode", _CODES_SQL, star=True)
def label_encode(spark, sf_dir):
    """Codes in sorted label order, and how many rows got each."""
    return _per_label(_encoded(spark, sf_dir)[0], "")


@register("label_decode", _CODES_SQL, star=True)
def label_decode(spark, sf_dir):
    """Codes turned back into labels."""
    encoded, model = _encoded(spark, sf_dir)
    bare = encoded.drop(*features.CATEGORICAL)
    return _per_label(features.decode_labels(bare, model), "_label")


def _bucket_sql(buckets: int, seed: int = 42) -> str:
    text = f"'{seed}|' || order_id || '|' || product_id || '|' || line_no"
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {buckets}"


_IN_TEST = f"{_bucket_sql(10_000)} < 2000"


@register(
    "impute_mean",
    f"""
    , m AS (SELECT avg(target) AS mean_target FROM star WHERE NOT ({_IN_TEST}))
    SELECT order_id, product_id, line_no,
           round(coalesce(target, (SELECT mean_target FROM m)), 4) AS target
    FROM star
    """,
    star=True,
)
def impute_mean(spark, sf_dir):
    """Missing targets filled with the mean of the training side."""
    # read by the fit and by the transform: join once
    lines = materialize(star(spark, sf_dir).select(*LINE_KEYS, "target"), "targets")
    fit_on, _ = features.hash_split(lines, LINE_KEYS)
    return finish(features.impute_mean(fit_on, ["target"], lines))


@register(
    "standardize",
    f"""
    , m AS (SELECT avg(sales) AS ms, stddev_pop(sales) AS ds, avg(units) AS mu,
                   stddev_pop(units) AS du FROM star WHERE NOT ({_IN_TEST}))
    SELECT order_id, product_id, line_no, round((sales - ms) / ds, 6) + 0.0 AS sales,
           round((units - mu) / du, 6) + 0.0 AS units
    FROM star, m
    """,
    star=True,
)
def standardize(spark, sf_dir):
    lines = sales_lines(spark, sf_dir).select(*LINE_KEYS, "sales", "units")
    fit_on, _ = features.hash_split(lines, LINE_KEYS)
    return finish(features.standardize(fit_on, ["sales", "units"], lines), sales=6, units=6)


@register(
    "hash_split",
    f"""
    SELECT CASE WHEN {_IN_TEST} THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows,
           round(sum(sales), 2) AS sales
    FROM star GROUP BY side
    """,
    star=True,
)
def hash_split(spark, sf_dir):
    side = F.when(features.test_condition(LINE_KEYS), "test").otherwise("train")
    sized = (
        sales_lines(spark, sf_dir)
        .groupBy(side.alias("side"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("sales"))
    )
    return finish(sized, sales=2)


# -- least squares ------------------------------------------------------------

_SIMPLE = ModelConfig("linear", ("cost",))
_SIDES = f""", d AS (
      SELECT *, {_IN_TEST} AS in_test FROM star),
    fit AS (SELECT regr_slope(sales, cost) AS b, regr_intercept(sales, cost) AS a
            FROM d WHERE NOT in_test),
    p AS (SELECT d.*, a + b * cost AS prediction FROM d, fit)
"""


def _train(spark, sf_dir, lines, config):
    return train(lines, config, LINE_KEYS)


def _folds(spark, sf_dir, lines, config):
    """Five folds of the training side."""
    fit_on, _ = features.hash_split(training_frame(lines, config, LINE_KEYS), LINE_KEYS)
    return cross_validate(fit_on, config, LINE_KEYS, 5)


def _simple(spark, sf_dir):
    return _train(spark, sf_dir, sales_lines(spark, sf_dir), _SIMPLE)


@register(
    "ols_fit",
    _SIDES
    + """SELECT 'intercept' AS term, round(a, 4) AS value FROM fit
    UNION ALL SELECT 'cost', round(b, 4) FROM fit""",
    star=True,
)
def ols_fit(spark, sf_dir):
    return finish(_simple(spark, sf_dir).coefficients())


_METRICS_SQL = """count(*) AS n,
           round(1 - avg((sales - prediction) ** 2) / var_pop(sales), 6) AS r2,
           round(avg(abs(sales - prediction)), 4) AS mae,
           round(sqrt(avg((sales - prediction) ** 2)), 4) AS rmse,
           round(avg(abs((sales - prediction) / (sales + 1e-9))) * 100, 4) AS mape"""


@register(
    "ols_metrics",
    _SIDES
    + f"""SELECT CASE WHEN in_test THEN 'test' ELSE 'train' END AS side, {_METRICS_SQL}
    FROM p GROUP BY side""",
    star=True,
)
def ols_metrics(spark, sf_dir):
    return finish(_simple(spark, sf_dir).metrics(), r2=6)


@register(
    "ols_residuals",
    _SIDES
    + """SELECT order_id, product_id, line_no, round(sales, 2) AS sales,
           round(prediction, 4) AS prediction, round(sales - prediction, 4) + 0.0 AS residual
    FROM p WHERE in_test""",
    star=True,
)
def ols_residuals(spark, sf_dir):
    fitted = _simple(spark, sf_dir)
    scored = with_residual(fitted.predict(fitted.test))
    return finish(scored.select(*LINE_KEYS, "sales", "prediction", "residual"), sales=2)


@register(
    "residual_histogram",
    _SIDES
    + """, r AS (SELECT sales - prediction AS v FROM p WHERE in_test),
    e AS (SELECT min(v) AS lo, max(v) AS hi FROM r),
    b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 50)) AS BIGINT) + 1, 50) AS bin, lo, hi
          FROM r, e)
    SELECT bin, round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 50), 4) + 0.0
             AS bin_low,
           round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 50), 4) + 0.0
             AS bin_high,
           count(*) AS n
    FROM b GROUP BY bin""",
    star=True,
)
def residuals_histogram(spark, sf_dir):
    fitted = _simple(spark, sf_dir)
    return finish(residual_histogram(fitted.predict(fitted.test)))


@register(
    "actual_vs_predicted",
    _SIDES
    + """SELECT order_id, product_id, line_no, round(sales, 2) AS sales,
           round(prediction, 4) AS prediction
    FROM p WHERE in_test
    ORDER BY md5('42|' || order_id || '|' || product_id || '|' || line_no),
             order_id, product_id, line_no LIMIT 300""",
    star=True,
)
def actual_vs_predicted(spark, sf_dir):
    """The sample of test rows behind the actual-versus-predicted chart."""
    fitted = _simple(spark, sf_dir)
    sample = sample_rows(fitted.test, LINE_KEYS, 300)
    return finish(fitted.predict(sample).select(*LINE_KEYS, "sales", "prediction"), sales=2)


@register(
    "cost_as_predictor",
    """
    SELECT count(*) AS n, round(1 - avg((sales - cost) ** 2) / var_pop(sales), 6) AS r2,
           round(avg(abs(sales - cost)), 4) AS mae,
           round(sqrt(avg((sales - cost) ** 2)), 4) AS rmse,
           round(avg(abs((sales - cost) / (sales + 1e-9))) * 100, 4) AS mape
    FROM star
    """,
    star=True,
)
def cost_as_predictor(spark, sf_dir):
    """The metric formulas on a prediction that needs no fit."""
    return finish(regression_metrics(sales_lines(spark, sf_dir), "sales", "cost"), r2=6)


_FOLD_SQL = f"""
    , d AS (SELECT sales AS y, cost AS x, {_bucket_sql(5)} AS fold FROM star
            WHERE NOT ({_IN_TEST})),
    k AS (SELECT DISTINCT fold FROM d),
    fit AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
            FROM k JOIN d ON d.fold <> k.fold GROUP BY k.fold)
    SELECT d.fold, round(1 - avg((y - a - b * x) ** 2) / var_pop(y), 6) AS r2
    FROM d JOIN fit ON d.fold = fit.fold GROUP BY d.fold
    """


@register("kfold_r2", _FOLD_SQL, star=True)
def kfold_r2(spark, sf_dir):
    """R2 of five held-out folds of the training side, from one pass."""
    return finish(_folds(spark, sf_dir, sales_lines(spark, sf_dir), _SIMPLE), r2=6)


# -- full feature sets --------------------------------------------------------


def _lines(spark, sf_dir, columns):
    keys = [k for k in LINE_KEYS if k not in columns]
    return star(spark, sf_dir).select(*columns, "sales", *keys)


_METRICS_OF_RESIDUAL = """count(*) AS n,
           round(1 - avg(r * r) / var_pop(y), 6) AS r2, round(avg(abs(r)), 4) AS mae,
           round(sqrt(avg(r * r)), 4) AS rmse, round(avg(abs(r / (y + 1e-9))) * 100, 4) AS mape"""


def _encoded_sql() -> str:
    """CTE ``d0``: the features as numbers f0.., the label y, split and fold."""
    codes = ", ".join(
        f"dense_rank() OVER (ORDER BY {c}) - 1.0 AS f{i}" if c in features.CATEGORICAL
        else f"CAST({c} AS DOUBLE) AS f{i}"
        for i, c in enumerate(features.FEATURES)
    )
    return f""", d0 AS MATERIALIZED (
      SELECT {codes}, sales AS y, {_IN_TEST} AS in_test, {_bucket_sql(5)} AS fold FROM star)
"""


def _residual_sql(tag: str, fit_on: str) -> str:
    """CTEs that end in ``{tag}_r``: least-squares residuals r of every row of d0.

    The features are removed one after the other (successive orthogonalization)
    with coefficients taken from the rows ``fit_on`` selects, so the residual of
    any other row is its label minus the prediction.
    """
    k = len(features.FEATURES)
    means = ", ".join(f"avg(f{i}) AS m{i}" for i in range(k))
    centred = ", ".join(f"f{i} - m{i} AS x{i}" for i in range(k))
    out = f""", {tag}_m AS (SELECT avg(y) AS my, {means} FROM d0 WHERE {fit_on}),
    {tag}_0 AS MATERIALIZED (
      SELECT in_test, fold, y, y - my AS r, {centred} FROM d0, {tag}_m)
"""
    for j in range(k):
        later = range(j + 1, k)
        sums = "".join(f", sum(x{j} * x{i}) AS c{i}" for i in later)
        rest = "".join(
            f", x{i} - coalesce(c{i} / nullif(d, 0), 0) * x{j} AS x{i}" for i in later
        )
        name = f"{tag}_r" if j == k - 1 else f"{tag}_{j + 1}"
        out += f""", {tag}_c{j} AS (
      SELECT sum(x{j} * x{j}) AS d, sum(x{j} * r) AS cr{sums} FROM {tag}_{j} WHERE {fit_on}),
    {name} AS MATERIALIZED (
      SELECT in_test, fold, y, r - coalesce(cr / nullif(d, 0), 0) * x{j} AS r{rest}
      FROM {tag}_{j}, {tag}_c{j})
"""
    return out


@register(
    "ols_multi",
    _encoded_sql()
    + _residual_sql("a", "NOT in_test")
    + f"""SELECT CASE WHEN in_test THEN 'test' ELSE 'train' END AS side, {_METRICS_OF_RESIDUAL}
    FROM a_r GROUP BY side""",
    star=True,
)
def ols_multi(spark, sf_dir):
    config = ModelConfig("linear")
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, config.features), config)
    return finish(fitted.metrics(), r2=6)


_LEAKING = ModelConfig("linear", features.FEATURES_WITH_PROFIT, missing="drop")


@register(
    "ols_with_profit",
    f"""
    SELECT CASE WHEN {_IN_TEST} THEN 'test' ELSE 'train' END AS side, count(*) AS n,
           1.0::DOUBLE AS r2, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mape
    FROM star GROUP BY side
    """,
    star=True,
)
def ols_with_profit(spark, sf_dir):
    """Sales are profit plus cost, so this feature set must fit exactly."""
    lines = _lines(spark, sf_dir, _LEAKING.features)
    return finish(_train(spark, sf_dir, lines, _LEAKING).metrics())


@register(
    "kfold_r2_multi",
    _encoded_sql()
    + "".join(_residual_sql(f"k{i}", f"NOT in_test AND fold <> {i}") for i in range(5))
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS fold, round(1 - avg(r * r) / var_pop(y), 6) AS r2 FROM k{i}_r "
        f"WHERE NOT in_test AND fold = {i}"
        for i in range(5)
    ),
    star=True,
)
def kfold_r2_multi(spark, sf_dir):
    config = ModelConfig("linear")
    lines = _lines(spark, sf_dir, config.features)
    return finish(_folds(spark, sf_dir, lines, config), r2=6)


@register("kfold_r2_forest")
def kfold_r2_forest(spark, sf_dir):
    """The same folds for the forest, which has to be fitted anew for each."""
    config = ModelConfig("forest")
    return _folds(spark, sf_dir, _lines(spark, sf_dir, config.features), config)


@register("forest_metrics")
def forest_metrics(spark, sf_dir):
    config = ModelConfig("forest")
    return _train(spark, sf_dir, _lines(spark, sf_dir, config.features), config).metrics()


@register("forest_importance")
def forest_importance(spark, sf_dir):
    config = ModelConfig("forest")
    return _train(spark, sf_dir, _lines(spark, sf_dir, config.features), config).importances()


@register(
    "forest_bounds",
    f"""
    SELECT CASE WHEN {_IN_TEST} THEN 'test' ELSE 'train' END AS side, count(*) AS n,
           count(*) AS n_inside, 'true' AS good_fit, 1.0::DOUBLE AS importance
    FROM star GROUP BY side
    """,
    star=True,
)
def forest_bounds(spark, sf_dir):
    """What holds for any fitted forest: a prediction is a mean of training labels.

    Every row of both sides is scored, none outside the range of the labels;
    importances sum to 1; R2 is above 0.9 on both sides.
    """
    config = ModelConfig("forest")
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, config.features), config)
    low, high = fitted.train.agg(F.min("sales"), F.max("sales")).first()
    total = fitted.importances().agg(F.sum("importance")).first()[0]
    scored = fitted.scored()
    inside = scored.groupBy("side").agg(
        F.count_if(F.col("prediction").between(low, high)).alias("n_inside")
    )
    return finish(
        fitted.metrics(scored)
        .join(inside, "side")
        .select(
            "side", "n", "n_inside", (F.col("r2") > 0.9).cast("string").alias("good_fit"),
            F.lit(total).alias("importance"),
        )
    )


_STUMP = ModelConfig("forest", ("units",), trees=1, depth=1)


@register(
    "forest_stump",
    f""", d AS (SELECT *, {_IN_TEST} AS in_test FROM star),
    v AS (SELECT units, count(*) AS n, sum(sales) AS s FROM d WHERE NOT in_test GROUP BY units),
    c AS (SELECT units, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
                 sum(n) OVER () AS n, sum(s) OVER () AS s
          FROM v WINDOW w AS (ORDER BY units)),
    best AS (SELECT units AS cut, sl / nl AS low, (s - sl) / (n - nl) AS high FROM c WHERE nl < n
             ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1),
    p AS (SELECT d.*, CASE WHEN units <= cut THEN low ELSE high END AS prediction FROM d, best)
    SELECT CASE WHEN in_test THEN 'test' ELSE 'train' END AS side, count(*) AS n,
           round(1 - avg((sales - prediction) ** 2) / var_pop(sales), 6) AS r2,
           round(min(prediction), 4) AS low, round(max(prediction), 4) AS high,
           1.0::DOUBLE AS importance
    FROM p GROUP BY in_test
    """,
    star=True,
)
def forest_stump(spark, sf_dir):
    """One tree of one split is not bagged: SQL finds the same split, means and fit."""
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, _STUMP.features), _STUMP)
    weight = fitted.importances().first()["importance"]
    ends = fitted.predict(fitted.rows).groupBy("side").agg(
        F.min("prediction").alias("low"), F.max("prediction").alias("high")
    )
    return finish(
        fitted.metrics().select("side", "n", "r2").join(ends, "side")
        .withColumn("importance", F.lit(weight)), r2=6,
    )


_TWO_LEVELS = ModelConfig("forest", ("order_month", "order_day"), trees=1, depth=2)


def _best_splits(level: str, rows: str) -> str:
    """CTEs that find the best split of each node of a level, over both features.

    ``rows`` has the node, both features and sales; a split sends values up to ``cut`` left,
    and takes ``less`` from the squared errors.
    """
    return f""", v{level} AS (
      SELECT node, f, x, count(*) AS n, sum(sales) AS s FROM (
        SELECT node, 'order_month' AS f, order_month AS x, sales FROM {rows}
        UNION ALL SELECT node, 'order_day', order_day, sales FROM {rows}) GROUP BY node, f, x),
    c{level} AS (
      SELECT node, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
             sum(n) OVER a AS n, sum(s) OVER a AS s
      FROM v{level} WINDOW w AS (PARTITION BY node, f ORDER BY x), a AS (PARTITION BY node, f)),
    best{level} AS (
      SELECT node, f, x AS cut,
             sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS less
      FROM c{level} WHERE nl < n
      QUALIFY row_number() OVER (PARTITION BY node ORDER BY less DESC) = 1)
    """


@register(
    "forest_two_levels",
    f""", d AS (SELECT 0 AS node, order_month, order_day, sales FROM star WHERE NOT {_IN_TEST})
    """
    + _best_splits("0", "d")
    + """, e AS (
      SELECT CASE WHEN CASE f WHEN 'order_month' THEN order_month ELSE order_day END <= cut
                  THEN 1 ELSE 2 END AS node, order_month, order_day, sales
      FROM d, best0)
    """
    + _best_splits("1", "e")
    + """, gains AS (SELECT f, less FROM best0 UNION ALL SELECT f, less FROM best1)
    SELECT feature, round(coalesce(sum(less), 0) / (SELECT sum(less) FROM gains), 6) AS importance
    FROM (VALUES ('order_month'), ('order_day')) AS t(feature) LEFT JOIN gains ON f = feature
    GROUP BY feature
    """,
    star=True,
)
def forest_two_levels(spark, sf_dir):
    """Importances of one tree of three splits over two features, which SQL can grow too."""
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, _TWO_LEVELS.features), _TWO_LEVELS)
    return finish(fitted.importances(), importance=6)


# -- scoring ------------------------------------------------------------------

_SCENARIO_KEYS = ("division", "region", "ship_mode", "order_month", "quarter")

_SCENARIOS_SQL = """, g AS (
      SELECT division, region, ship_mode, order_month, quarter, max(units) AS units,
             round(min(unit_price), 4) AS unit_price, round(min(unit_cost), 4) AS unit_cost,
             min(abs(shipping_days)) AS shipping_days
      FROM star GROUP BY division, region, ship_mode, order_month, quarter)
    SELECT division, region, ship_mode, order_month, quarter, units, unit_price, unit_cost,
           shipping_days, round(units * (unit_price - unit_cost), 4) AS gross_profit,
           round(units * unit_cost, 4) AS cost, {more}
    FROM g
"""


def _scenarios(spark, sf_dir):
    """One what-if order per segment of the data, the largest and cheapest."""
    lines = star(spark, sf_dir).select(
        *_SCENARIO_KEYS, "units", "unit_price", "unit_cost", "shipping_days"
    )
    return lines.groupBy(*_SCENARIO_KEYS).agg(
        F.max("units").alias("units"),
        F.min("unit_price").alias("unit_price"),
        F.min("unit_cost").alias("unit_cost"),
        F.min(F.abs("shipping_days")).alias("shipping_days"),
    )


@register(
    "scenario_inputs",
    _SCENARIOS_SQL.format(
        more="""CAST(units BETWEEN 1 AND 200 AND unit_price BETWEEN 0.5 AND 50
           AND unit_cost BETWEEN 0.1 AND 20 AND shipping_days BETWEEN 1 AND 10 AS VARCHAR)
           AS in_range"""
    ),
    star=True,
)
def scenario_inputs(spark, sf_dir):
    derived = derive_scenarios(_scenarios(spark, sf_dir))
    return finish(derived.withColumn("in_range", F.col("in_range").cast("string")))


@register(
    "score_scenarios",
    _SCENARIOS_SQL.format(more="round(units * unit_price, 2) AS predicted_sales"),
    star=True,
)
def scored(spark, sf_dir):
    """The exact-fit linear model, saved and loaded, predicts units times price."""
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, _LEAKING.features), _LEAKING)
    path = scratch_path(spark, "model")
    save(fitted, path)
    out = score_scenarios(load(path), _scenarios(spark, sf_dir), _LEAKING.features)
    return finish(
        out.drop("in_range").withColumns(
            {c: F.col(c).cast("bigint") for c in ("order_month", "quarter", "shipping_days")}
        ),
        predicted_sales=2,
    )


@register("score_scenarios_forest")
def scored_forest(spark, sf_dir):
    config = ModelConfig("forest")
    fitted = _train(spark, sf_dir, _lines(spark, sf_dir, config.features), config)
    return score_scenarios(fitted.model, _scenarios(spark, sf_dir), config.features)
