"""Spark's random forest for regression, grown with less to store and to add up.

Spark keeps a row as objects with four bytes per tree and, in each of many passes, adds it
up in sums scattered over memory.  ``ForestGrowth.java`` grows the same trees from rows of
bytes, one pass per level.  The compiler that Spark brings along for its own generated code
turns it into classes, which go to the executors as a jar.
"""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from importlib.resources import files

from pyspark.ml import regression
from pyspark.sql import DataFrame, SparkSession

# A bin is kept in a byte.
MOST_BINS = 256


def compiled(spark: SparkSession) -> tuple:
    """A grower on the driver, and the bytes of its classes by name."""
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(files("martlens.models").joinpath("ForestGrowth.java").read_text("utf-8"))
    grower = compiler.getClassLoader().loadClass("martlens.ForestGrowth").newInstance()
    return grower, {name: bytes(code) for name, code in compiler.getBytecodes().items()}


@lru_cache
def _growth(application: str):
    """The grower of an application, whose executors get its classes."""
    spark = SparkSession.active()
    grower, classes = compiled(spark)
    jar = f"{tempfile.mkdtemp(prefix=f'martlens-{application}-')}/martlens-forest.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for name, code in classes.items():
            out.writestr(f"{name.replace('.', '/')}.class", code)
    spark.sparkContext._jsc.addJar(jar)
    return grower


class RandomForestRegressor(regression.RandomForestRegressor):
    """As Spark's, with the same trees.

    ``maxMemoryInMB`` is how many MB of one tree's sums a pass gathers.  What the grower
    does not cover (a single tree, sub-samples, weights, feature subsets, bins beyond a
    byte, categories marked as such) is left to Spark.
    """

    def _fit_java(self, dataset: DataFrame):
        if not self._covered(dataset):
            return super()._fit_java(dataset)
        self._transfer_params_to_java()
        label = self.getLabelCol()
        rows = dataset.withColumn(label, dataset[label].cast("double"))
        spark = dataset.sparkSession
        return _growth(spark.sparkContext.applicationId).fit(self._java_obj, rows._jdf)

    def _covered(self, dataset: DataFrame) -> bool:
        marks = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {})
        return (
            self.getNumTrees() > 1
            and self.getBootstrap()
            and self.getSubsamplingRate() == 1.0
            and self.getFeatureSubsetStrategy() == "all"
            and self.getMaxBins() <= MOST_BINS
            and not self.isSet(self.weightCol)
            and not {"nominal", "binary"} & set(marks.get("attrs", {}))
        )
