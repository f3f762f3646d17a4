import os

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from martlens import session
from martlens.llm.inputs import read, ready
from martlens.sources.tables import materialize

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = read(ready(spark), SF, "documents")
    columns, before = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        results[name] = docs
        if name != "best-fit packing":
            assert docs.columns == columns and docs.count() <= before.count()
            assert docs.filter("n_chars != length(text)").isEmpty()
            before = docs
    by_name = {n: {r.doc_id: r.text for r in d.collect()} for n, d in results.items()
               if "text" in d.columns}
    accepted, cleaned, single = (
        by_name[n] for n in ("quality classifier", "line dedup", "SimHash near-dedup")
    )
    assert cleaned.keys() == accepted.keys() and cleaned != accepted
    assert single.items() <= cleaned.items() and len(single) < len(cleaned)
    unique = by_name["suffix-array dedup"]
    assert unique.keys() == single.keys() and sum(map(len, unique.values())) < sum(
        map(len, single.values()))
    total = results["best-fit packing"].agg(F.sum("length")).first()[0]
    again = corpus_pipeline.run(spark, SF)
    assert again.agg(F.sum("length")).first()[0] == total


def test_one_of_each_group_stays(spark):
    words = [f"word{i}" for i in range(60)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(5, text), (3, text), (None, text), (3, text), (None, other), (None, other), (9, None),
            (8, ""), (4, text + " "), (None, "something else entirely")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key")
    got = corpus_pipeline.near(spark, df, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(
        [(3, text), (None, other), (8, ""), (None, "something else entirely")], key=repr)


def test_stages_take_empty_and_null_rows(spark):
    docs = read(ready(spark), SF, "documents")
    null = F.lit(None)
    without = docs.limit(3).withColumn("text", null.cast("string"))
    unnamed = docs.limit(3).withColumn("doc_id", null.cast("bigint"))
    for rows in (docs.limit(0), without, unnamed):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name != "best-fit packing":
                assert out.columns == docs.columns and out.count() <= 3
            else:
                assert out.select("doc_id", "piece").count() >= (0 if rows.isEmpty() else 3)


# names that the operators use inside
CLASHING = ("id", "tag", "whole", "bucket", "key", "text_hash", "fp", "score", "predicted", "held_out",
            "c0", "c1", "kept", "spread", "doc", "deal", "component", "cuts", "n_lines")


def test_stages_keep_columns_of_any_name(spark):
    docs = read(ready(spark), SF, "documents").limit(40)
    extra = [F.lit(f"own {c}").alias(c) for c in CLASHING]
    rows = docs.select(*extra, "*")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, SF), stage(spark, rows, SF)
        assert more.columns == rows.columns, name
        kept = {(r.doc_id, r.text) for r in more.collect()}
        assert kept == {(r.doc_id, r.text) for r in plain.collect()}, name
        for r in more.collect():
            assert all(r[c] == f"own {c}" for c in CLASHING), name
    packing = corpus_pipeline.STAGES[-1][1]
    assert packing(spark, rows, SF).count() == packing(spark, docs, SF).count()


def test_a_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    monkeypatch.setattr(session, "shared_path", lambda _, label: f"{base}/{label}")
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0
    read_now = {os.path.dirname(f.removeprefix("file://")) for f in packed.inputFiles()}
    held = {os.path.join(base, x) for x in os.listdir(base)}
    assert read_now <= held and len(held) <= 2
