import duckdb
import numpy as np
import pytest

from martlens.llm.linededup import drop_common_lines
from martlens.llm.perfecthash import MinimalHash
from martlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, least, chars=1):
    def key(line):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
        return low.strip(" \t\n\v\f\r")

    held = {}
    for number, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            # rows of one id are one document, rows without an id one each
            held.setdefault(key(line), set()).add(("row", number) if i is None else i)
    gone = {k for k, d in held.items() if len(k) >= chars and len(d) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


ROWS = [
    (1, "Common\nown 1\n\n É"), (2, " common \t\nOWN 2\n"), (3, "COMMON\nCOMMON\nrare"),
    (4, None), (5, ""), (None, "common\né"), (6, "É\nrare"), (6, "É\nrare"), (7, "é\n" * 50),
]


@pytest.mark.parametrize("least, chars", [(2, 1), (4, 1), (2, 2), (3, 5), (100, 1)])
def test_against_brute_force(spark, least, chars):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = drop_common_lines(df, least, chars, bucket_bytes=40, shard_rows=3)
    assert result(got) == brute(ROWS, least, chars)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, f"only of one\nown {k % 5}") for k in range(12)] + [(2, "x\nown 1")]
    rows += [(None, "without id")] * 12
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (16 << 20, 100):
        got = drop_common_lines(df, 10, bucket_bytes=bucket, shard_rows=4)
        assert result(got) == brute(rows, 10)
    assert {r.text for r in got.filter("doc_id = 1").collect()} > {"only of one\nown 0"}
    assert {r.n_dropped for r in got.filter("doc_id IS NULL").collect()} == {1}
    con = duckdb.connect()
    con.register("given", df.filter("doc_id IS NOT NULL").toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    # the query's SQL counts the same documents: no line of one id alone is common
    assert {r[2] for r in con.execute(ORACLE["op7_line_dedup"]).fetchall()} == {0}


def test_equal_rows_are_dealt_over_buckets(spark):
    rows = [(None, "")] * 400 + [(7, "same\ntext")] * 300 + [(k, f"same\nline {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_common_lines(df, 3, bucket_bytes=500, shard_rows=10)
    assert result(got) == brute(rows, 3)


def test_other_columns_stay(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.selectExpr("'b' AS bucket", "doc_id", "text", "2L AS hi", "length(text) AS n_chars",
                       "9 AS n_lines", "3.5D AS c1")
    got = drop_common_lines(df, 4)
    assert got.columns == ["bucket", "doc_id", "text", "hi", "n_chars", "c1", "n_lines",
                           "n_dropped", "kept_sha256"]
    rows = got.collect()
    assert all(r.n_chars == len(r.text) and (r.bucket, r.hi, r.c1) == ("b", 2, 3.5) for r in rows)


def test_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op7_line_dedup"]).fetchall())
    got = QUERIES["op7_line_dedup"](spark, SF)
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 20_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    built = MinimalHash.build(hi, lo)
    again = MinimalHash.from_bytes(built.to_bytes())
    assert sorted(again.slots(hi, lo).tolist()) == list(range(n))
    assert (built.slots(hi, lo) == again.slots(hi, lo)).all()
    assert len(built.to_bytes()) < 8 * n + 700


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        MinimalHash.build(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_a_very_long_text_and_line(spark):
    line = "long " * 100_000
    rows = [(k, f"{line}\n" + "\n".join(f"{k} {i}" for i in range(20_000))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_common_lines(df, 3, bucket_bytes=1 << 16)
    assert {(r.n_lines, r.n_dropped) for r in got.collect()} == {(20_001, 1)}
