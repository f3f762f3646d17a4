import datetime as dt
import os

import pytest

from martlens.session import scratch_path, scratch_scope
from martlens.sources import schemas, tables
from martlens.sources.readers import (
    conform,
    read_csv,
    read_csv_checked,
    read_csv_text,
    read_parquet,
    read_table,
)

SALES_HEAD = ",".join(schemas.SALES)
SALES_LINE = (
    '{id},US-1,2024-01-03,2024-01-05,Standard,C-1,"United States","New ""York""",NY,00501,'
    "Snacks,West,P-1,\"Bar, dark\",{sales},{units},1.5,2.0"
)


def write(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_names_types_quotes_and_zeros(spark, tmp_path):
    path = write(tmp_path, "s.csv", SALES_HEAD, SALES_LINE.format(id=7, sales="3.5", units="2"))
    df = read_csv(spark, path, schemas.SALES_TABLE)
    row = df.first()
    assert df.columns == [name for name, _ in schemas.SALES.values()]
    assert row["row_id"] == 7 and row["units"] == 2 and row["sales"] == 3.5
    assert row["city"] == 'New "York"' and row["product_name"] == "Bar, dark"
    assert row["postal_code"] == "00501"
    assert row["order_date"] == dt.datetime(2024, 1, 3)


@pytest.mark.parametrize("token", ["NA", "N/A", "", "nan", "null"])
def test_csv_missing_tokens(spark, tmp_path, token):
    line = SALES_LINE.format(id=1, sales=token, units="2")
    path = write(tmp_path, "s.csv", SALES_HEAD, line)
    assert read_csv(spark, path, schemas.SALES_TABLE).first()["sales"] is None


def test_csv_bad_number_stops(spark, tmp_path):
    path = write(tmp_path, "s.csv", SALES_HEAD, SALES_LINE.format(id=1, sales="much", units="2"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, path, schemas.SALES_TABLE).collect()


def test_csv_count_written_as_decimal(spark, tmp_path):
    path = write(tmp_path, "s.csv", SALES_HEAD, SALES_LINE.format(id=1, sales="1", units="2.0"))
    assert read_csv(spark, path, schemas.SALES_TABLE).first()["units"] == 2


def test_csv_columns_matched_by_name(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Note,Target,Division", "x,12.5,Drinks")
    row = read_csv(spark, path, schemas.TARGETS_TABLE).first()
    assert (row["division"], row["target"], row["Note"]) == ("Drinks", 12.5, "x")


def test_csv_line_break_in_quotes(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Division,Target", '"Sna\ncks",1')
    assert read_csv_text(spark, path, multiline=True).first()["Division"] == "Sna\ncks"


def test_missing_column_is_refused(spark, tmp_path):
    path = write(tmp_path, "t.csv", "Division,Goal", "Drinks,1")
    with pytest.raises(ValueError, match="Target"):
        read_csv(spark, path, schemas.TARGETS_TABLE)


def test_parquet_and_table_with_our_names(spark, tmp_path):
    df = spark.createDataFrame([("Drinks", 3)], "division string, target int")
    path = scratch_path(spark, "t")
    df.write.parquet(path)
    assert read_parquet(spark, path, schemas.TARGETS_TABLE).first()["target"] == 3.0
    tables.save_table(df, "targets_in_catalog", scratch_path(spark, "t"))
    assert read_table(spark, "targets_in_catalog", schemas.TARGETS_TABLE).dtypes == [
        ("division", "string"),
        ("target", "double"),
    ]


def test_conform_keeps_ntz(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS d, 'x' AS division, 1D AS target")
    assert conform(df, schemas.TARGETS_TABLE).dtypes[0] == ("d", "timestamp_ntz")


def test_replace_table_reading_itself(spark):
    spark.sql("DROP TABLE IF EXISTS swap_me")
    tables.replace_table(spark.range(10), "swap_me")
    out = tables.replace_table(spark.table("swap_me").filter("id < 3"), "swap_me")
    assert out.count() == 3
    assert spark.table("swap_me").count() == 3
    assert spark.table("swap_me_backup").count() == 10
    again = tables.replace_table(spark.table("swap_me").filter("id < 1"), "swap_me")
    assert again.count() == 1 and spark.table("swap_me_backup").count() == 3


def test_the_live_table_is_not_in_scratch(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS keep_me")
    spark.sql("DROP TABLE IF EXISTS keep_me_backup")
    home = f"file://{tmp_path}/home/first"
    tables.save_table(spark.range(10), "keep_me", home)
    with scratch_scope(spark):
        few = tables.materialize(spark.table("keep_me").filter("id < 3"))
        tables.replace_table(few, "keep_me")
        copies = few.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in copies)
    assert spark.table("keep_me").count() == 3
    assert all("/home/" in f for f in spark.table("keep_me").inputFiles())
    tables.replace_table(spark.table("keep_me").filter("id < 1"), "keep_me")
    assert sorted(os.listdir(tmp_path / "home")) != [] and not (tmp_path / "home/first").exists()


def test_a_swap_that_broke_off_is_put_right(spark):
    for name in ("broken", "broken_backup", "broken_fresh"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.replace_table(spark.range(10), "broken")
    spark.sql("ALTER TABLE broken RENAME TO broken_backup")  # between the two renames
    tables.recover_table(spark, "broken")
    assert spark.table("broken").count() == 10
    spark.sql("ALTER TABLE broken RENAME TO broken_backup")
    assert tables.replace_table(spark.range(4), "broken").count() == 4
    assert spark.table("broken_backup").count() == 10
    with pytest.raises(Exception, match="no_such_table"):
        tables.swap_tables(spark, "broken", "no_such_table", "broken_backup2")
    assert spark.table("broken").count() == 4


def test_files_of_another_column_order_are_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "Division,Target", "Drinks,1")
    write(tmp_path, "b.csv", "Target,Division", "2,Snacks")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path), schemas.TARGETS_TABLE).collect()


def test_a_count_with_a_fraction_stops_the_job(spark):
    spec = schemas.TableSpec("t", {"Units": ("units", "bigint")}, ("units",))
    for whole in ("'3.0'", "3D", "CAST(3 AS DECIMAL(9,2))"):
        assert conform(spark.sql(f"SELECT {whole} AS Units"), spec).first()["units"] == 3
    for cut in ("'2.9'", "2.9D", "CAST(2.9 AS DECIMAL(9,2))"):
        with pytest.raises(Exception, match="not a whole number"):
            conform(spark.sql(f"SELECT {cut} AS Units"), spec).collect()


def test_materialize(spark):
    assert tables.materialize(spark.range(100), "x", 4).count() == 100


class FakeSession:
    """A session whose cluster names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_scratch_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(FakeSession("yarn"), "x")


def test_scratch_of_a_local_master():
    one, two = (scratch_path(FakeSession("local[2]"), "x") for _ in range(2))
    assert one != two and os.path.dirname(one) == os.path.dirname(two)


def test_scratch_is_below_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_csv_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    good = SALES_LINE.format(id=1, sales="3.5", units="2.0")
    first = write(
        tmp_path, "a.csv", SALES_HEAD, good, SALES_LINE.format(id="x", sales="much", units="2"),
        "7,US-1", SALES_LINE.format(id=3, sales="NA", units=""),
    )
    second = write(
        tmp_path, "b.csv", SALES_HEAD, good.replace("2024-01-03", "soon"), good + ",extra",
        SALES_LINE.format(id=5, sales="1", units="2.5"), SALES_LINE.format(id=6, sales="1", units="9" * 25),
    )
    rows, rejects = read_csv_checked(spark, [first, second], schemas.SALES_TABLE)
    assert rows.dtypes == read_csv(spark, [first], schemas.SALES_TABLE).dtypes
    assert sorted((r["row_id"], r["sales"], r["units"]) for r in rows.collect()) == [
        (1, 3.5, 2), (3, None, None)
    ]
    found = {r["line"][:6]: (os.path.basename(r["file"]), r["reasons"]) for r in rejects.collect()}
    assert len(found) == rejects.count() - 1  # two lines begin alike
    assert found["x,US-1"] == (
        "a.csv", ["Row ID: not a bigint: x", "Sales: not a double: much"])
    assert found["7,US-1"] == ("a.csv", ["not 18 fields"])
    reasons = sorted(r["reasons"][0] for r in rejects.collect())
    assert reasons == sorted([
        "Row ID: not a bigint: x", "not 18 fields", "Order Date: not a timestamp: soon",
        "not 18 fields", "Units: not a bigint: 2.5", f"Units: not a bigint: {'9' * 25}",
    ])
    whole = next(r["line"] for r in rejects.collect() if r["line"].endswith("extra"))
    assert whole == good + ",extra"


def test_csv_without_rows_or_with_another_header(spark, tmp_path):
    empty = write(tmp_path, "e.csv", SALES_HEAD)
    rows, rejects = read_csv_checked(spark, empty, schemas.SALES_TABLE)
    assert rows.count() == rejects.count() == 0
    other = write(tmp_path, "o.csv", SALES_HEAD.replace("Sales", "Turnover"), "1,2")
    with pytest.raises(ValueError, match="Sales"):
        read_csv_checked(spark, other, schemas.SALES_TABLE)
