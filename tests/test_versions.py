import threading

import pytest

from martlens.session import scratch_path
from martlens.sources.versions import Pointer, VersionedTable


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_contents_are_replaced_and_rolled_back(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"), "live_numbers")
    with pytest.raises(LookupError):
        table.read()
    table.publish(spark.range(3))
    with pytest.raises(LookupError, match="earlier"):
        table.roll_back()
    assert numbers(spark.table("live_numbers")) == [0, 1, 2]
    # the new contents may read the old ones
    table.publish(table.read().filter("id > 0"))
    assert numbers(spark.table("live_numbers")) == numbers(table.read()) == [1, 2]
    assert numbers(table.roll_back()) == numbers(spark.table("live_numbers")) == [0, 1, 2]
    spark.sql("DROP VIEW live_numbers")


def test_partitions_and_old_folders(spark):
    path = scratch_path(spark, "t")
    table = VersionedTable(spark, path, keep=2)
    for n in range(1, 6):
        got = table.publish(spark.range(n).selectExpr("id", "id % 2 AS odd"), ["odd"])
        assert sorted(r.odd for r in got.select("odd").distinct().collect()) == [0, 1][: min(n, 2)]
    assert table.pointer.numbers() == [4, 5]
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = [s.getPath().getName() for s in table.pointer._files.listStatus(files)]
    assert sum(x.startswith("data-") for x in held) == 2
    assert numbers(table.read().select("id")) == [0, 1, 2, 3, 4]


def test_a_reader_never_meets_a_gap(spark):
    """Readers by path and by name run all the while new versions are published."""
    table = VersionedTable(spark, scratch_path(spark, "t"), "busy_numbers", keep=3)
    table.publish(spark.range(10))
    stop, seen, failed = threading.Event(), [], []

    def look():
        while not stop.is_set():
            try:
                seen.append((table.read().count(), spark.table("busy_numbers").count()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    try:
        for n in range(11, 19):
            table.publish(spark.range(n))
    finally:
        stop.set()
        reader.join()
    assert not failed and len(seen) > 2
    assert all(10 <= a <= 18 and 10 <= b <= 18 for a, b in seen)
    spark.sql("DROP VIEW busy_numbers")


def test_a_job_that_breaks_off_changes_nothing(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"))
    table.publish(spark.range(4))
    with pytest.raises(Exception, match="broken"):
        table.publish(spark.range(9).selectExpr("raise_error('broken') AS id"))
    assert numbers(table.read()) == [0, 1, 2, 3]


def test_a_second_writer_is_refused(spark):
    path = scratch_path(spark, "t")
    one, two = Pointer(spark, path), Pointer(spark, path)
    one.publish({"folders": []})
    early = two.numbers()
    one.publish({"folders": []})
    two.numbers = lambda: early  # it looked before the other was done
    with pytest.raises(RuntimeError, match="another job"):
        two.publish({"folders": []})
    assert one.numbers() == [1, 2]
    with pytest.raises(ValueError):
        Pointer(spark, path, keep=0)
