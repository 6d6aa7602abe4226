"""Bounded state of a stream over restarts, and XLSX files as a data source."""

import json

import pytest

from plumbline.sources import readers, workbooks
from plumbline.streaming import recent
from tests.test_sources import _book

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def test_the_newest_entries_survive_a_restart_and_go_when_silent(rocks, tmp_path):
    spark, told = rocks, []
    (tmp_path / "in").mkdir()

    def take(name, rows):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"k": k, "t": t, "i": i}) + "\n" for k, t, i in rows))
        stream = spark.readStream.schema("k string, t timestamp, i string").json(str(tmp_path / "in"))
        found = recent.newest_by_key(stream, "k", "t", "i", 3, 3_600_000, "10 minutes")
        out = {}
        query = found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query = query.foreachBatch(lambda df, _: told.extend(df.collect())).start()
        query.awaitTermination()
        for r in told:
            out[r.key] = (r.ids, r.silent)
        told.clear()
        return out

    at = lambda m: f"2024-01-01T{10 + m // 60:02d}:{m % 60:02d}:00Z"
    first = [("a", at(m), f"e{m}") for m in (4, 1, 3, 2)] + [("b", at(0), "x"), ("b", at(0), "y"), ("b", at(0), "x"), (None, at(1), "n"), ("a", None, "n"), ("a", at(1), None)]
    assert take("one", first) == {"a": (["e4", "e3", "e2"], False), "b": (["y", "x"], False)}
    # A new query goes on from the checkpoint: a late but not too late entry, one that is known, and a key of many rows.
    assert take("two", [("a", at(5), "e5"), ("a", at(4), "e4"), *[("c", at(6), f"{k:05d}") for k in range(5000)]]) == {"a": (["e5", "e4", "e3"], False), "c": (["04999", "04998", "04997"], False)}
    # An hour and the lateness on, what fell silent is told once and its state is gone.
    got = take("three", [("d", at(5 + 60 + 10), "z")])
    assert got["d"] == (["z"], False) and got["a"] == ([], True) and got["b"] == ([], True) and "c" not in got
    assert take("four", [("a", at(90), "again")])["a"] == (["again"], False)


def test_nothing_can_not_be_held(rocks):
    stream = rocks.readStream.format("rate").load()
    with pytest.raises(ValueError):
        recent.newest_by_key(stream, "value", "timestamp", "value", 0, 1, "1 minute")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    _book(tmp_path / "a.xlsx", {"table": [["S.No", "Name"], ["1", "Asha"], [None, None]], "header": [["Date", "01-02-2025"], [" ", None]]})
    _book(tmp_path / "deep/b.xlsx", {"Sheet1": [["x"], [None], ["y"]]})
    (tmp_path / "c.xlsx").write_text("no workbook")
    (tmp_path / "d.txt").write_text("other")
    return str(tmp_path)


def test_the_source_reads_what_the_readers_read(spark, folder):
    workbooks.register(spark)
    whole = lambda df: sorted(("/" + r.path.removeprefix("file:").lstrip("/"), *r[1:]) for r in df.collect())
    read = lambda part: spark.read.format("workbook").option("part", part)
    assert whole(read("cells").load(folder)) == whole(readers.workbook_cells(spark, folder)) != []
    assert whole(read("grid").load(folder)) == whole(readers.grids(spark, folder)) != []
    assert whole(read("grid").load(f"file://{folder}")) == whole(readers.grids(spark, folder))
    assert whole(read("cells").load(f"{folder}/a.xlsx")) == [r for r in whole(readers.workbook_cells(spark, folder)) if r[0].endswith("a.xlsx")]
    few = read("cells").schema("value string, row int").load(folder)
    assert few.columns == ["value", "row"] and sorted(few.where("row = 0 and value > 'T'").collect()) == [("x", 0)]


def test_files_make_tasks_and_filters_choose_files(spark, folder, tmp_path):
    workbooks.register(spark)
    read = spark.read.format("workbook").option("bytes_per_task", 1)
    assert read.load(folder).rdd.getNumPartitions() == 3  # with the broken one
    assert spark.read.format("workbook").load(folder).rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = spark.read.format("workbook").option("bytes_per_task", 1).option("filters", "true").load(folder).where(f"path = '{folder}/deep/b.xlsx' and row = 0")
        assert [(r.sheet, r.value) for r in one.collect()] == [("Sheet1", "x")] and one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "none").mkdir()
    assert read.load(str(tmp_path / "none")).count() == 0
    for wrong in (read.option("part", "pages"), spark.read.format("workbook").schema("colour string")):
        with pytest.raises(Exception, match="part is one of|no columns"):
            wrong.load(folder).count()
