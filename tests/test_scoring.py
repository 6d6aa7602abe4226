"""The scorer's cases: canonical cells, perfect copies, blanks, shifted rows, missing and extra rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import norm, norm_unicode
from plumbline.operators import scoring

CELLS = [(" 23.0 ", "23"), ("23,5", "23.5"), ("23.5", "23.5"), (None, ""), ("  ", ""), ("Coburn", "coburn"), ("T  S", "t s"), ("0", "0"), ("0.0", "0"), ("+23", "23"), ("023", "23"), ("-0", "0"), ("-2.50", "-2.5"), ("1,234", "1.234"), ("1,234,567", "1,234,567"), ("1e5", "1e5")]


def test_canonical_cells(spark):
    df = spark.createDataFrame(CELLS, "cell string, want string")
    for r in df.select("want", norm(F.col("cell")).alias("plain"), norm_unicode("cell").alias("unicode")).collect():
        assert r.plain == r.want and r.unicode == r.want
    wide = spark.createDataFrame([("ＡＢ　Straße",)], "cell string").select(norm_unicode("cell")).first()
    assert wide[0] == "ab strasse"


def grid(spark, rows, form=1):
    cells = [(form, i, c, v) for i, row in enumerate(rows) for c, v in zip("abcde", row, strict=False)]
    return spark.createDataFrame(cells, "form int, row int, col string, value string")


def scores(spark, golden, candidate):
    return scoring.cell_scores(scoring.judge_cells(grid(spark, golden), grid(spark, candidate)), "form").first()


def test_perfect_copy(spark):
    s = scores(spark, [["a", "1", "x"], ["b", "2", "y"]], [["A ", "1.0", "x"], ["b", "2", "Y"]])
    assert (s.cell_acc, s.filled_recall, s.halluc_rate) == (1, 1, 0)


def test_blanks_and_invented_values(spark):
    s = scores(spark, [["x", None], [None, None]], [["x", "junk"], [None, "junk2"]])
    assert (s.filled_recall, s.halluc_rate, s.cell_acc) == (1, pytest.approx(2 / 3, abs=1e-4), 0.5)


def test_shifted_rows_keep_their_tokens_but_not_their_places(spark):
    golden = [["1", "asha", "12", "ok", "north"], ["2", "ravi", "15", "no", "south"]]
    shifted = [["asha", "12", "ok", "north", None], ["ravi", "15", "no", "south", None]]
    assert scores(spark, golden, shifted).cell_acc < 0.15
    text = lambda rows: spark.createDataFrame([(1, " ".join(v for r in rows for v in r if v))], "k int, text string")
    found = {r.cls: r for r in scoring.multiset_scores(text(golden), text(shifted), "k").collect()}
    assert found["all"].f1 > 0.75 and found["word"].f1 == 1 and found["code"].recall == 1


def test_missing_and_extra_rows(spark):
    s = scores(spark, [["x"], ["y"], ["z"]], [["x"]])
    assert s.filled_recall == pytest.approx(1 / 3, abs=1e-4) and s.miss_rate > 0.6
    golden, candidate = grid(spark, [["x"]]), grid(spark, [["x"], ["i"], ["j"]])
    assert scoring.extra_rows(golden, candidate).first().extra_rows == 2


def test_headers_by_label(spark):
    header = lambda pairs: spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "form int, pos int, label string, value string")
    found = scoring.header_scores(header([("Name", "A"), ("Ward", "1"), (" ", "x"), ("Date", None)]), header([("name ", "b"), ("NAME", "a"), ("ward", "2")])).first()
    assert (found.labels, found.matched) == (3, 2)
