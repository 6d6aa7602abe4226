"""Scores of a candidate table against a golden one: cell by cell, by header, and as multisets of tokens.

A grid is a long table (form, row, col, value); col is the label, rows count from 0. A header is (form, pos, label, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import atoms, norm


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 4), F.lit(empty))


def judge_cells(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """(form, row, col, golden, got, verdict) of every golden cell: ok, miss, wrong or halluc.

    Cells that the candidate lacks count as empty; candidate cells beyond the golden shape are not looked at.
    """
    c = candidate.groupBy("form", "row", "col").agg(F.max("value").alias("c_value"))
    joined = golden.join(c, ["form", "row", "col"], "left").select("form", "row", "col", norm(F.col("value")).alias("golden"), norm(F.col("c_value")).alias("got"))
    verdict = (
        F.when(F.col("golden") == F.col("got"), "ok").when(F.col("golden") == "", "halluc")
        .when(F.col("got") == "", "miss").otherwise("wrong")
    )
    return joined.withColumn("verdict", verdict)


def cell_scores(judged: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of judged cells by keys. Accuracies are 1 where they have no cells, error rates 0."""
    filled, ok = F.col("golden") != "", F.col("verdict") == "ok"
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    n = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("match"), F.count_if(filled).alias("filled"), F.count_if(filled & ok).alias("filled_match"),
        F.count_if(~filled).alias("blank"), F.count_if(~filled & ok).alias("blank_match"), is_("halluc").alias("halluc"), is_("miss").alias("miss"), is_("wrong").alias("wrong"),
    )
    c = F.col
    return n.select(
        "*", _share(c("match"), c("total"), 1.0).alias("cell_acc"), _share(c("filled_match"), c("filled"), 1.0).alias("filled_recall"),
        _share(c("blank_match"), c("blank"), 1.0).alias("blank_acc"), _share(c("halluc"), c("blank"), 0.0).alias("halluc_rate"),
        _share(c("miss"), c("filled"), 0.0).alias("miss_rate"), _share(c("wrong"), c("filled"), 0.0).alias("wrong_rate"),
    )


def extra_rows(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """(form, extra_rows): how many more rows the candidate has than the golden table."""
    rows = lambda df, name: df.groupBy("form").agg((F.max("row") + 1).alias(name))
    both = rows(golden, "g").join(rows(candidate, "c"), "form", "left")
    return both.select("form", F.greatest(F.lit(0), F.coalesce("c", F.lit(0)) - F.col("g")).cast("long").alias("extra_rows"))


def header_scores(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """(form, labels, matched, header_acc). Labels meet in canonical form, blank ones are dropped, the last of equal ones counts."""

    def last(df: DataFrame, name: str) -> DataFrame:
        labelled = df.select("form", "pos", norm(F.col("label")).alias("label"), norm(F.col("value")).alias("v")).where("label <> ''")
        return labelled.groupBy("form", "label").agg(F.max_by("v", "pos").alias(name))

    both = last(golden, "g").join(last(candidate, "c"), ["form", "label"], "left")
    found = both.groupBy("form").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("g") == F.coalesce("c", F.lit(""))).alias("matched"))
    return found.withColumn("header_acc", _share(F.col("matched"), F.col("labels"), 1.0))


def multiset_scores(golden: DataFrame, candidate: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, cls, golden_total, candidate_total, common, recall, precision, f1) by token class and for `all`.

    Keys of the golden side; a side without tokens scores 1, and F1 is 0 where both are 0.
    """

    def bags(df: DataFrame, name: str) -> DataFrame:
        tokens = df.select(key, F.explode(atoms(F.col(text))).alias("a"))
        return tokens.groupBy(key, F.col("a.cls").alias("cls"), F.col("a.tok").alias("tok")).agg(F.count(F.lit(1)).alias(name))

    both = bags(golden, "g").join(bags(candidate, "c"), [key, "cls", "tok"], "full").fillna(0, ["g", "c"])
    known = golden.select(key).distinct()
    sums = both.groupBy(key, "cls").agg(F.sum("g").alias("g"), F.sum("c").alias("c"), F.sum(F.least("g", "c")).alias("m"))
    classes = F.explode(F.array(*[F.lit(x) for x in ("num", "word", "code")])).alias("cls")
    each = known.select(key, classes).join(sums, [key, "cls"], "left").fillna(0, ["g", "c", "m"])
    every = each.groupBy(key).agg(F.lit("all").alias("cls"), F.sum("g").alias("g"), F.sum("c").alias("c"), F.sum("m").alias("m"))
    r = F.coalesce(F.try_divide(F.col("m"), F.col("g")), F.lit(1.0))
    p = F.coalesce(F.try_divide(F.col("m"), F.col("c")), F.lit(1.0))
    f = F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0))
    rows = each.select(key, "cls", "g", "c", "m").unionByName(every.select(key, "cls", "g", "c", "m"))
    return rows.select(key, "cls", F.col("g").alias("golden_total"), F.col("c").alias("candidate_total"), F.col("m").alias("common"), F.round(r, 3).alias("recall"), F.round(p, 3).alias("precision"), F.round(f, 3).alias("f1"))
