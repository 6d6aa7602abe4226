"""Misread words snapped to a vocabulary, as joins: candidates that must share rare letters, then one ratio a pair."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.text import norm_unicode

#: Shortest canonical form that is compared.
SHORTEST = 4


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters by the characters of both; it depends on the order of the two."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _marks(form: Column) -> Column:
    """The letters of a word, repeats numbered, so that words share as many marks as they share letters."""
    letters = F.split(form, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i), lambda d: d == c)).cast("string")))


def _rarest_first(words: DataFrame, often: DataFrame) -> DataFrame:
    """(form, marks): the marks of each word, those that few words have first, in one order for all words."""
    each = words.select("form", F.explode(_marks(F.col("form"))).alias("mark")).join(often, "mark")
    ordered = each.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("often", "mark"))).alias("m"))  # the letters of a word
    return ordered.select("form", F.col("m.mark").alias("marks"))


def _keys(marked: DataFrame, cutoff: float) -> DataFrame:
    """(form, marks, key): marks one of which any two words share that are similar enough.

    Two words of n and m letters with ratio r share r(n + m)/2 letters, and m is at least r n/(2 - r); so a word can do
    without all but the first n - least + 1 of its marks in any order that holds for all words.
    """
    n = F.size("marks")
    least = F.ceil(cutoff * (n + cutoff * n / (2 - cutoff)) / 2 - 1e-9)
    return marked.select("form", "marks", F.explode(F.slice("marks", 1, (n - least + 1).cast("int"))).alias("key"))


def candidates(asked: DataFrame, offered: DataFrame, cutoff: float) -> DataFrame:
    """(form, other): the pairs of words (form) whose ratio can reach cutoff; none that does is missing.

    Keys are a word's rarest marks, by their number among all words of both sides, and the length of the other word: a
    text looks up each length that fits its own. What meets must share as many letters as the ratio asks for, which is
    counted before the letters' order is looked at.
    """
    both = asked.select("form").union(offered.select("form")).distinct()
    often = both.select(F.explode(_marks(F.col("form"))).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("often"))
    left, right = (_keys(_rarest_first(side, often), cutoff) for side in (asked, offered))
    n = F.size("marks")
    fits = F.sequence(F.ceil(cutoff * n / (2 - cutoff) - 1e-9).cast("int"), F.floor((2 - cutoff) * n / cutoff + 1e-9).cast("int"))
    left = left.withColumn("size", F.explode(fits))
    right = right.select(F.col("form").alias("other"), F.col("marks").alias("theirs"), "key", F.size("marks").alias("size"))
    shared = F.array_intersect("marks", "theirs")
    enough = 2 * F.size(shared) >= cutoff * (F.size("marks") + F.size("theirs")) - 1e-9
    # A pair may meet under several keys: it counts under the rarest mark that both have.
    first = F.get(shared, F.lit(0)) == F.col("key")
    return left.join(right, ["key", "size"]).where(enough & first).select("form", "other")


def snap(rows: DataFrame, text: str, options: DataFrame, option: str, name: str = "snapped", cutoff: float = 0.78, lead: float = 0.08) -> DataFrame:
    """rows with `name`: the option that the text nearly spells; null if none does, or two do about equally well.

    Texts and options are compared in canonical form, of four characters or more; of options with one form the smallest
    counts. Each distinct text is compared once, and only with options of a fitting length that share a key letter, which
    loses no pair at the cutoff. Of those at the cutoff or over it the two best are looked at, ties by the larger form.
    Null texts and an empty vocabulary snap to nothing; repeated rows keep their rows.
    """
    formed = lambda df, c: df.select(F.col(c).alias("given")).where("given is not null").distinct().withColumn("form", norm_unicode("given")).where(F.length("form") >= SHORTEST)
    known = formed(options, option).groupBy("form").agg(F.min("given").alias("option"))
    texts = formed(rows, text)
    asked, offered = texts.select("form").distinct(), known.select("form")
    scored = candidates(asked, offered, cutoff).withColumn("score", similarity("other", "form")).where(F.col("score") >= cutoff).withColumn("back", similarity("form", "other"))
    place = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("score"), F.desc("other")))  # limited before it is shuffled
    two = scored.withColumn("place", place).where("place <= 2")
    best = two.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("score", "other", "back")), asc=False).alias("best"))
    alone = (F.size("best") == 1) | (F.col("best")[0]["back"] - F.get("best", F.lit(1))["back"] > lead)
    chosen = best.where(alone).select("form", F.col("best")[0]["other"].alias("other")).join(known.withColumnRenamed("form", "other"), "other")
    answer = texts.join(chosen, "form").select(F.col("given").alias("__given"), F.col("option").alias(name))
    return rows.join(answer, F.col(text) == F.col("__given"), "left").drop("__given")
