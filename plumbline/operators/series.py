"""Counts by time, trends, grouped ranking, shares and unions of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("rising", "falling", "flat")


def count_by_time(rows: DataFrame, time: str, unit: str, *keys: str) -> DataFrame:
    """(keys, t, value): rows in each year, month or day that has any, t as text in ISO order."""
    shown = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit]
    return rows.groupBy(*keys, F.date_format(time, shown).alias("t")).agg(F.count(F.lit(1)).alias("value"))


def trend(series: DataFrame, *keys: str, flat: float = 0.0) -> DataFrame:
    """(keys, points, slope, pct, direction) of (keys, t, value).

    slope: least squares on the index 0, 1, ... of the bins in order of t; pct: change from the first bin to the last in
    percent, null if the first is 0 or there is no bin. A slope of at most `flat` either way, or of a single bin, is flat.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    at = series.withColumn("idx", (F.row_number().over(order) - 1).cast("double"))
    found = at.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.regr_slope("value", "idx"), F.lit(0.0)).alias("slope"),
        F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"),
    )
    direction = F.when(F.col("slope") > flat, "rising").when(F.col("slope") < -flat, "falling").otherwise("flat")
    pct = F.round(100 * F.try_divide(F.col("last") - F.col("first"), F.col("first")), 4)
    return found.select(*keys, "points", F.round("slope", 4).alias("slope"), pct.alias("pct"), direction.alias("direction"))


def diverging(trends: DataFrame, source: str) -> DataFrame:
    """Pairs (source_a, source_b) of a trend table whose directions differ, each pair once.

    A source is joined by each direction that is not its own, so only pairs of unlike directions meet; these are the
    result, whose size is up to a third of the square of the number of sources.
    """
    a = trends.select(F.col(source).alias("source_a"), F.col("direction").alias("direction_a"))
    b = trends.select(F.col(source).alias("source_b"), F.col("direction").alias("direction_b"))
    others = F.array_remove(F.array(*[F.lit(d) for d in DIRECTIONS]), F.col("direction_a"))
    return a.withColumn("direction_b", F.explode(others)).join(b, "direction_b").where("source_a < source_b").select("source_a", "direction_a", "source_b", "direction_b")


def top_groups(rows: DataFrame, group: str, top: int, within: str | None = None) -> DataFrame:
    """The `top` values of group by count, within each value of `within`; ties by the group's value."""
    keys = [within] if within else []
    counted = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(group))
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def share_of_total(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, part, total, share): the sum of value in each group and its share of all."""
    parts = rows.groupBy(group).agg(F.sum(value).alias("part"))
    total = parts.agg(F.sum("part").alias("total"))  # one row
    return parts.crossJoin(F.broadcast(total)).select(group, F.round("part", 2).alias("part"), F.round("total", 2).alias("total"), F.round(F.try_divide("part", "total"), 6).alias("share"))


def all_bases(**sources: DataFrame) -> DataFrame:
    """The same quantity from every source, one after the other, under its name in column basis."""
    labelled = [df.select(F.lit(name).alias("basis"), *df.columns) for name, df in sources.items()]
    out = labelled[0]
    for df in labelled[1:]:
        out = out.unionByName(df)
    return out
