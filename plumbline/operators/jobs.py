"""Planning of resumable jobs: products, what is left to do, first-seen and top-n choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_grid(*sides: DataFrame) -> DataFrame:
    """Every combination of small tables such as models, questions and repetitions; the size is the point of it."""
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(side)
    return out


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str], retry_errors: bool = False, min_bytes: int | None = None) -> DataFrame:
    """The jobs without a result in done.

    A failed result counts as done unless retry_errors (column error is not null); with min_bytes, results of that size
    or smaller (column bytes) do not count.
    """
    if retry_errors:
        done = done.where("error is null")
    if min_bytes is not None:
        done = done.where(F.col("bytes") > min_bytes)
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def prunable(target: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """Names of target that source does not have."""
    return target.select(name).join(source.select(name).distinct(), name, "left_anti")


def with_prior(jobs: DataFrame, prior: DataFrame, keys: list[str], value: str) -> DataFrame:
    """jobs with the earlier value, and a status that says whether there is one; none are dropped."""
    joined = jobs.join(prior.select(*keys, value), keys, "left")
    return joined.withColumn("status", F.when(F.col(value).isNull(), "no source run").otherwise("ready"))


def first_seen(rows: DataFrame, name: Column, *order: str) -> DataFrame:
    """Of rows with equal names the first in order; only the best row so far of each name leaves a task."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(name.alias("__name")).agg(F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return best.select("__row.*")


def top_per_group(rows: DataFrame, group: str, n: int, total: int, *order: str) -> DataFrame:
    """At most n rows of each group and then at most `total` of all, both in order.

    Spark cuts each task's rows to n of a group before the shuffle, as the rank is compared with a constant.
    """
    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
    return kept.orderBy(*order).limit(total)


def newest_first(rows: DataFrame, created: str, *ties: str, most: int | None = None) -> DataFrame:
    """rows by descending time, a missing one counting as 0, at most `most` of them."""
    ordered = rows.orderBy(F.coalesce(F.col(created), F.lit(0)).desc(), *ties)
    return ordered if most is None else ordered.limit(most)


def acceptable(name: Column, size: Column, suffix: str, low: int = 5_000, high: int = 2_000_000) -> Column:
    """Whether a file has the suffix, is no lock file of an editor (~$...) and has a size in the band, ends included."""
    return F.coalesce(size.between(low, high) & F.lower(name).endswith(suffix) & ~name.startswith("~$"), F.lit(False))


def balanced_sample(rows: DataFrame, kind: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of each kind in an order by hash, the same at every run."""
    order = Window.partitionBy(kind).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def agreement(runs: DataFrame, keys: list[str], *answers: str) -> DataFrame:
    """(keys, reps, distinct_answers, agree) of repeated runs: whether all repetitions gave the same answers."""
    found = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("reps"), F.count_distinct(F.struct(*answers)).alias("distinct_answers"))
    return found.where("reps > 1").withColumn("agree", F.col("distinct_answers") == 1)
