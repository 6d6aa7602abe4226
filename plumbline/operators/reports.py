"""Evaluation reports: run summaries, grouped means with totals, threshold sweeps, histograms, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.fitting import percentiles


def run_report(rows: DataFrame, key: str, metric: str, verdict: str, bucket: str, latency: str | None = None) -> DataFrame:
    """(key, n, n_error, mean, n_bucket, bucket_mean, bucket_min, mean_latency) of result rows with a column `error`.

    Means are over rows without error; those of an empty bucket are null; zero latencies are left out.
    """
    good = F.col("error").isNull()
    inside = good & (F.col(verdict) == bucket)
    of = lambda cond, c: F.when(cond, F.col(c))
    timed = F.round(F.avg(of(good & (F.col(latency) > 0), latency)), 4) if latency else F.lit(None).cast("double")
    return rows.groupBy(key).agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("n_error"), F.round(F.avg(of(good, metric)), 4).alias("mean"),
        F.count_if(inside).alias("n_bucket"), F.round(F.avg(of(inside, metric)), 4).alias("bucket_mean"), F.round(F.min(of(inside, metric)), 4).alias("bucket_min"), timed.alias("mean_latency"),
    )


def run_summary(rows: DataFrame, metrics: list[str], verdict: str = "verdict", latency: str | None = None) -> DataFrame:
    """One row: n, n_error, the mean of each metric over rows without error, verdicts (of all rows), mean latency.

    verdicts: a map from verdict to number of rows, those without one under "?". Latencies that are 0 or missing are left
    out. An empty table has n 0, an empty map and null means.
    """
    good = F.col("error").isNull()
    timed = F.avg(F.when(F.col(latency) > 0, F.col(latency))) if latency else F.lit(None).cast("double")
    means = [F.round(F.avg(F.when(good, F.col(m))), 4).alias(m) for m in metrics]
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("n_error"), *means, F.round(timed, 4).alias("mean_latency"))
    each = rows.groupBy(F.coalesce(verdict, F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    counted = each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "c")))).alias("verdicts"))  # one entry a verdict
    return whole.crossJoin(F.broadcast(counted)).select("n", "n_error", *metrics, "verdicts", "mean_latency")


def iqr_cut(rows: DataFrame, group: str, value: str, factor: float = 3.0, slack: float = 4.0) -> DataFrame:
    """rows whose value is under the group's median + factor x (interquartile range + slack); exact percentiles."""
    q = F.col("__q")
    limits = percentiles(rows, group, value, [0.25, 0.5, 0.75], "__q").select(F.col(group).alias("__g"), (q[1] + factor * (q[2] - q[0] + slack)).alias("__limit"))
    return rows.join(limits, F.col(group).eqNullSafe(F.col("__g"))).where(F.col(value) < F.col("__limit")).drop("__g", "__limit")


def means_with_all(rows: DataFrame, keys: list[str], kind: str, kinds: list[str], ok: str) -> DataFrame:
    """One row per keys: the mean of ok for each kind in columns, and ALL; null where there is nothing. One scan."""
    mean = lambda c: F.round(F.avg(c), 4)
    value = F.col(ok).cast("double")
    return rows.groupBy(*keys).agg(*[mean(F.when(F.col(kind) == k, value)).alias(k) for k in kinds], mean(value).alias("ALL"))


def fixed_width(rows: DataFrame, **widths: int) -> DataFrame:
    """(line): the named columns as text, each padded or cut to its width; numbers to the right, all else to the left."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    cell = lambda c, n: F.lpad(text(c), n, " ") if kinds[c] in ("int", "bigint", "double", "float") or kinds[c].startswith("decimal") else F.rpad(text(c), n, " ")
    return rows.select(F.concat_ws(" ", *[cell(c, n) for c, n in widths.items()]).alias("line"))


def threshold_sweep(rows: DataFrame, value: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """(threshold, fn, fp, fn_rate, fp_rate, balanced_acc, best): predicted positive from the threshold on.

    best marks the first threshold with the highest balanced accuracy. The data is read once: each row adds to the
    thresholds through a small constant array.
    """
    marked = rows.select(F.col(value).alias("v"), truth.alias("y")).where("v is not null and y is not null")
    flat = marked.select("v", "y", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit = F.col("v") >= F.col("threshold")
    n = flat.groupBy("threshold").agg(F.count_if(F.col("y") & ~hit).alias("fn"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    rates = n.withColumn("fn_rate", F.coalesce(F.try_divide("fn", "pos"), F.lit(0.0))).withColumn("fp_rate", F.coalesce(F.try_divide("fp", "neg"), F.lit(0.0)))
    scored = rates.select("threshold", "fn", "fp", F.round("fn_rate", 6).alias("fn_rate"), F.round("fp_rate", 6).alias("fp_rate"), F.round(1 - (F.col("fn_rate") + F.col("fp_rate")) / 2, 6).alias("balanced_acc"))
    top = scored.agg(F.max_by("threshold", F.struct("balanced_acc", -F.col("threshold"))).alias("top"))  # one row
    return scored.crossJoin(F.broadcast(top)).select("threshold", "fn", "fp", "fn_rate", "fp_rate", "balanced_acc", (F.col("threshold") == F.col("top")).alias("best"))


def histogram(rows: DataFrame, key: str, known: list[str] | None = None) -> DataFrame:
    """(key, n), largest first; with `known`, exactly those values, zeros included."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if known is not None:
        names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
        counted = F.broadcast(names).join(counted, key, "left").fillna(0, ["n"])
    return counted.orderBy(F.col("n").desc(), key)


def inventory(rows: DataFrame, *levels: str, size: str) -> DataFrame:
    """(levels, files, bytes) of every group, of every prefix of levels, and of all; null stands for "all"."""
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


def ablation(rows: DataFrame, arm: str, kind: str, value: str) -> DataFrame:
    """(kind, mean of each arm 0 and 1, gain)."""
    mean = lambda a: F.round(F.avg(F.when(F.col(arm) == a, F.col(value))), 4)
    both = rows.groupBy(kind).agg(mean(0).alias("without"), mean(1).alias("with_it"))
    return both.withColumn("gain", F.round(F.col("with_it") - F.col("without"), 4))
