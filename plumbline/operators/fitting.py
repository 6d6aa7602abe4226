"""Numbers of groups that sums alone do not give: exact percentiles, lines that outliers do not bend, shares with a floor.

Groups may be of any size: what is computed of them are partial aggregates and running sums over blocks, and what comes
out, a row a group, is broadcast to the rows only where its rows have been counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sequences import MOST, running
from plumbline.storage import durable, rounds

#: Rows of one row a group that are broadcast at most.
_BROADCAST_GROUPS = 100_000


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _beside(rows: DataFrame, group: str, found: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of found, which has one written row for each __ft_g."""
    few = F.broadcast(found) if found.limit(_BROADCAST_GROUPS + 1).count() <= _BROADCAST_GROUPS else found
    return rows.join(few, F.col(group).eqNullSafe(F.col("__ft_g")), how).drop("__ft_g")


def percentiles(rows: DataFrame, group: str, value: str, fractions: list[float], name: str = "percentiles", most: int = MOST) -> DataFrame:
    """(group, name): the exact percentiles of each group's values, an array in the order of the fractions.

    A percentile between two values lies on the line between them. Nulls and NaN are left out; a group of nothing else has
    no row, null is a group as any other. Equal values are counted first, and the ranks where the counts end are running
    sums; no task holds the values of a whole group. rows are read once: the counts are written, and go when the result,
    one row a group, is there.
    """
    if not all(0 <= q <= 1 for q in fractions):
        raise ValueError("fractions lie between 0 and 1")
    v = F.col(value).cast("double")
    with rounds(rows.sparkSession) as keep:
        counted = keep(rows.where(_usable(v)).groupBy(F.col(group).alias("__ft_g"), v.alias("__ft_v")).agg(F.count(F.lit(1)).alias("__ft_n")))
        whole = keep(counted.groupBy("__ft_g").agg(F.sum("__ft_n").alias("__ft_all")))
        ranked = running(counted.withColumnRenamed("__ft_g", "__ft_own"), "__ft_own", ["__ft_v"], F.col("__ft_n"), "__ft_end", most)
        placed = _beside(ranked, "__ft_own", whole)
        at = [(F.col("__ft_all") - 1) * F.lit(float(q)) for q in fractions]
        held = lambda rank: F.max(F.when((F.col("__ft_end") - F.col("__ft_n") <= rank) & (rank < F.col("__ft_end")), F.col("__ft_v")))
        ends = [e for k, p in enumerate(at) for e in (held(F.floor(p)).alias(f"__ft_low{k}"), held(F.ceil(p)).alias(f"__ft_high{k}"))]
        met = placed.groupBy("__ft_own").agg(F.first("__ft_all").alias("__ft_all"), *ends)
        each = [F.col(f"__ft_low{k}") + (F.col(f"__ft_high{k}") - F.col(f"__ft_low{k}")) * (p - F.floor(p)) for k, p in enumerate(at)]
        return durable(met.select(F.col("__ft_own").alias(group), F.array(*each).alias(name)))


def robust_lines(rows: DataFrame, group: str, x: str, y: str, refits: int = 1, share: float = 0.8, near: float = 4.0, least: int = 4, most: int = MOST) -> DataFrame:
    """(group, n, used, intercept, slope): the line y = intercept + slope * x of each group, fitted again without what lies far off.

    A first least-squares fit takes all points. Each refit takes those whose distance in y is under the larger of `near`
    and the `share` percentile of all distances, and keeps the line that there is where fewer than `least` are left. Points
    without x or y are left out; a group of fewer than `least` points, or with one x only, has null for a line.

    A fit is one aggregate (sums of squares about the mean, merged between tasks), a refit is two: the percentile and the
    fit. rows are read once: points and the lines between rounds are written, and go when the result is there.
    """
    with rounds(rows.sparkSession) as keep:
        return durable(_fitted(rows, group, x, y, refits, share, near, least, most, keep))


def _fitted(rows: DataFrame, group: str, x: str, y: str, refits: int, share: float, near: float, least: int, most: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    at, to = F.col(x).cast("double"), F.col(y).cast("double")
    points = keep(rows.where(_usable(at) & _usable(to)).select(F.col(group).alias("__ft_of"), at.alias("__ft_x"), to.alias("__ft_y")))
    fit = [F.count(F.lit(1)).alias("__ft_used"), F.regr_intercept("__ft_y", "__ft_x").alias("__ft_a"), F.regr_slope("__ft_y", "__ft_x").alias("__ft_b")]
    lines = keep(points.groupBy(F.col("__ft_of").alias("__ft_g")).agg(F.count(F.lit(1)).alias("__ft_n"), *fit))
    for _ in range(refits):
        off = _beside(points, "__ft_of", lines.where(F.col("__ft_n") >= least)).withColumn("__ft_off", F.abs(F.col("__ft_a") + F.col("__ft_b") * F.col("__ft_x") - F.col("__ft_y")))
        limits = keep(percentiles(off, "__ft_of", "__ft_off", [share], "__ft_q", most).select(F.col("__ft_of").alias("__ft_g"), F.greatest(F.lit(float(near)), F.col("__ft_q")[0]).alias("__ft_limit")))
        kept = _beside(off.select("__ft_of", "__ft_x", "__ft_y", "__ft_off"), "__ft_of", limits).where(F.col("__ft_off") < F.col("__ft_limit"))
        again = kept.groupBy(F.col("__ft_of").alias("__ft_again")).agg(*[c.alias(f"__ft_new{k}") for k, c in enumerate(fit)])
        new = F.col("__ft_new0") >= least
        better = [F.coalesce(F.when(new & F.col("__ft_new2").isNotNull(), F.col(f"__ft_new{k}")), F.col(c)).alias(c) for k, c in enumerate(("__ft_used", "__ft_a", "__ft_b"))]
        lines = keep(lines.join(again, F.col("__ft_g").eqNullSafe(F.col("__ft_again")), "left").select("__ft_g", "__ft_n", *better))
    enough = F.col("__ft_n") >= least
    line = [F.when(enough & F.col("__ft_b").isNotNull(), F.col(c)).alias(n) for c, n in (("__ft_a", "intercept"), ("__ft_b", "slope"))]
    return lines.select(F.col("__ft_g").alias(group), F.col("__ft_n").alias("n"), F.col("__ft_used").alias("used"), *line)


def shares_with_floor(rows: DataFrame, group: str, weight: str, total: float, floor: float, name: str) -> DataFrame:
    """rows with `name`: each row's share of `total` by weight within its group, none under `floor`.

    What rows under the floor get more is taken from those above it, in proportion to what they have above it. Weights that
    are null, NaN or negative count as 0; where all are 0, shares are equal. A group with more rows than the total has
    floors for gets null throughout. Two aggregates give a group's weight and what lies above its floors; rows then meet
    one row a group.
    """
    w = F.col(weight).cast("double")
    own = rows.withColumn("__ft_w", F.when(_usable(w), F.greatest(w, F.lit(0.0))).otherwise(0.0))
    sums = own.groupBy(F.col(group).alias("__ft_g")).agg(F.sum("__ft_w").alias("__ft_sum"), F.count(F.lit(1)).alias("__ft_n"))
    plain = F.when(F.col("__ft_sum") > 0, F.col("__ft_w") * total / F.col("__ft_sum")).otherwise(total / F.col("__ft_n"))
    above = F.greatest(plain - floor, F.lit(0.0))
    # What rows of one group and weight have above the floor is the same: they are counted before they meet the sums.
    alike = own.groupBy(F.col(group).alias("__ft_own"), "__ft_w").agg(F.count(F.lit(1)).alias("__ft_same"))
    excess = alike.join(sums, F.col("__ft_own").eqNullSafe(F.col("__ft_g"))).groupBy("__ft_g").agg(F.first("__ft_n").alias("__ft_n"), F.first("__ft_sum").alias("__ft_sum"), F.sum(above * F.col("__ft_same")).alias("__ft_above"))
    both = own.join(excess, F.col(group).eqNullSafe(F.col("__ft_g")))
    left = F.lit(float(total)) - floor * F.col("__ft_n")
    share = F.when(left < 0, None).when(F.col("__ft_above") > 0, floor + above * left / F.col("__ft_above")).otherwise(floor + left / F.col("__ft_n"))
    return both.withColumn(name, share).select(*rows.columns, name)
