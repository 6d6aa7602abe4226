"""Operators over ordered rows: islands, nesting depth, first regions, nearest fill, unique keys, smoothing, traces.

Each group is ordered by columns that tell its rows apart. Groups of more than `most` rows are cut into blocks along that
order; a block is summed up in one row, what earlier (or later) blocks hand on is found among these few rows, and blocks
are finished apart, so that no task has to hold or walk through a whole hot group.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

#: Rows of a group from which it is cut into blocks, and rows that are looked at for each cut.
MOST, _PICKS = 1_000_000, 50
#: Cuts that are broadcast at most; more of them meet the rows in a join by group.
_BROADCAST_CUTS = 100_000


def blocked(rows: DataFrame, group: str, order: list[str], most: int = MOST) -> DataFrame:
    """rows with __sq_block: 0, or for groups of more than `most` rows the number of the block along the order.

    Cuts are taken from rows chosen by hash, some for each block; where the order has ties, they stay in one block. Null
    is a group as any other. A row finds its block in two steps, among every so-manieth of its group's cuts and then
    among those in between, so with c cuts it takes about 2 * sqrt(c) comparisons. One count of the groups is made beforehand; without a hot one nothing else is added to the plan.
    """
    counted = rows.groupBy(F.col(group).alias("__sq_group")).agg(F.count(F.lit(1)).alias("__sq_n"))
    hot = counted.where(F.col("__sq_n") > most).withColumn("__sq_parts", F.ceil(F.col("__sq_n") / most).cast("int"))
    cuts = hot.agg(F.count(F.lit(1)).alias("groups"), F.sum("__sq_parts").alias("cuts")).first()
    if not cuts["groups"]:
        return rows.withColumn("__sq_block", F.lit(0))
    few = (lambda t: F.broadcast(t)) if cuts["cuts"] <= _BROADCAST_CUTS else (lambda t: t)
    key, same = F.struct(*[F.col(c) for c in order]), F.col(group).eqNullSafe(F.col("__sq_group"))
    chance = F.least(F.lit(1.0), _PICKS * F.col("__sq_parts") / F.col("__sq_n"))
    picked = rows.join(few(hot), same).where(F.pmod(F.xxhash64(group, *order), F.lit(1 << 40)) < chance * (1 << 40))
    all_ = picked.groupBy("__sq_group").agg(F.sort_array(F.collect_list(key)).alias("__sq_all"), F.first("__sq_parts").alias("__sq_parts"))  # _PICKS rows a block
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("__sq_parts") - 1, F.lit(1))), lambda k: F.get("__sq_all", F.floor(k * F.size("__sq_all") / F.col("__sq_parts")).cast("int")))
    # A row carries two arrays of about the square root of its group's cuts, one after the other, and never all of them.
    bounds = all_.select("__sq_group", at.alias("__sq_bounds")).withColumn("__sq_step", F.ceil(F.sqrt(F.size("__sq_bounds"))).cast("int"))
    last = F.floor(F.size("__sq_bounds") / F.col("__sq_step")).cast("int")
    wide = bounds.select("__sq_group", "__sq_step", F.transform(F.sequence(F.lit(1), last), lambda k: F.get("__sq_bounds", k * F.col("__sq_step") - 1)).alias("__sq_wide"))
    near = bounds.select(F.col("__sq_group").alias("__sq_of"), F.explode(F.sequence(F.lit(0), last)).alias("__sq_part"), "__sq_bounds", "__sq_step")
    near = near.select("__sq_of", "__sq_part", F.slice("__sq_bounds", F.col("__sq_part") * F.col("__sq_step") + 1, F.col("__sq_step")).alias("__sq_near"))
    placed = rows.join(few(wide), same, "left").withColumn("__sq_at", _not_above(F.col("__sq_wide"), key)).drop("__sq_group", "__sq_wide")
    placed = placed.join(few(near), F.col(group).eqNullSafe(F.col("__sq_of")) & (F.col("__sq_at") == F.col("__sq_part")), "left")
    block = F.col("__sq_at") * F.col("__sq_step") + _not_above(F.col("__sq_near"), key)
    return placed.withColumn("__sq_block", F.coalesce(block, F.lit(0))).drop("__sq_at", "__sq_step", "__sq_of", "__sq_part", "__sq_near")


def _not_above(bounds: Column, key: Column) -> Column:
    """How many of an array are at or below key; null for a null array. The key is made once, not for each comparison."""
    return F.when(bounds.isNotNull(), F.get(F.transform(F.array(key), lambda k: F.size(F.filter(bounds, lambda b: b <= k))), F.lit(0)))


def _windows(group: str, order: list[str]) -> tuple:
    """Windows over the rows of a block, over the blocks before one, and over those after it."""
    blocks = Window.partitionBy(group).orderBy("__sq_block")
    return Window.partitionBy(group, "__sq_block").orderBy(*order), blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)


def _with_summary(rows: DataFrame, summary: DataFrame, group: str) -> DataFrame:
    other = summary.withColumnRenamed(group, "__sq_group").withColumnRenamed("__sq_block", "__sq_of")
    return rows.join(other, F.col(group).eqNullSafe(F.col("__sq_group")) & (F.col("__sq_block") == F.col("__sq_of")), "left").drop("__sq_group", "__sq_of")


def islands(rows: DataFrame, group: str, order: list[str], value: str, most: int = MOST) -> DataFrame:
    """(group, island, value, n, first, last): maximal runs of equal neighbouring values; first and last are order[-1]."""
    cut = blocked(rows, group, order, most)
    w, before, _ = _windows(group, order)
    key, by = F.col(order[-1]), F.struct(*order)
    marked = cut.withColumn("__sq_change", F.when(F.row_number().over(w) == 1, 0).when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    ends = marked.groupBy(group, "__sq_block").agg(F.sum("__sq_change").alias("__sq_n"), F.min_by(F.struct(value), by).alias("__sq_head"), F.max_by(F.struct(value), by).alias("__sq_tail"))
    # A block's first row begins an island unless it goes on with the last value of the block before.
    previous = F.lag("__sq_tail").over(Window.partitionBy(group).orderBy("__sq_block"))
    ends = ends.withColumn("__sq_new", F.when(previous.eqNullSafe(F.col("__sq_head")), 0).otherwise(1))
    handed = ends.withColumn("__sq_base", F.coalesce(F.sum(F.col("__sq_n") + F.col("__sq_new")).over(before), F.lit(0)) + F.col("__sq_new")).select(group, "__sq_block", "__sq_base")
    numbered = _with_summary(marked.withColumn("__sq_own", F.sum("__sq_change").over(w)), handed, group).withColumn("island", F.col("__sq_base") + F.col("__sq_own"))
    return numbered.groupBy(group, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min_by(key, by).alias("first"), F.max_by(key, by).alias("last"))


def nesting(rows: DataFrame, group: str, order: list[str], begin: Column, end: Column, most: int = MOST) -> DataFrame:
    """rows with depth: +1 at each begin, -1 at each end, never under 0.

    The running sum less its lowest value so far (0 at most) is the same as stopping at 0; a block hands on its sum and
    its lowest value.
    """
    cut = blocked(rows, group, order, most).withColumn("__sq_step", F.when(begin, 1).when(end, -1).otherwise(0))
    w, before, _ = _windows(group, order)
    summed = cut.withColumn("__sq_sum", F.sum("__sq_step").over(w)).withColumn("__sq_low", F.min("__sq_sum").over(w))
    blocks = summed.groupBy(group, "__sq_block").agg(F.sum("__sq_step").alias("__sq_total"), F.min("__sq_low").alias("__sq_lowest"))
    blocks = blocks.withColumn("__sq_base", F.coalesce(F.sum("__sq_total").over(before), F.lit(0)))
    blocks = blocks.withColumn("__sq_floor", F.coalesce(F.min(F.col("__sq_base") + F.col("__sq_lowest")).over(before), F.lit(0))).select(group, "__sq_block", "__sq_base", "__sq_floor")
    lowest = F.least(F.lit(0), F.col("__sq_floor"), F.col("__sq_base") + F.col("__sq_low"))
    deep = _with_summary(summed, blocks, group).withColumn("depth", (F.col("__sq_base") + F.col("__sq_sum") - lowest).cast("long"))
    return deep.drop("__sq_block", "__sq_step", "__sq_sum", "__sq_low", "__sq_base", "__sq_floor")


def first_region(rows: DataFrame, group: str, order: list[str], begin: Column, end: Column) -> DataFrame:
    """The rows between the first begin and the first end after it, both left out; without an end, all after the begin.

    Two partial aggregates find the places, so no group is walked through.
    """
    key = F.struct(*[F.col(c) for c in order])
    same = lambda c: F.col(group).eqNullSafe(F.col(c))
    begins = rows.where(begin).groupBy(F.col(group).alias("__sq_bg")).agg(F.min(key).alias("__sq_begin"))
    begun = rows.join(begins, same("__sq_bg")).where(key >= F.col("__sq_begin"))
    ends = begun.where(end).groupBy(F.col(group).alias("__sq_eg")).agg(F.min(key).alias("__sq_end"))
    inside = begun.join(ends, same("__sq_eg"), "left").where(F.col("__sq_end").isNull() | (key < F.col("__sq_end")))
    return inside.where(~F.coalesce(begin, F.lit(False))).select(*rows.columns)


def nearest_fill(rows: DataFrame, group: str, order: list[str], value: str, name: str, most: int = MOST) -> DataFrame:
    """rows with `name`: value, or else that of the nearest row that has one (the earlier of two equally near)."""
    cut = blocked(rows, group, order, most)
    w, before, after = _windows(group, order)
    local = cut.withColumn("__sq_row", F.row_number().over(w))
    sizes = local.groupBy(group, "__sq_block").agg(F.count(F.lit(1)).alias("__sq_n"))
    sizes = sizes.withColumn("__sq_base", F.coalesce(F.sum("__sq_n").over(before), F.lit(0))).select(group, "__sq_block", "__sq_base")
    at = _with_summary(local, sizes, group).withColumn("__sq_at", F.col("__sq_base") + F.col("__sq_row"))
    at = at.withColumn("__sq_known", F.when(F.col(value).isNotNull(), F.struct(F.col("__sq_at").alias("at"), F.col(value).alias("value"))))
    blocks = at.groupBy(group, "__sq_block").agg(F.min("__sq_known").alias("__sq_first"), F.max("__sq_known").alias("__sq_last"))
    blocks = blocks.withColumn("__sq_earlier", F.max("__sq_last").over(before)).withColumn("__sq_later", F.min("__sq_first").over(after)).select(group, "__sq_block", "__sq_earlier", "__sq_later")
    both = _with_summary(at, blocks, group)
    both = both.withColumn("__sq_back", F.coalesce(F.last("__sq_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__sq_earlier")))
    both = both.withColumn("__sq_ahead", F.coalesce(F.first("__sq_known", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("__sq_later")))
    nearer = F.col("__sq_ahead").isNotNull() & (F.col("__sq_back").isNull() | (F.col("__sq_ahead.at") - F.col("__sq_at") < F.col("__sq_at") - F.col("__sq_back.at")))
    filled = both.withColumn(name, F.when(nearer, F.col("__sq_ahead.value")).otherwise(F.col("__sq_back.value")))
    return filled.drop("__sq_block", "__sq_row", "__sq_base", "__sq_at", "__sq_known", "__sq_earlier", "__sq_later", "__sq_back", "__sq_ahead")


def numbered(rows: DataFrame, group: str, order: list[str], name: str, most: int = MOST) -> DataFrame:
    """rows with `name`: the place of each in its group along the order, from 1 on; hot groups are numbered in blocks."""
    cut = blocked(rows, group, order, most)
    w, before, _ = _windows(group, order)
    local = cut.withColumn("__sq_row", F.row_number().over(w))
    sizes = local.groupBy(group, "__sq_block").agg(F.count(F.lit(1)).alias("__sq_n")).withColumn("__sq_base", F.coalesce(F.sum("__sq_n").over(before), F.lit(0))).select(group, "__sq_block", "__sq_base")
    return _with_summary(local, sizes, group).withColumn(name, F.col("__sq_base") + F.col("__sq_row")).drop("__sq_block", "__sq_row", "__sq_base")


def running(rows: DataFrame, group: str, order: list[str], amount: Column, name: str, most: int = MOST) -> DataFrame:
    """rows with `name`: the sum of amount (null counts as 0) in its group up to and with each row; order without ties."""
    cut = blocked(rows, group, order, most).withColumn("__sq_amount", F.coalesce(amount, F.lit(0)))
    w, before, _ = _windows(group, order)
    local = cut.withColumn("__sq_own", F.sum("__sq_amount").over(w))
    sums = local.groupBy(group, "__sq_block").agg(F.sum("__sq_amount").alias("__sq_n")).withColumn("__sq_base", F.coalesce(F.sum("__sq_n").over(before), F.lit(0))).select(group, "__sq_block", "__sq_base")
    return _with_summary(local, sums, group).withColumn(name, F.col("__sq_base") + F.col("__sq_own")).drop("__sq_block", "__sq_amount", "__sq_own", "__sq_base")


def unique_keys(rows: DataFrame, key: str, order: list[str], name: str = "key", most: int = MOST, modulo: int | None = None) -> DataFrame:
    """rows with `name`: the key, with an underscore for each earlier row that has the same one.

    Underscores of a key with n rows are about n * n / 2 characters. With `modulo` their number is shown modulo it, and
    the whole names are never formed; they tell the rows apart no more.
    """
    earlier = F.col("__sq_at") - 1
    placed = numbered(rows, key, order, "__sq_at", most)
    return placed.withColumn(name, F.concat(F.col(key), F.repeat(F.lit("_"), (earlier % modulo if modulo else earlier).cast("int")))).drop("__sq_at")


def smoothed(rows: DataFrame, group: str, order: list[str], value: str, name: str, low: float, high: float, start: float, keep: float = 0.7, most: int = MOST) -> DataFrame:
    """rows with `name`: an estimate that a value between low and high (both left out) pulls along, others leave as it is.

    After such a value v the estimate is keep * estimate + (1 - keep) * v, from `start` on in each group; null, NaN and
    far values change nothing. Each row is an affine map of the estimate, and so are rows in a row: with k values let
    through, a stretch hands on keep^k times what it was handed, and its own weighted sum. Stretches have so few values
    that powers of keep stay in range; what is handed to a stretch is summed from those before it up to the point where
    powers of keep vanish beside one, which bounds their number. So hot groups are cut into blocks as everywhere here.
    """
    if not 0 < keep < 1:
        raise ValueError("keep lies between 0 and 1")
    span = max(1, int(230 / -math.log(keep)))  # keep^span is about 1e-100
    v = F.col(value).cast("double")
    through = F.coalesce((v > low) & (v < high), F.lit(False))
    cut = blocked(rows, group, order, most).withColumn("__sq_in", through.cast("long"))
    w, before, _ = _windows(group, order)
    counted = cut.withColumn("__sq_own_k", F.sum("__sq_in").over(w))
    sizes = counted.groupBy(group, "__sq_block").agg(F.sum("__sq_in").alias("__sq_n")).withColumn("__sq_base", F.coalesce(F.sum("__sq_n").over(before), F.lit(0))).select(group, "__sq_block", "__sq_base")
    placed = _with_summary(counted, sizes, group).withColumn("__sq_k", F.col("__sq_base") + F.col("__sq_own_k"))
    placed = placed.withColumn("__sq_part", F.floor(F.greatest(F.col("__sq_k") - 1, F.lit(0)) / span))
    stretch = Window.partitionBy(group, "__sq_block", "__sq_part")
    placed = placed.withColumn("__sq_k0", F.min(F.col("__sq_k") - F.col("__sq_in")).over(stretch)).withColumn("__sq_r", F.col("__sq_k") - F.col("__sq_k0"))
    power = lambda k: F.pow(F.lit(float(keep)), k)
    added = F.sum(F.when(F.col("__sq_in") == 1, (1 - keep) * v * power(-F.col("__sq_r"))).otherwise(0.0)).over(stretch.orderBy(*order))
    placed = placed.withColumn("__sq_sum", added * power(F.col("__sq_r")))
    parts = placed.groupBy(F.col(group).alias("__sq_group"), "__sq_block", "__sq_part").agg(F.max("__sq_k").alias("__sq_end"), F.max("__sq_in").alias("__sq_any"), F.max_by("__sq_sum", F.struct(*order)).alias("__sq_last"))
    near = Window.partitionBy("__sq_group").orderBy("__sq_end").rangeBetween(-2 * span, 0)
    earlier = F.collect_list(F.struct(F.col("__sq_end").alias("k"), F.col("__sq_last").alias("b"))).over(near)
    handed = parts.where("__sq_any = 1").withColumn("__sq_near", earlier)
    summed = F.aggregate("__sq_near", start * power(F.col("__sq_end")), lambda s, x: s + x["b"] * power(F.col("__sq_end") - x["k"]))
    handed = handed.select("__sq_group", F.col("__sq_end").alias("__sq_from"), summed.alias("__sq_state"))
    both = placed.join(handed, F.col(group).eqNullSafe(F.col("__sq_group")) & (F.col("__sq_k0") == F.col("__sq_from")), "left")
    state = F.coalesce("__sq_state", F.lit(float(start)))
    return both.withColumn(name, power(F.col("__sq_r")) * state + F.col("__sq_sum")).select(*rows.columns, name)


def traced(rows: DataFrame, group: str, order: list[str], profile: str, name: str, start: int, window: int, least: float, most: int = 10_000) -> DataFrame:
    """rows with `name`: the place of a ridge that is followed from row to row, both ways along the order, and averaged.

    From the last place, the highest value of the row's profile within `window` places is the next one (the first of
    equal ones) if it exceeds `least`; else the place stays. Both ways begin at place `start`. All profiles have one
    length, at which the window ends; a null profile or value changes nothing.

    A row is a map from place to place, and rows in a row are one as well, so groups of over `most` rows are cut into
    blocks: each is walked from every place at once, the blocks' maps are put together in order, and each block is walked
    again from the place that is handed to it. The first walk hands on one short array a block.
    """
    cut = blocked(rows, group, order, most).withColumn("__sq_p", F.col(profile).cast("array<double>"))
    spread = lambda t: t.repartition(group, "__sq_block").sortWithinPartitions(group, "__sq_block", *order)
    kind = StructType([StructField("__sq_g", rows.schema[group].dataType), StructField("__sq_of", IntegerType()), *[StructField(c, ArrayType(IntegerType())) for c in ("ahead", "back")]])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), profiles in _blocks_of(batches):
            ends = [_walks(p, window, least) for p in (profiles, profiles[::-1])]
            yield pa.RecordBatch.from_arrays([pa.array([g], batches_type[0]), pa.array([block], pa.int32()), *[pa.array([e], pa.list_(pa.int32())) for e in ends]], kind.names)

    batches_type = [to_arrow_type(kind["__sq_g"].dataType)]
    met = spread(cut.select(group, "__sq_block", "__sq_p", *[c for c in order if c != group])).select(group, "__sq_block", "__sq_p").mapInArrow(maps, kind)
    # The blocks of a group, a row of two short arrays each, hand places on in both directions.
    through = lambda arrays: F.aggregate(arrays, F.lit(start), lambda at, m: F.coalesce(F.get(m, at), at))
    blocks = Window.partitionBy("__sq_g").orderBy("__sq_of").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("__sq_g").orderBy(F.col("__sq_of").desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("__sq_left", through(F.collect_list("ahead").over(blocks))).withColumn("__sq_right", through(F.collect_list("back").over(behind))).drop("ahead", "back")
    begun = spread(cut.join(met, F.col(group).eqNullSafe(F.col("__sq_g")) & (F.col("__sq_block") == F.col("__sq_of"))).drop("__sq_g", "__sq_of"))
    begun = begun.select(group, "__sq_block", "__sq_p", "__sq_left", "__sq_right", F.struct(*rows.columns).alias("__sq_row"))
    out = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()  # batches of rows whose block has not ended
        places: list[float] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting.append(batch)
                yield batch

        for (_, _, left, right), profiles in _blocks_of(seen(), [3, 4]):
            back = _follow(profiles[::-1], right, window, least)[::-1]
            places += [(a + b) / 2 for a, b in zip(_follow(profiles, left, window, least), back, strict=True)]
            while waiting and len(places) >= waiting[0].num_rows:
                batch = waiting.popleft()
                yield pa.RecordBatch.from_arrays([*batch.column(5).flatten(), pa.array(places[: batch.num_rows], pa.float64())], out.names)
                del places[: batch.num_rows]

    return begun.mapInArrow(follow, out)


def _blocks_of(batches: Iterator[pa.RecordBatch], more: list[int] = []) -> Iterator[tuple[tuple, list]]:  # noqa: B006
    """(key, profiles) for each run of rows with one group and block: columns 0 and 1, profiles in column 2."""
    key, profiles = None, []
    for batch in batches:
        for *at, p in zip(*(batch.column(k).to_pylist() for k in (0, 1, *more, 2)), strict=True):
            if profiles and tuple(at) != key:
                yield key, profiles
                profiles = []
            key = tuple(at)
            profiles.append(p)
    if profiles:
        yield key, profiles


def _next(profile: list | None, at: int, window: int, least: float) -> int:
    low = max(0, at - window)
    best, place = least, at
    for k, v in enumerate((profile or [])[low : at + window + 1], low):
        if v is not None and v > best:
            best, place = v, k
    return place


def _follow(profiles: list, at: int, window: int, least: float) -> list[int]:
    out = []
    for p in profiles:
        at = _next(p, at, window, least)
        out.append(at)
    return out


def _walks(profiles: list, window: int, least: float) -> list[int]:
    """Where a walk through the profiles ends, for each place that it may begin at."""
    ends = list(range(max((len(p) for p in profiles if p is not None), default=0)))
    for p in profiles:
        step = {at: _next(p, at, window, least) for at in set(ends)}  # walks that have met go on as one
        ends = [step[at] for at in ends]
    return ends
