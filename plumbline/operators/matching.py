"""Matching of two sets: mutual nearest neighbours by Hamming distance, and one-to-one pairs of points within a tolerance.

Both look at near pairs first and widen the search only for what is still open, so that neither makes all pairs of a set.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import sequences
from plumbline.storage import durable, rounds

#: Bits of a code at most: a distance (6 bits) and a code share one long.
MOST_BITS = 56


def _constant(values: list[int]) -> Column:
    """A constant array, written as one string so that the plan stays small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def nearest_codes(queries: DataFrame, targets: DataFrame, bits: int, block_bits: int = 16, most: int | None = None) -> DataFrame:
    """(code, near, distance): for each distinct code of queries the nearest code of targets, the smaller of equally near.

    Multi-index search. Codes are cut into blocks of about block_bits; targets are listed once by each block's value. In
    round s a query looks up the values that differ from its own in just s bits, one block after the other. Once block k
    of m is done, all targets within m * s + k bits are known, as only farther ones differ by more than s bits in blocks
    up to k and by s bits or more in the others; queries whose best is that near are done, the rest go on. Blocks should
    have about log2(number of targets) bits, so that a value lists few of them. A round's lookups grow with the queries
    that are still open; where most queries have no near target, as among random codes, many rounds are needed, and what
    is looked at grows faster than the queries. Queries with no
    target within `most` bits (all, by default) have no row; null codes are ignored; without targets there are no rows.
    """
    if not 0 < bits <= MOST_BITS:
        raise ValueError(f"codes have 1 to {MOST_BITS} bits")
    with rounds(queries.sparkSession) as keep:
        return durable(_searched(queries, targets, bits, block_bits, bits if most is None else most, keep))


def _searched(queries: DataFrame, targets: DataFrame, bits: int, block_bits: int, most: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    blocks = [(at, min(block_bits, bits - at)) for at in range(0, bits, block_bits)]
    value = lambda code, at, width: F.shiftright(code, at).bitwiseAND(F.lit((1 << width) - 1))
    known = keep(targets.select(F.col("code").cast("long").alias("near")).where("near is not null").distinct())
    listed = [known.select("near", F.lit(k).alias("block"), value(F.col("near"), at, width).alias("value")) for k, (at, width) in enumerate(blocks)]
    index = keep(_union(listed))
    none = F.lit(None).cast("long")
    # packed: the distance, then the code; its minimum is the nearest and smallest code.
    open_ = keep(queries.select(F.col("code").cast("long").alias("code")).where("code is not null").distinct().withColumn("best", none))
    if known.limit(1).count() == 0:
        return open_.select("code", none.alias("near"), F.lit(None).cast("int").alias("distance")).where("false")
    done = []
    for s in range(max(width for _, width in blocks) + 1):
        for k, (at, width) in enumerate(blocks):
            if comb(width, s):
                masks = [sum(1 << b for b in chosen) for chosen in combinations(range(width), s)]
                tried = open_.select("code", value(F.col("code"), at, width).alias("own"), F.explode(_constant(masks)).alias("mask")).select("code", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
                # The lookups are many times the rows they are made from, which Spark does not see: they are never broadcast.
                met = tried.join(index.where(F.col("block") == k).hint("merge"), "value")
                packed = F.shiftleft(F.bit_count(F.col("code").bitwiseXOR(F.col("near"))).cast("long"), MOST_BITS).bitwiseOR(F.col("near"))
                found = met.groupBy("code").agg(F.min(packed).alias("now"))
                open_ = keep(open_.join(found, "code", "left").select("code", F.least("best", "now").alias("best")))
            sure = len(blocks) * s + k
            near_enough = F.coalesce(F.shiftright("best", MOST_BITS) <= sure, F.lit(False))
            done.append(open_.where(near_enough))
            open_ = open_.where(~near_enough)
            if sure >= most or open_.limit(1).count() == 0:
                return _unpacked(_union([*done, open_]), most)
    return _unpacked(_union([*done, open_]), most)


def _unpacked(bests: DataFrame, most: int) -> DataFrame:
    distance = F.shiftright("best", MOST_BITS).cast("int")
    known = bests.where(F.col("best").isNotNull())
    return known.select("code", F.col("best").bitwiseAND(F.lit((1 << MOST_BITS) - 1)).alias("near"), distance.alias("distance")).where(F.col("distance") <= most)


def _union(tables: list[DataFrame]) -> DataFrame:
    first = tables[0]
    for other in tables[1:]:
        first = first.unionByName(other)
    return first


def mutual_nearest(left: DataFrame, right: DataFrame, bits: int, block_bits: int = 16, most: int | None = None) -> DataFrame:
    """(left_id, right_id, distance): the pairs of rows (id, code) each of which is the other's nearest.

    Of equally near codes the smallest counts, of rows with one code the one with the smallest id, null ids last. So each
    id is in one pair at most, and a third of all rows with one code cost what one row costs. Cases as in nearest_codes.
    """
    reps = [durable(side.where("code is not null").groupBy("code").agg(F.min("id").alias("id"))) for side in (left, right)]
    there = durable(nearest_codes(reps[0], reps[1], bits, block_bits, most))
    back = nearest_codes(there.select(F.col("near").alias("code")), reps[0], bits, block_bits, most)
    back = back.select(F.col("code").alias("near"), F.col("near").alias("code"))
    pairs = there.join(back, ["code", "near"])
    named = pairs.join(reps[0].select("code", F.col("id").alias("left_id")), "code")
    return named.join(reps[1].select(F.col("code").alias("near"), F.col("id").alias("right_id")), "near").select("left_id", "right_id", "distance")


#: Pairs of one place that a row stands for at most, where it is spread into rows of its own.
_SPREAD = 10_000


def match_points(left: DataFrame, right: DataFrame, tolerance: float, phases: int = 6, most: int = sequences.MOST) -> DataFrame:
    """(left_id, right_id, distance): one-to-one pairs of points (id, x, y) within tolerance, nearest pairs first.

    The result is that of taking all pairs of places by distance (then by the smallest id at the left place, then at the
    right) and matching what is still free at both, rows of one place in the order of their ids. It is found in rounds in
    which pairs that are each other's best are taken, for a radius that doubles from tolerance / 2^(phases - 1) on: pairs
    nearer than the radius are all settled before farther ones are looked at, so a crowded cell has few points left when
    the cells become large. Places are looked up in grid cells of the radius's size; rows of one place are one entry with
    a number. Points without coordinates or id match nothing; a pair at just the tolerance matches. Rounds in one radius
    follow the longest chain of points that each have a nearer neighbour than the one before; each writes only what is
    still free. Groups of over `most` rows of one place are numbered in blocks.
    """
    with rounds(left.sparkSession) as keep:
        return durable(_matched({"l": left, "r": right}, tolerance, phases, most, keep))


def _matched(sides: dict[str, DataFrame], tolerance: float, phases: int, most: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    distance = F.sqrt((F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")))
    places = {s: [f"{s}x", f"{s}y"] for s in sides}
    rows, free = {}, {}
    for s, points in sides.items():
        usable = points.where("id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
        rows[s] = keep(usable.select("id", *[(F.col(c).cast("double") + 0.0).alias(f"{s}{c}") for c in ("x", "y")]))
        free[s] = keep(rows[s].groupBy(*places[s]).agg(F.min("id").alias(f"{s}first"), F.count(F.lit(1)).alias(f"{s}n"), F.lit(0).cast("long").alias(f"{s}used")))
    order = F.struct("d", "lfirst", "rfirst", "lx", "ly", "rx", "ry")
    taken = []
    for phase in range(phases):
        radius = tolerance / 2 ** (phases - 1 - phase)
        cell = lambda v, r=radius: F.floor(F.col(v) / r)
        around = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
        spread = free["r"].withColumn("dx", around).withColumn("dy", around).withColumn("cx", cell("rx") + F.col("dx")).withColumn("cy", cell("ry") + F.col("dy")).drop("dx", "dy")
        pairs = keep(free["l"].withColumn("cx", cell("lx")).withColumn("cy", cell("ly")).join(spread, ["cx", "cy"]).drop("cx", "cy").withColumn("d", distance).where(F.col("d") <= radius))
        while pairs.limit(1).count():
            best = {s: pairs.groupBy(*places[s]).agg(F.min(order).alias(f"{s}best")) for s in sides}
            chosen = pairs.join(best["l"], places["l"]).join(best["r"], places["r"]).where((order == F.col("lbest")) & (order == F.col("rbest")))
            new = keep(chosen.select(*places["l"], *places["r"], "lused", "rused", "d", F.least(F.col("ln") - F.col("lused"), F.col("rn") - F.col("rused")).alias("k")))
            taken.append(new)
            for s in sides:
                pairs, free[s] = _still_free(pairs, new, s, places[s]), _still_free(free[s], new, s, places[s])
            pairs = keep(pairs)
        free = {s: keep(free[s]) for s in free}
    if not taken:
        return rows["l"].select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0.0).alias("distance")).where("false")
    # The rows of a place take its pairs in turn: the k-th row of the left place meets the k-th of the right one.
    each = keep(_union(taken)).withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(_SPREAD).cast("long"))))
    each = each.repartition("lx", "ly", "begin").withColumn("j", F.explode(F.sequence("begin", F.least(F.col("begin") + _SPREAD, F.col("k")) - 1)))
    each = each.select("lx", "ly", (F.col("lused") + F.col("j")).alias("lat"), "rx", "ry", (F.col("rused") + F.col("j")).alias("rat"), F.col("d").alias("distance"))
    for s, name in (("l", "left_id"), ("r", "right_id")):
        placed = sequences.numbered(rows[s].withColumn("place", F.struct(*places[s])), "place", ["id"], f"{s}at", most)
        each = each.join(placed.select(*places[s], (F.col(f"{s}at") - 1).alias(f"{s}at"), F.col("id").alias(name)), [*places[s], f"{s}at"])
    return each.select("left_id", "right_id", "distance")


def _still_free(table: DataFrame, new: DataFrame, s: str, place: list[str]) -> DataFrame:
    """table with what the new pairs used at their places of one side, without places that have nothing left."""
    used = new.select(*place, (F.col(f"{s}used") + F.col("k")).alias("now"))
    grown = table.join(used, place, "left").withColumn(f"{s}used", F.coalesce("now", f"{s}used")).drop("now")
    return grown.where(F.col(f"{s}used") < F.col(f"{s}n"))
