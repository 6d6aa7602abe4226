"""Points: neighbours within a distance, farthest pairs, dense cells and dispersion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def xy_of(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The first two components of a vector as planar coordinates x and y."""
    return vectors.withColumn("x", F.get(column, F.lit(0)).cast("double")).withColumn("y", F.get(column, F.lit(1)).cast("double"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    """Great-circle distance of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_distance(left: DataFrame, right: DataFrame, limit: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The rows of left with a row of right at `limit` or less, found through grid cells of that size.

    Points without coordinates have no neighbours. Each right cell is looked up from the nine cells around a left point.
    """
    lx, ly = (F.col(c) for c in left_xy)
    cell = lambda v: F.floor(v / limit)
    near = right.select(F.col(right_xy[0]).alias("__rx"), F.col(right_xy[1]).alias("__ry")).where("__rx is not null and __ry is not null").distinct()
    steps = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    spread = near.withColumn("__dx", steps).withColumn("__dy", steps)
    spread = spread.select("__rx", "__ry", (cell(F.col("__rx")) + F.col("__dx")).alias("__cx"), (cell(F.col("__ry")) + F.col("__dy")).alias("__cy"))
    close = (cell(lx) == F.col("__cx")) & (cell(ly) == F.col("__cy")) & (distance(lx, ly, F.col("__rx"), F.col("__ry")) <= limit)
    return left.join(spread, close, "left_semi")


def within_km_of_edges(points: DataFrame, edges: DataFrame, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The rows of points at `km` kilometres or less from an edge, such as the shore of a lake.

    points: columns `lat` and `lon` in degrees; edges: lat1, lon1, lat2, lon2. The nearest place of an edge is found on a
    plane about the point, its distance by haversine, so edges should be short beside the earth. Edges are spread over
    the grid cells that they can reach, and each point looks into its own cell. Rows without coordinates are near nothing;
    edges across the 180th meridian must be cut there.
    """
    step = km / 111.0  # a little more than km, in degrees of latitude
    p_lat, p_lon = F.col(lat).cast("double"), F.col(lon).cast("double")
    cell = lambda v: F.floor(v / step).cast("long")
    ends = edges.select(*[F.col(c).cast("double").alias(f"__{c}") for c in ("lat1", "lon1", "lat2", "lon2")]).dropna().distinct()
    wide = step / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("__lat1"), F.abs("__lat2")) + step)))
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    spread = ends.withColumn("__cy", F.explode(F.sequence(cell(low("__lat1", "__lat2") - step), cell(high("__lat1", "__lat2") + step))))
    spread = spread.withColumn("__cx", F.explode(F.sequence(cell(low("__lon1", "__lon2") - wide), cell(high("__lon1", "__lon2") + wide))))
    shrink = F.cos(F.radians(p_lat))
    ax, ay = (F.col("__lon1") - p_lon) * shrink, F.col("__lat1") - p_lat
    dx, dy = (F.col("__lon2") - F.col("__lon1")) * shrink, F.col("__lat2") - F.col("__lat1")
    along = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    n_lat, n_lon = F.col("__lat1") + t * (F.col("__lat2") - F.col("__lat1")), F.col("__lon1") + t * (F.col("__lon2") - F.col("__lon1"))
    near = (cell(p_lat) == F.col("__cy")) & (cell(p_lon) == F.col("__cx")) & (haversine_km(p_lat, p_lon, n_lat, n_lon) <= km)
    # Spark sees the number of edges, not of their cells, and would broadcast them.
    return points.join(spread.hint("merge"), near, "left_semi")


def _cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _hull(points: pd.DataFrame) -> pd.DataFrame:
    """The convex hull of columns x and y, counter-clockwise, of equal points the one with the smallest id.

    Where all points are equal, the two with the smallest ids.
    """
    ordered = points.sort_values(["x", "y", "id"])
    p = ordered.drop_duplicates(["x", "y"])
    if len(p) == 1:
        return ordered.drop_duplicates("id").head(2)
    rows = list(p[["x", "y"]].itertuples(index=False, name=None))

    def chain(order: range) -> list[int]:
        kept: list[int] = []
        for i in order:
            while len(kept) > 1 and _cross(rows[kept[-2]], rows[kept[-1]], rows[i]) <= 0:
                kept.pop()
            kept.append(i)
        return kept

    n = len(rows)
    lower, upper = chain(range(n)), chain(range(n - 1, -1, -1))
    return p.iloc[[*lower[:-1], *upper[:-1]]]


def _farthest(hull: pd.DataFrame) -> tuple[int, int, float]:
    """The farthest pair of a hull: pairs of corners that two parallel lines can touch, walked around once."""
    rows, ids = list(hull[["x", "y"]].itertuples(index=False, name=None)), hull["id"].tolist()
    m, k, pairs = len(rows), 1, set()
    for i in range(m):
        j = (i + 1) % m
        steps = 0
        while steps < m and _cross(rows[i], rows[j], rows[(k + 1) % m]) > _cross(rows[i], rows[j], rows[k]):
            k, steps = (k + 1) % m, steps + 1
        pairs |= {(e, (k + d) % m) for e in (i, j) for d in (-1, 0, 1)}  # its neighbours too, for parallel sides and rounding
    found = []
    for a, b in pairs:
        if ids[a] != ids[b]:
            (ax, ay), (bx, by) = rows[a], rows[b]
            found.append((-(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) ** 0.5), min(ids[a], ids[b]), max(ids[a], ids[b])))
    d, a, b = min(found)
    return a, b, -d


#: Hull points of all groups that a task holds before it sends them on.
_HELD = 200_000


def farthest_pairs(points: DataFrame, group: str, id_col: str, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(group, id_a, id_b, dist): the two points of each group that are farthest apart; a single point gives no row.

    Both lie on the group's convex hull, so tasks first shrink their rows to hulls and only hull points meet, where one
    walk around the hull finds the pair. Points may coincide: if all of a group do, the pair is of the two smallest ids
    and its distance 0. Ties go to the smallest ids; points without coordinates or group are left out.
    """
    kind = points.schema[group].dataType.simpleString()
    rows = points.select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(xy[0]).cast("double").alias("x"), F.col(xy[1]).cast("double").alias("y")).dropna()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for g, own in batch.groupby("g"):
                held[g] = _hull(pd.concat([held[g], own]) if g in held else own)
            if sum(map(len, held.values())) > _HELD:
                yield pd.concat(held.values())
                held = {}
        if held:
            yield pd.concat(held.values())

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf)
        found = [(pdf["g"].iloc[0], *_farthest(hull))] if len(hull) > 1 else []
        return pd.DataFrame(found, columns=["g", "id_a", "id_b", "d"])

    hulls = rows.mapInPandas(local, f"g {kind}, id long, x double, y double")
    best = hulls.groupBy("g").applyInPandas(pair, f"g {kind}, id_a long, id_b long, d double")
    return best.select(F.col("g").alias(group), "id_a", "id_b", F.round("d", 6).alias("dist"))


def cell_counts(points: DataFrame, size: float, xy: tuple[str, str] = ("x", "y"), *keys: str) -> DataFrame:
    """(keys, cell_x, cell_y, n) of the square cells with edge `size`."""
    cells = [F.floor(F.col(c) / size).alias(n) for c, n in zip(xy, ("cell_x", "cell_y"), strict=True)]
    return points.dropna(subset=list(xy)).groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("n"))


def densest_cells(points: DataFrame, size: float, top: int = 1, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The `top` cells with most points; ties by the lower cell."""
    return cell_counts(points, size, xy).orderBy(F.col("n").desc(), "cell_x", "cell_y").limit(top)


def best_per_cell(points: DataFrame, size: float, score: str, id_col: str, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """The row of each cell with the smallest score, ties by id."""
    cells = [F.floor(F.col(c) / size) for c in xy]
    order = Window.partitionBy(*cells).orderBy(score, id_col)
    return points.dropna(subset=list(xy)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dispersion(points: DataFrame, group: str, cell: float, top: int = 3, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(group, n, std_x, std_y, mean_dist, top_share): spread about the centroid, share of points in the `top` cells."""
    x, y = (F.col(c) for c in xy)
    rows = points.dropna(subset=list(xy))
    centre = rows.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("std_x"), F.stddev_pop(y).alias("std_y"))
    spread = rows.join(centre, group).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.first("std_x"), 6).alias("std_x"), F.round(F.first("std_y"), 6).alias("std_y"),
        F.round(F.avg(distance(x, y, F.col("mx"), F.col("my"))), 6).alias("mean_dist"),
    )
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), "cell_x", "cell_y")
    heads = cell_counts(rows, cell, xy, group).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    share = heads.groupBy(group).agg(F.sum("n").alias("in_top"))
    return spread.join(share, group).select(group, "n", "std_x", "std_y", "mean_dist", F.round(F.col("in_top") / F.col("n"), 6).alias("top_share"))
