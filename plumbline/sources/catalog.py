"""Entities, the tables that hold them, and places."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.spatial import xy_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Connector:
    """How one route serves entities. load gives rows with at least `time` (a column or None) and the place columns."""

    route: str
    load: Callable[[SparkSession, str], DataFrame]
    time: str | None = None
    unit: str = "year"
    places: tuple[str, ...] = ()
    point: tuple[str, str] | None = None
    label: str = "observed"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").join(placed, F.col("o_custkey") == F.col("c_custkey"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xy_of(table(spark, sf_dir, "embeddings"))


ORDERS = Connector("orders", _orders, "o_orderdate", "year", ("n_name", "r_name"))
EVENTS = Connector("events", _events, "ts", "day")
POINTS = Connector("points", _points, point=("x", "y"))

#: entity -> its connector and the condition that picks its rows.
ENTITIES: dict[str, tuple[Connector, str]] = {
    "orders": (ORDERS, "true"),
    "open orders": (ORDERS, "o_orderstatus = 'O'"),
    "finished orders": (ORDERS, "o_orderstatus = 'F'"),
    "pending orders": (ORDERS, "o_orderstatus = 'P'"),
    **{f"{kind} events": (EVENTS, f"event_type = '{kind}'") for kind in ("click", "error", "purchase", "signup", "view")},
    "points": (POINTS, "true"),
    "anchors": (POINTS, "label = 0"),
}

#: Other spellings of places, by their normalised form; "" is everywhere.
ALIASES = {"world": "", "everywhere": "", "all nations": ""}


def normal_place(place: str) -> str:
    """Lower case, words joined by underscores, a trailing "region" or "nation" dropped."""
    words = place.lower().replace(",", " ").split()
    if len(words) > 1 and words[-1] in ("region", "nation"):
        words = words[:-1]
    name = " ".join(words)
    return ALIASES.get(name, "_".join(words))


def resolve_entity(name: str) -> tuple[str | None, list[str]]:
    """The entity that a name means, and the others that it might mean as well.

    An exact name is never ambiguous. Else all entities that have every word of the name fit, singular or plural; the
    first in the alphabet is taken, the rest are listed. (None, []) if none fits.
    """
    key = " ".join(name.lower().split())
    if key in ENTITIES:
        return key, []
    bare = lambda text: {w.removesuffix("s") for w in text.split()}
    fits = sorted(e for e in ENTITIES if key and bare(key) <= bare(e))
    return (fits[0], fits[1:]) if fits else (None, [])
