"""From a plan to an answer: one lazy DataFrame, a label, and a record of every operator."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.spatial import within_distance
from plumbline.operators.series import count_by_time, top_groups, trend
from plumbline.plans.algebra import Aggregate, Compare, PlanError, Rank, Region, Relate, Select, holes, validate
from plumbline.sources.catalog import ENTITIES, Connector, normal_place, resolve_entity


@dataclass
class Answer:
    """data: rows, a series (t, value), a scalar (value) or a comparison; nothing has run yet.

    provenance: a record of every operator. With counts, each operator's rows are counted while data is computed, and
    counted() adds them once an action on data has ended.
    """

    kind: str
    data: DataFrame
    label: str
    provenance: list[dict] = field(default_factory=list)
    seen: list[Observation | None] = field(default_factory=list)
    status = "answer"

    def counted(self) -> list[dict]:
        """provenance with `rows` of every operator that makes rows; waits for the first action on data."""
        return [step | ({"rows": seen.get["rows"]} if seen else {}) for step, seen in zip(self.provenance, self.seen, strict=True)]


@dataclass
class Clarify:
    """The question left slots open."""

    holes: list[str]
    status = "clarify"


@dataclass
class DataRequest:
    """No source has the entity; operators above it never run."""

    entity: str
    hint: str
    provenance: list[dict]
    reason = "no_connector"
    status = "data_request"


class _NoConnector(Exception):
    pass


def compile_plan(spark: SparkSession, sf_dir: str, plan: object, counts: bool = False) -> Answer | Clarify | DataRequest:
    """The answer to a plan over the tables of sf_dir; raises PlanError for one that cannot mean anything.

    counts: whether to count each operator's rows; filters of later operators then stay above the counts.
    """
    if found := list(holes(plan)):
        return Clarify(found)
    validate(plan)
    build = _Builder(spark, sf_dir, counts)
    try:
        kind, data, connector = build.node(plan)
    except _NoConnector as e:
        return DataRequest(str(e), f"known entities: {', '.join(sorted(ENTITIES))}", build.steps)
    return Answer(kind, data, connector.label, build.steps, build.seen)


class _Builder:
    """One pass over a plan; steps and seen grow by one for every operator."""

    def __init__(self, spark: SparkSession, sf_dir: str, counts: bool):
        self.spark, self.sf_dir, self.counts = spark, sf_dir, counts
        self.steps: list[dict] = []
        self.seen: list[Observation | None] = []

    def step(self, rows: DataFrame | None, **record: object) -> DataFrame | None:
        self.steps.append(record)
        self.seen.append(None)
        if rows is None or not self.counts:
            return rows
        self.seen[-1] = Observation()
        return rows.observe(self.seen[-1], F.count(F.lit(1)).alias("rows"))

    def node(self, node: object) -> tuple[str, DataFrame, Connector]:
        if isinstance(node, Select):
            return self.select(node)
        if isinstance(node, Aggregate):
            _, rows, connector = self.node(node.source)
            if node.by == "space":
                return "scalar", self.step(rows.agg(F.count(F.lit(1)).alias("value")), op="AGGREGATE", by=node.by, metric=node.metric), connector
            if connector.time is None:
                raise PlanError(f"{connector.route} has no time to count by")
            return "series", self.step(count_by_time(rows, connector.time, connector.unit), op="AGGREGATE", by=node.by, metric=node.metric), connector
        if isinstance(node, Relate):
            _, left, connector = self.node(node.left)
            _, right, other = self.node(node.right)
            if not (connector.point and other.point):
                raise PlanError("RELATE within needs points on both sides")
            near = within_distance(left, right, node.threshold, connector.point, other.point)
            return "rows", self.step(near, op="RELATE", relation=node.relation, threshold=node.threshold), connector
        if isinstance(node, Compare):
            _, series, connector = self.node(node.left)
            note = "least-squares slope on the bin index; change from first to last bin"
            return "comparison", self.step(trend(series), op="COMPARE", how=node.how, note=note), connector
        if isinstance(node, Rank):
            _, rows, connector = self.node(node.source)
            return "rows", self.step(top_groups(rows, node.group, node.top, node.within), op="RANK", group=node.group, within=node.within, top=node.top), connector
        raise PlanError(f"{getattr(node, 'op', node)!r} cannot stand there")

    def select(self, node: Select) -> tuple[str, DataFrame, Connector]:
        entity, ambiguous = resolve_entity(node.entity)
        if entity is None:
            self.step(None, op="SELECT", route="none", ambiguous=ambiguous)
            raise _NoConnector(node.entity)
        connector, condition = ENTITIES[entity]
        rows = self.in_region(connector.load(self.spark, self.sf_dir).where(condition), connector, node.region)
        rows = _in_time(rows, connector, node.time)
        return "rows", self.step(rows, op="SELECT", route=connector.route, entity=entity, resolved=condition, time=node.time, ambiguous=ambiguous), connector

    def in_region(self, rows: DataFrame, connector: Connector, region: Region | None) -> DataFrame:
        if region is None:
            return rows
        place = normal_place(region.place)
        self.step(None, op="REGION", place=region.place, resolved=place or "everywhere")
        if not place:
            return rows
        if not connector.places:
            raise PlanError(f"{connector.route} has no places")
        match = F.lit(False)
        for column in connector.places:
            match |= F.lower(column) == place
        return rows.where(match)


def _bounds(written: str) -> tuple[datetime.date, datetime.date]:
    """The first day of a written year, month or day, and the first day after it."""
    try:
        parts = [int(x) for x in written.split("-")]
        first = datetime.date(*(parts + [1, 1])[:3])
        if len(parts) == 1:
            return first, datetime.date(first.year + 1, 1, 1)
        if len(parts) == 2:
            return first, datetime.date(first.year + first.month // 12, first.month % 12 + 1, 1)
        return first, first + datetime.timedelta(days=1)
    except (ValueError, TypeError):
        raise PlanError(f"time must be written as a year, month or day, not {written!r}") from None


def _in_time(rows: DataFrame, connector: Connector, time: tuple[str | None, str | None] | None) -> DataFrame:
    """Both ends inclusive, at the precision that they are written with: 1996, 1996-05 or 1996-05-17.

    The column itself is compared, so that the scan can skip what lies outside.
    """
    if time is None or connector.time is None:
        return rows
    at, (start, end) = F.col(connector.time), time
    if start:
        rows = rows.where(at >= F.lit(_bounds(start)[0]))
    if end:
        rows = rows.where(at < F.lit(_bounds(end)[1]))
    return rows


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a result whatever the order of its rows and columns: sums and exclusive-ors of row hashes."""
    key = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    mixed = F.bit_xor(F.xxhash64(key, F.lit("mixed")))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.hex(F.coalesce(F.bit_xor(key), F.lit(0))), F.hex(F.coalesce(mixed, F.lit(0))), F.sum(F.pmod(key, F.lit(1_000_003)))).alias("digest"))


def result_determinism(spark: SparkSession, sf_dir: str, plan: object, reps: int = 3) -> DataFrame:
    """(reps, distinct_results): how many different results a plan gives, computed anew `reps` times."""
    out = None
    for _ in range(reps):
        answer = compile_plan(spark, sf_dir, plan)
        one = row_digest(answer.data)
        out = one if out is None else out.unionByName(one)
    return out.agg(F.count(F.lit(1)).alias("reps"), F.count_distinct("rows", "digest").alias("distinct_results"))
