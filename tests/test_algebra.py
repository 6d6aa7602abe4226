import pytest
from pyspark.sql import functions as F

from plumbline.plans.algebra import Aggregate, Compare, PlanError, Rank, Region, Relate, Select, canonical, from_json, holes, to_json
from plumbline.plans.compile import Answer, Clarify, DataRequest, compile_plan

COUNT = {"op": "AGGREGATE", "by": "space", "metric": "count", "source": {"op": "SELECT", "entity": "open orders", "region": {"op": "REGION", "place": "Asia region"}, "time": {"start": "1996", "end": "1998"}}}
TREND = {"op": "COMPARE", "how": "trend_direction", "left": {"op": "AGGREGATE", "by": "time", "metric": "count", "source": {"op": "SELECT", "entity": "error events"}}}


def test_json_round_trip_and_canonical_form():
    for tree in (COUNT, TREND):
        plan = from_json(tree)
        assert from_json(to_json(plan)) == plan
        assert canonical(plan) == canonical(from_json(dict(reversed(tree.items()))))


def test_count_by_place_and_inclusive_years(spark, sf):
    answer = compile_plan(spark, sf, from_json(COUNT))
    assert isinstance(answer, Answer) and answer.kind == "scalar" and answer.label == "observed"
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'O' and year(o_orderdate) between 1996 and 1998")
    placed = orders.join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    assert answer.data.first().value == placed.where("c_nationkey % 5 = 2").count()
    assert [s["op"] for s in answer.provenance] == ["REGION", "SELECT", "AGGREGATE"]


def test_filters_and_columns_reach_the_scan(spark, sf):
    answer = compile_plan(spark, sf, from_json(TREND))
    plan = answer.data._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan and "ReadSchema: struct<ts:timestamp" in plan and "props" not in plan


def test_trend_of_four_known_bins(spark):
    from plumbline.operators.series import trend

    series = spark.createDataFrame([("2019", 55), ("2020", 25), ("2021", 7), ("2022", 3)], "t string, value long")
    found = trend(series).first()
    assert (found.points, found.slope, round(found.pct, 1), found.direction) == (4, -17.4, -94.5, "falling")
    zero = trend(spark.createDataFrame([("2019", 0), ("2020", 5)], "t string, value long")).first()
    assert zero.pct is None and zero.direction == "rising"
    assert trend(series.limit(1)).first().direction == "flat"


def test_a_hole_stops_the_plan(spark, sf):
    plan = Aggregate("space", "count", Select("?proxy", Region("?place")))
    assert list(holes(plan)) == ["?proxy", "?place"]
    found = compile_plan(spark, sf, plan)
    assert isinstance(found, Clarify) and found.status == "clarify"


def test_an_unknown_entity_is_a_data_request_and_nothing_above_it_runs(spark, sf):
    found = compile_plan(spark, sf, Aggregate("space", "count", Select("street lights", time=("last year", None))))
    assert isinstance(found, DataRequest) and found.reason == "no_connector" and [s["op"] for s in found.provenance] == ["SELECT"]


@pytest.mark.parametrize("plan", [
    Relate("within", Select("points"), Select("anchors")), Relate("near", Select("points"), Select("anchors"), 1.0), Compare("trend_direction", Select("orders")),
    Aggregate("space", "median", Select("orders")), Aggregate("time", "count", Select("points")), Relate("within", Select("orders"), Select("anchors"), 1.0),
    Aggregate("space", "count", Select("error events", Region("Asia"))),
])
def test_plans_that_cannot_mean_anything_are_rejected(spark, sf, plan):
    with pytest.raises(PlanError):
        compile_plan(spark, sf, plan)


@pytest.mark.parametrize("tree", [{"op": "GUESS"}, {"op": "SELECT"}, {"op": "SELECT", "entity": "orders", "colour": "red"}])
def test_malformed_trees_are_rejected(tree):
    with pytest.raises(PlanError):
        from_json(tree)


def test_rank_within_groups(spark, sf):
    rows = compile_plan(spark, sf, Rank("event_type", 1, Select("error events"))).data.collect()
    assert [(r.event_type, r["rank"]) for r in rows] == [("error", 1)]


def test_rows_are_counted_while_an_answer_is_computed(spark, sf):
    plan = Aggregate("space", "count", Select("open orders", Region("Asia region"), ("1996", "1998-06")))
    answer = compile_plan(spark, sf, plan, counts=True)
    value = answer.data.first().value
    steps = answer.counted()
    assert [(s["op"], s.get("rows")) for s in steps] == [("REGION", None), ("SELECT", value), ("AGGREGATE", 1)]
    assert "rows" not in compile_plan(spark, sf, plan).counted()[1]


def test_names_that_fit_several_entities_say_so(spark, sf):
    answer = compile_plan(spark, sf, Aggregate("space", "count", Select("Error event")))
    assert answer.provenance[0]["entity"] == "error events" and answer.provenance[0]["ambiguous"] == []
    step = compile_plan(spark, sf, Aggregate("space", "count", Select("events"))).provenance[0]
    assert step["entity"] == "click events" and step["ambiguous"] == ["error events", "purchase events", "signup events", "view events"]
    assert compile_plan(spark, sf, Select("tides")).status == "data_request"


@pytest.mark.parametrize("time", [("1996", None), (None, "1996"), ("1996-02", "1996-12"), ("1996-02-29", "1996-03-01"), ("1995-12", "1996-02")])
def test_time_bounds_reach_the_scan_and_mean_what_is_written(spark, sf, time):
    data = compile_plan(spark, sf, Select("orders", None, time)).data
    dates = [str(r.o_orderdate)[:10] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderdate").collect()]
    start, end = time
    want = sum((not start or d[: len(start)] >= start) and (not end or d[: len(end)] <= end) for d in dates)
    assert data.count() == want
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert ("GreaterThanOrEqual(o_orderdate" in plan) == bool(start) and ("LessThan(o_orderdate" in plan) == bool(end)


def test_times_that_are_none_are_rejected(spark, sf):
    with pytest.raises(PlanError):
        compile_plan(spark, sf, Select("orders", None, ("last year", None)))


def test_results_are_the_same_at_every_run(spark, sf):
    from plumbline.plans.compile import result_determinism, row_digest

    found = result_determinism(spark, sf, Aggregate("time", "count", Select("orders"))).first()
    assert (found.reps, found.distinct_results) == (3, 1)
    a, b = (spark.createDataFrame(rows, "x int, y string") for rows in ([(1, "a"), (2, None)], [(2, None), (1, "a")]))
    assert row_digest(a).first() == row_digest(b).first() and row_digest(a).first() != row_digest(a.limit(1)).first()
    assert row_digest(a.limit(0)).first().rows == 0
