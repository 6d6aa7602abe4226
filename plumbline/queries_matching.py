"""Registered queries of matching, components, smoothing and traces; each with the SQL that it must equal where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import components, matching, sequences, spatial
from plumbline.queries import _POINTS
from plumbline.registry import query as _query
from plumbline.sources.catalog import table

#: A code of 32 bits a vector: the signs of the sums of its two halves, component by component.
_BITS = 32


def _sign_code(vector: Column) -> Column:
    bit = lambda i: F.when(F.coalesce(F.get(vector, i) + F.get(vector, i + _BITS), F.lit(-1.0)) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0)
    return F.when(vector.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), F.lit(0).cast("long"), lambda code, i: code + bit(i)))


_CODES = f"SELECT vec_id, CASE WHEN embedding IS NOT NULL THEN list_sum(list_transform(range({_BITS}), lambda i: CASE WHEN coalesce(embedding[i + 1] + embedding[i + {_BITS + 1}], -1) >= 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) END AS code FROM embeddings"


@_query(f"""WITH c AS ({_CODES}), l AS (SELECT code, min(vec_id) AS id FROM c WHERE vec_id % 2 = 0 AND code IS NOT NULL GROUP BY 1), r AS (SELECT code, min(vec_id) AS id FROM c WHERE vec_id % 2 = 1 AND code IS NOT NULL GROUP BY 1),
p AS (SELECT l.id AS left_id, r.id AS right_id, l.code AS a, r.code AS b, bit_count(xor(CAST(l.code AS BIGINT), CAST(r.code AS BIGINT))) AS d FROM l CROSS JOIN r),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS kb, row_number() OVER (PARTITION BY b ORDER BY d, a) AS ka FROM p)
SELECT left_id, right_id, CAST(d AS INTEGER) AS distance FROM k WHERE ka = 1 AND kb = 1""")
def mutual_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even and odd ids that are each other's nearest by the Hamming distance of their sign codes."""
    coded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _sign_code(F.col("embedding")).alias("code"))
    # Blocks of 16 bits list few of up to some hundred thousand codes.
    return matching.mutual_nearest(coded.where("id % 2 = 0"), coded.where("id % 2 = 1"), _BITS)


@_query()
def one_to_one_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of even and odd ids matched one to one within 0.01, nearest first. Greedy choice has no plain SQL."""
    points = spatial.xy_of(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "x", "y")
    return matching.match_points(points.where("id % 2 = 0"), points.where("id % 2 = 1"), 0.01)


@_query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(20 AS DOUBLE) AS estimate FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.value > 5 AND e.value < 50 THEN 0.7 * s.estimate + 0.3 * e.value ELSE s.estimate END FROM s JOIN e ON e.user_id IS NOT DISTINCT FROM s.user_id AND e.k = s.k + 1)
SELECT event_id, user_id, round(estimate + 1e-10, 6) AS estimate FROM s WHERE k > 0""")
def gated_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's running estimate of the value, pulled along by values between 5 and 50 only."""
    found = sequences.smoothed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "estimate", 5.0, 50.0, 20.0)
    # Values of two decimals often end just between two numbers of six; a little is added so that both sides round alike.
    return found.select("event_id", "user_id", F.round(F.col("estimate") + 1e-10, 6).alias("estimate"))


_HOURS = """SELECT event_type, d, list(n ORDER BY h) AS p FROM (SELECT t.event_type, t.d, h.h, count(e.event_id) AS n FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS d FROM events) t CROSS JOIN (SELECT unnest(range(24)) AS h) h
LEFT JOIN events e ON e.event_type = t.event_type AND CAST(e.ts AS DATE) = t.d AND hour(e.ts) = h.h GROUP BY ALL) GROUP BY ALL"""
_STEP = """(SELECT CASE WHEN max(v) > 1 THEN min_by(j, -v * 100 + j) ELSE {at} END FROM (SELECT unnest(p) AS v, unnest(range(24)) AS j) WHERE j BETWEEN {at} - 3 AND {at} + 3)"""


@_query(f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM ({_HOURS})),
a AS (SELECT event_type, CAST(0 AS BIGINT) AS k, CAST(12 AS BIGINT) AS at FROM (SELECT DISTINCT event_type FROM h) UNION ALL SELECT h.event_type, h.k, {_STEP.format(at="a.at")} FROM a JOIN h ON h.event_type = a.event_type AND h.k = a.k + 1),
b AS (SELECT event_type, max(k) + 1 AS k, CAST(12 AS BIGINT) AS at FROM h GROUP BY 1 UNION ALL SELECT h.event_type, h.k, {_STEP.format(at="b.at")} FROM b JOIN h ON h.event_type = b.event_type AND h.k = b.k - 1)
SELECT h.event_type, strftime(h.d, '%Y-%m-%d') AS day, (a.at + b.at) / 2 AS hour FROM h JOIN a ON a.event_type = h.event_type AND a.k = h.k JOIN b ON b.event_type = h.event_type AND b.k = h.k""")
def busy_hour_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest hour of each event type, followed from day to day by three hours at most, both ways and averaged."""
    events = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d"), F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hours = events.groupBy("event_type", "d").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("by"))  # 24 at most
    days = hours.select("event_type", "d", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("by", h), F.lit(0)).cast("double")).alias("p"))
    found = sequences.traced(days, "event_type", ["d"], "p", "hour", 12, 3, 1.0)
    return found.select("event_type", F.date_format("d", "yyyy-MM-dd").alias("day"), "hour")


@_query(f"""WITH RECURSIVE c AS (SELECT CAST(floor(x / 0.02) AS BIGINT) AS cx, CAST(floor(y / 0.02) AS BIGINT) AS cy, count(*) AS points, sum(label) AS weight FROM ({_POINTS}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
r AS (SELECT cx, cy, cx AS tx, cy AS ty FROM c UNION SELECT r.cx, r.cy, c.cx, c.cy FROM r JOIN c ON c.cx BETWEEN r.tx - 1 AND r.tx + 1 AND c.cy BETWEEN r.ty - 1 AND r.ty + 1),
m AS (SELECT cx, cy, min((tx, ty)) AS root FROM r GROUP BY 1, 2)
SELECT root[1] AS cx, root[2] AS cy, count(*) AS cells, CAST(sum(points) AS BIGINT) AS points, CAST(sum(weight) AS BIGINT) AS weight, min(c.cx) AS min_cx, min(c.cy) AS min_cy, max(c.cx) AS max_cx, max(c.cy) AS max_cy FROM m JOIN c USING (cx, cy) GROUP BY 1, 2""")
def cell_component_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the occupied cells of a grid of 0.02, with the points in each and the sum of their labels."""
    return components.cell_components(spatial.xy_of(table(spark, sf_dir, "embeddings")), 0.02, F.col("label").cast("long"))
