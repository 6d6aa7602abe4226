"""The registered queries of the library's own operators, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import citations, forms, integrity, jobs, reports, rules, scoring, sequences, series, snapping, spatial
from plumbline.plans.algebra import Aggregate, Compare, Rank, Region, Relate, Select, canonical
from plumbline.plans.compile import Answer, compile_plan
from plumbline.registry import QUERIES, SQL, Query
from plumbline.registry import query as _query
from plumbline.sources.catalog import table

def _answer(spark: SparkSession, sf_dir: str, plan: object) -> DataFrame:
    answer = compile_plan(spark, sf_dir, plan)
    assert isinstance(answer, Answer), answer
    return answer.data


# --- the query algebra -------------------------------------------------------------------------------------------

_PLACED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@_query(f"SELECT count(*) AS value FROM {_PLACED} WHERE o_orderstatus = 'O' AND r_name = 'ASIA' AND year(o_orderdate) BETWEEN 1996 AND 1998")
def alg_select_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, Aggregate("space", "count", Select("open orders", Region("Asia region"), ("1996", "1998"))))


@_query("SELECT strftime(ts, '%Y-%m-%d') AS t, count(*) AS value FROM events WHERE event_type = 'error' GROUP BY 1")
def alg_count_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, Aggregate("time", "count", Select("error events")))


_TREND = """
SELECT {keys} count(*) AS points, round(coalesce(regr_slope(value, idx), 0), 4) AS slope,
  round(100 * (max_by(value, idx) - min_by(value, idx)) / nullif(min_by(value, idx), 0), 4) AS pct,
  CASE WHEN coalesce(regr_slope(value, idx), 0) > 0 THEN 'rising' WHEN coalesce(regr_slope(value, idx), 0) < 0 THEN 'falling' ELSE 'flat' END AS direction
FROM (SELECT *, CAST(row_number() OVER ({part} ORDER BY t) - 1 AS DOUBLE) AS idx FROM ({source})) {group}
"""


@_query(_TREND.format(keys="", part="", group="", source="SELECT year(o_orderdate) AS t, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1"))
def alg_trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, Compare("trend_direction", Aggregate("time", "count", Select("orders", Region("World")))))


_EVENT_TREND = _TREND.format(keys="event_type,", part="PARTITION BY event_type", group="GROUP BY event_type", source="SELECT event_type, strftime(ts, '%Y-%m-%d') AS t, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2")


@_query(f"WITH t AS ({_EVENT_TREND}) SELECT a.event_type AS source_a, a.direction AS direction_a, b.event_type AS source_b, b.direction AS direction_b FROM t a JOIN t b ON a.event_type < b.event_type AND a.direction <> b.direction")
def alg_trend_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = series.count_by_time(table(spark, sf_dir, "events"), "ts", "day", "event_type")
    return series.diverging(series.trend(daily, "event_type"), "event_type")


_POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


@_query(f"WITH p AS ({_POINTS}) SELECT vec_id, label, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.label = 0 AND sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) <= 0.005)")
def alg_relate_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answer(spark, sf_dir, Relate("within", Select("points"), Select("anchors"), 0.005))
    return found.select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@_query(f"SELECT n_name, o_orderpriority, n, rank FROM (SELECT n_name, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, o_orderpriority) AS rank FROM {_PLACED} GROUP BY 1, 2) WHERE rank <= 2")
def alg_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, Rank("o_orderpriority", 2, Select("orders"), within="n_name"))


@_query(f"""WITH p AS ({_POINTS}), d AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist
  FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, id_a, id_b, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist DESC, id_a, id_b) AS k FROM d) WHERE k = 1""")
def alg_farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.farthest_pairs(spatial.xy_of(table(spark, sf_dir, "embeddings")), "label", "vec_id")


@_query(f"SELECT CAST(floor(x / 0.05) AS BIGINT) AS cell_x, CAST(floor(y / 0.05) AS BIGINT) AS cell_y, count(*) AS n FROM ({_POINTS}) GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1")
def alg_densest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.densest_cells(spatial.xy_of(table(spark, sf_dir, "embeddings")), 0.05)


@_query(f"""WITH p AS ({_POINTS}), c AS (SELECT label, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM p GROUP BY 1),
d AS (SELECT p.label, avg(sqrt((x-mx)*(x-mx) + (y-my)*(y-my))) AS m FROM p JOIN c ON p.label = c.label GROUP BY 1),
k AS (SELECT label, floor(x / 0.1) AS cx, floor(y / 0.1) AS cy, count(*) AS n FROM p GROUP BY 1, 2, 3),
t AS (SELECT label, CAST(sum(n) AS BIGINT) AS top FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, cx, cy) AS r FROM k) WHERE r <= 3 GROUP BY 1)
SELECT c.label, c.n, round(sx, 6) AS std_x, round(sy, 6) AS std_y, round(m, 6) AS mean_dist, round(top / CAST(c.n AS DOUBLE), 6) AS top_share FROM c JOIN d ON c.label = d.label JOIN t ON c.label = t.label""")
def alg_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dispersion(spatial.xy_of(table(spark, sf_dir, "embeddings")), "label", 0.1)


@_query("SELECT r_name, n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def alg_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@_query("SELECT l_returnflag, round(part, 2) AS part, round(sum(part) OVER (), 2) AS total, round(part / sum(part) OVER (), 6) AS share FROM (SELECT l_returnflag, sum(l_quantity) AS part FROM lineitem GROUP BY 1)")
def alg_share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.share_of_total(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@_query("""SELECT 'orders' AS basis, 'observed' AS label, CAST(year(o_orderdate) AS VARCHAR) AS t, count(*) AS value FROM orders GROUP BY 3
UNION ALL SELECT 'lineitem', 'observed', CAST(year(l_shipdate) AS VARCHAR), count(DISTINCT l_orderkey) FROM lineitem GROUP BY 3""")
def alg_all_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy").alias("t")).agg(F.count_distinct("l_orderkey").alias("value"))
    orders = series.count_by_time(table(spark, sf_dir, "orders"), "o_orderdate", "year")
    both = series.all_bases(orders=orders, lineitem=lines)
    return both.select("basis", F.lit("observed").alias("label"), "t", "value")


# --- cells and scores --------------------------------------------------------------------------------------------

_CELLS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '  ' || upper(p_name) || '  ' WHEN 1 THEN replace(p_name, ' ', '   ') WHEN 2 THEN '0' || CAST(p_size AS VARCHAR) || '.0'
  WHEN 3 THEN '+' || CAST(p_size AS VARCHAR) || ',50' WHEN 4 THEN '-0' ELSE NULL END AS cell FROM part"""


def _norm_sql(x: str) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\r]+', ' ', 'g'))"
    n = f"replace({t}, ',', '.')"
    whole = f"regexp_replace(regexp_extract({n}, '^[+-]?([0-9]+)', 1), '^0+([0-9])', '\\1')"
    part = f"regexp_replace(regexp_extract({n}, '\\.([0-9]+)$', 1), '0+$', '')"
    plain = f"CASE WHEN {part} = '' THEN {whole} ELSE {whole} || '.' || {part} END"
    return f"CASE WHEN regexp_matches({t}, '^[+-]?[0-9]+([.,][0-9]+)?$') THEN CASE WHEN left({t}, 1) = '-' AND ({plain}) <> '0' THEN '-' ELSE '' END || {plain} ELSE lower({t}) END"


@_query(f"SELECT p_partkey, cell, {_norm_sql('cell')} AS norm FROM ({_CELLS})")
def text_norm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("  "), F.upper("p_name"), F.lit("  ")), F.replace("p_name", F.lit(" "), F.lit("   ")), F.concat(F.lit("0"), size, F.lit(".0")), F.concat(F.lit("+"), size, F.lit(",50")), F.lit("-0")]
    cell = F.coalesce(*[F.when(F.col("p_partkey") % 6 == i, f) for i, f in enumerate(forms)])
    return table(spark, sf_dir, "part").select("p_partkey", cell.alias("cell")).withColumn("norm", fx.norm(F.col("cell")))




def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Golden cells of orders, and a copy with slips by rule: lost, wrong and invented values, lost rows."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 50).alias("form"), (k % 50).alias("row"), k.alias("key"), "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))

    def cells(df: DataFrame, **columns) -> DataFrame:
        entries = F.explode(F.array(*[F.struct(F.lit(n).alias("col"), c.alias("value")) for n, c in columns.items()])).alias("cell")
        return df.select("form", "row", entries).select("form", "row", "cell.col", "cell.value")

    key = F.col("key")
    blank = F.when(key % 5 != 0, F.col("date"))
    golden = cells(rows, status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), customer=F.col("customer"), date=blank)
    slipped = cells(
        rows.where(key % 13 != 0), status=F.when(key % 7 != 0, F.col("o_orderstatus")), priority=F.when(key % 11 == 0, F.lit("9-WRONG")).otherwise(F.lower("o_orderpriority")),
        customer=F.concat(F.col("customer"), F.lit(".0")), date=F.when(key % 10 == 0, F.lit("junk")).otherwise(blank),
    )
    return golden, slipped


_JUDGED = """
WITH k AS (SELECT o_orderkey AS key, o_orderkey // 50 AS form, o_orderkey % 50 AS row, o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS customer, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
c AS (SELECT form, row, 'status' AS col, lower(o_orderstatus) AS golden, CASE WHEN key % 13 = 0 OR key % 7 = 0 THEN '' ELSE lower(o_orderstatus) END AS got FROM k
UNION ALL SELECT form, row, 'priority', lower(o_orderpriority), CASE WHEN key % 13 = 0 THEN '' WHEN key % 11 = 0 THEN '9-wrong' ELSE lower(o_orderpriority) END FROM k
UNION ALL SELECT form, row, 'customer', customer, CASE WHEN key % 13 = 0 THEN '' ELSE customer END FROM k
UNION ALL SELECT form, row, 'date', CASE WHEN key % 5 = 0 THEN '' ELSE date END, CASE WHEN key % 13 = 0 THEN '' WHEN key % 10 = 0 THEN 'junk' WHEN key % 5 = 0 THEN '' ELSE date END FROM k),
j AS (SELECT *, CASE WHEN golden = got THEN 'ok' WHEN golden = '' THEN 'halluc' WHEN got = '' THEN 'miss' ELSE 'wrong' END AS verdict FROM c)
"""


def _scores_sql(key: str) -> str:
    n = {"total": "true", "match": "verdict = 'ok'", "filled": "golden <> ''", "filled_match": "golden <> '' AND verdict = 'ok'", "blank": "golden = ''", "blank_match": "golden = '' AND verdict = 'ok'", "halluc": "verdict = 'halluc'", "miss": "verdict = 'miss'", "wrong": "verdict = 'wrong'"}
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {name}" for name, c in n.items())
    rate = lambda a, b, e: f"coalesce(round({a} / CAST(nullif({b}, 0) AS DOUBLE), 4), {e})"
    rates = {"cell_acc": ("match", "total", "1.0"), "filled_recall": ("filled_match", "filled", "1.0"), "blank_acc": ("blank_match", "blank", "1.0"), "halluc_rate": ("halluc", "blank", "0.0"), "miss_rate": ("miss", "filled", "0.0"), "wrong_rate": ("wrong", "filled", "0.0")}
    return f"{_JUDGED} SELECT *, {', '.join(f'{rate(*r)} AS {name}' for name, r in rates.items())} FROM (SELECT {key}, {counts} FROM j GROUP BY {key})"


@_query(_scores_sql("form"))
def score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cell_scores(scoring.judge_cells(*_grids(spark, sf_dir)), "form")


@_query(_scores_sql("col"))
def score_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cell_scores(scoring.judge_cells(*_grids(spark, sf_dir)), "col")


@_query("SELECT form, greatest(0, m) AS extra_rows FROM (SELECT form, CASE WHEN max_c IS NULL THEN -max_g - 1 ELSE max_c - max_g END AS m FROM (SELECT o_orderkey // 50 AS form, max(CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 50 END) AS max_g, max(CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 50 END) AS max_c FROM orders GROUP BY 1))")
def score_extra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden, slipped = _grids(spark, sf_dir)
    return scoring.extra_rows(golden.where((F.col("form") * 50 + F.col("row")) % 4 != 3), slipped)


@_query("""WITH h AS (SELECT s_suppkey, s_nationkey, s_name, s_acctbal FROM supplier)
SELECT s_suppkey AS form, 2 AS labels, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS matched, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 1.0 END AS header_acc FROM h""")
def score_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pairs = lambda *p: F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(lab).alias("label"), v.alias("value")) for i, (lab, v) in enumerate(p)])).alias("h")
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    golden = s.select(F.col("s_suppkey").alias("form"), pairs(("Name", name), ("Nation", F.lit("first")), ("nation ", nation), (" ", name))).select("form", "h.*")
    candidate = s.select(F.col("s_suppkey").alias("form"), pairs(("NAME", F.when(F.col("s_suppkey") % 3 != 0, F.upper(name))), ("nation", F.concat(nation, F.lit(".0"))))).select("form", "h.*")
    scores = scoring.header_scores(golden, candidate)
    return scores.select("form", F.col("labels").cast("int").alias("labels"), F.col("matched").cast("int").alias("matched"), "header_acc")


@_query("""WITH d AS (SELECT b.item_id, b.text AS gt, d.text AS ct FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
a AS (SELECT item_id, t.side, trim(unnest(regexp_split_to_array(lower(t.x), '[^0-9a-z.]+')), '.') AS tok FROM d, LATERAL (SELECT 'g' AS side, gt AS x UNION ALL SELECT 'c', ct) t),
k AS (SELECT item_id, side, tok, CASE WHEN regexp_matches(tok, '^[0-9]+(\\.[0-9]+)?$') THEN 'num' WHEN regexp_matches(tok, '^[a-z]$') THEN 'code' WHEN length(tok) >= 2 THEN 'word' END AS cls FROM a),
n AS (SELECT item_id, cls, CASE WHEN cls = 'num' THEN """ + _norm_sql("tok") + """ ELSE tok END AS tok, count(*) FILTER (WHERE side = 'g') AS g, count(*) FILTER (WHERE side = 'c') AS c FROM k WHERE cls IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT i.item_id, c.cls, coalesce(sum(g), 0) AS g, coalesce(sum(n.c), 0) AS c, coalesce(sum(least(g, n.c)), 0) AS m FROM (SELECT DISTINCT item_id FROM d) i CROSS JOIN (SELECT unnest(['num', 'word', 'code']) AS cls) c LEFT JOIN n ON n.item_id = i.item_id AND n.cls = c.cls GROUP BY 1, 2),
f AS (SELECT item_id, cls, CAST(g AS DOUBLE) AS g, CAST(c AS DOUBLE) AS c, CAST(m AS DOUBLE) AS m FROM e UNION ALL SELECT item_id, 'all', CAST(sum(g) AS DOUBLE), CAST(sum(c) AS DOUBLE), CAST(sum(m) AS DOUBLE) FROM e GROUP BY 1),
r AS (SELECT *, coalesce(m / nullif(g, 0), 1.0) AS rc, coalesce(m / nullif(c, 0), 1.0) AS pr FROM f)
SELECT item_id, cls, CAST(g AS BIGINT) AS golden_total, CAST(c AS BIGINT) AS candidate_total, CAST(m AS BIGINT) AS common, round(rc, 3) AS recall, round(pr, 3) AS precision, round(coalesce(2 * rc * pr / nullif(rc + pr, 0), 0.0), 3) AS f1 FROM r""")
def score_multiset_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = table(spark, sf_dir, "benchmark")
    candidate = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(golden.select("item_id"), "item_id", "left_semi")
    return scoring.multiset_scores(golden.join(candidate.select("item_id"), "item_id", "left_semi"), candidate, "item_id")


# --- reports and rules -------------------------------------------------------------------------------------------

_LABELLED = "labels JOIN documents USING (doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")


@_query(f"""SELECT source, {', '.join(f"round(avg(CASE WHEN lang = '{x}' THEN CAST(quality AS DOUBLE) END), 4) AS {x}" for x in ('de', 'en', 'es', 'fr'))}, round(avg(CAST(quality AS DOUBLE)), 4) AS "ALL" FROM {_LABELLED} GROUP BY source""")
def report_by_type_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.means_with_all(_labelled(spark, sf_dir), ["source"], "lang", ["de", "en", "es", "fr"], "quality")


@_query(f"""SELECT source, count(*) FILTER (WHERE toxic = 0) AS n, count(*) FILTER (WHERE toxic <> 0) AS n_error, round(avg(CASE WHEN toxic = 0 THEN quality END), 4) AS mean,
count(*) FILTER (WHERE toxic = 0 AND lang = 'en') AS n_bucket, round(avg(CASE WHEN toxic = 0 AND lang = 'en' THEN quality END), 4) AS bucket_mean, round(min(CASE WHEN toxic = 0 AND lang = 'en' THEN CAST(quality AS DOUBLE) END), 4) AS bucket_min,
round(avg(CASE WHEN toxic = 0 AND n_chars > 0 THEN n_chars END), 4) AS mean_latency FROM {_LABELLED} GROUP BY source""")
def report_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("error", F.when(F.col("toxic") != 0, "toxic")).withColumn("score", F.col("quality").cast("double"))
    return reports.run_report(rows, "source", "score", "lang", "en", "n_chars")


_LEVELS = [100.0, 200.0, 500.0, 1000.0, 2000.0, 3000.0, 5000.0, 10000.0]


@_query(f"""WITH n AS (SELECT t.threshold, count(*) FILTER (WHERE quality = 1 AND n_chars < t.threshold) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars >= t.threshold) AS fp,
count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM {_LABELLED} CROSS JOIN (SELECT CAST(unnest({_LEVELS}) AS DOUBLE) AS threshold) t GROUP BY 1),
r AS (SELECT *, coalesce(fn / CAST(nullif(pos, 0) AS DOUBLE), 0.0) AS fn_rate, coalesce(fp / CAST(nullif(neg, 0) AS DOUBLE), 0.0) AS fp_rate FROM n),
s AS (SELECT threshold, fn, fp, round(fn_rate, 6) AS fn_rate, round(fp_rate, 6) AS fp_rate, round(1 - (fn_rate + fp_rate) / 2, 6) AS balanced_acc FROM r)
SELECT *, row_number() OVER (ORDER BY balanced_acc DESC, threshold) = 1 AS best FROM s""")
def roc_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_sweep(_labelled(spark, sf_dir), "n_chars", F.col("quality") == 1, _LEVELS)


@_query("""WITH c AS (SELECT user_id AS form, count(*) FILTER (WHERE value / 100 >= 0.004 AND event_type <> 'view') AS inked FROM events GROUP BY 1),
r AS (SELECT user_id AS form, count(DISTINCT CASE WHEN (value / 100 >= 0.004 AND event_type <> 'view') OR (event_type = 'error' AND event_id % 17 = 0) OR (event_type = 'signup' AND event_id % 5 = 0) OR event_id % 997 = 0 THEN event_id END) AS rows_read,
count(*) FILTER (WHERE event_id % 997 = 0) AS shape, count(*) FILTER (WHERE event_type = 'error' AND event_id % 17 = 0 AND event_id % 997 <> 0) AS domain, count(*) FILTER (WHERE event_type = 'signup' AND event_id % 5 = 0 AND event_id % 997 <> 0) AS cell_mode FROM events GROUP BY 1),
v AS (SELECT c.form, inked, rows_read, shape, domain, cell_mode, 0.4 + (c.form % 13) * 0.05 AS integrity FROM c JOIN r USING (form))
SELECT form, inked AS inked_cells, rows_read, shape AS n_shape, domain AS n_domain, cell_mode AS n_cell_mode,
CASE WHEN inked = 0 OR integrity < 0.5 THEN 'reject' WHEN form % 19 = 0 OR integrity < 0.95 OR shape > 0 OR domain / CAST(greatest(1, inked) AS DOUBLE) > 0.15 OR cell_mode / CAST(greatest(1, rows_read) AS DOUBLE) > 0.4 THEN 'review' ELSE 'detected' END AS verdict FROM v""")
def verdict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    forms = e.select(F.col("user_id").alias("form")).distinct().select("form", (F.col("form") % 19 != 0).alias("aligned"), F.lit(True).alias("corners"), (F.lit(4) / 10 + (F.col("form") % 13) * 5 / 100).alias("integrity"))
    cells = e.select(F.col("user_id").alias("form"), F.col("event_id").alias("row"), F.lit(0).alias("col"), (F.col("value") / 100).alias("ink"), (F.col("event_type") == "view").alias("serial"))
    kind = F.when(F.col("event_id") % 997 == 0, "shape").when((F.col("event_type") == "error") & (F.col("event_id") % 17 == 0), "domain").when((F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0), "cell_mode")
    flags = e.select(F.col("user_id").alias("form"), F.col("event_id").alias("row"), kind.alias("flag")).where("flag is not null")
    return rules.form_verdicts(forms, cells, flags).select("form", "inked_cells", "rows_read", "n_shape", "n_domain", "n_cell_mode", "verdict")


@_query("""WITH t AS (SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS questions, (length(html) - length(replace(html, '<a ', ''))) // 3 AS links,
(length(html) - length(replace(html, '<div', ''))) // 4 AS divs, page_id % 3 AS depth FROM pages),
r AS (SELECT *, CASE page_id % 4 WHEN 0 THEN [] WHEN 1 THEN [links] WHEN 2 THEN [links, questions] ELSE [questions * 4] END AS regions FROM t),
u AS (SELECT *, len(list_filter(regions, lambda n: n >= 2)) AS k, coalesce(list_filter(regions, lambda n: n >= 2)[1], 0) AS w FROM r)
SELECT page_id, CASE WHEN depth >= 2 OR divs > greatest(2, questions / 2) THEN 'not_flattenable' WHEN k = 1 AND w <= 12 THEN 'register' WHEN k > 1 THEN 'multi_region' WHEN k = 1 THEN 'register_wide' WHEN questions >= 4 THEN 'card' ELSE 'not_flattenable' END AS layout FROM u""")
def census_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda tag: F.floor((F.length("html") - F.length(F.replace("html", F.lit(tag), F.lit("")))) / len(tag)).cast("long")
    t = table(spark, sf_dir, "pages").select("page_id", count("<p>").alias("questions"), count("<a ").alias("links"), count("<div").alias("divs"))
    turn = F.col("page_id") % 4
    none = F.array().cast("array<bigint>")
    regions = F.when(turn == 0, none).when(turn == 1, F.array("links")).when(turn == 2, F.array("links", "questions")).otherwise(F.array(F.col("questions") * 4))
    t = t.withColumn("regions", regions)
    return t.select("page_id", rules.layout_class(F.col("questions"), F.col("divs"), F.col("page_id") % 3, F.col("regions")).alias("layout"))


# --- texts -------------------------------------------------------------------------------------------------------


@_query("SELECT page_id, 1 AS n_links, url AS first_link FROM pages")
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = F.concat(F.lit("Seen at ("), F.col("url"), F.lit(") and nowhere else."))
    found = table(spark, sf_dir, "pages").select("page_id", fx.urls(prose).alias("links"))
    return found.select("page_id", F.size("links").alias("n_links"), F.get("links", F.lit(0)).alias("first_link"))


@_query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true ELSE false END AS hit, o_orderkey % 3 <> 2 AS hit_fixed FROM orders")
def gold_number_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.format_number(F.col("o_orderkey") + 1000, 0)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Order "), key, F.lit(" is on its way."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("It is order "), key, F.lit("."))).otherwise(F.lit("No such order."))
    gold = (F.col("o_orderkey") + 1000).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(fx.gold_hit(gold, said), F.lit(False)).alias("hit"), F.coalesce(fx.gold_hit(gold, said, fixed=True), F.lit(False)).alias("hit_fixed"))


@_query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def citation_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain the whole text of a benchmark item."""
    return citations.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@_query("SELECT conv_id, conv_id % 4 IN (0, 1) AS asked, conv_id % 4 IN (1, 2) AS no_data, 'case ' || CAST(conv_id AS VARCHAR) AS tail FROM (SELECT DISTINCT conv_id FROM conversations)")
def askback_nodata_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("conv_id") % 4
    asks, lacks = F.lit("Which ward do you mean? "), F.lit("There is no official data on it. ")
    head = F.when(kind == 0, asks).when(kind == 1, F.concat(asks, lacks)).when(kind == 2, lacks).otherwise(F.lit("It is 25. "))
    tail = F.concat(F.lit("case \n "), F.col("conv_id"))
    said = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("text", F.concat(head, tail))
    return said.select("conv_id", F.col("text").rlike(fx.ASK_BACK).alias("asked"), F.col("text").rlike(fx.NO_DATA).alias("no_data"), fx.excerpt_end(tail).alias("tail"))


@_query("SELECT * FROM (SELECT o_custkey, o_orderstatus, count(*) AS reps, count(DISTINCT o_orderpriority) AS distinct_answers, count(DISTINCT o_orderpriority) = 1 AS agree FROM orders GROUP BY 1, 2) WHERE reps > 1")
def repeat_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.agreement(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")


_PLAN = canonical(Aggregate("space", "count", Select("orders")))


@_query("SELECT 1 AS distinct_plans, count(*) AS reps FROM region")
def plan_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan written in different orders of slots has one canonical form."""
    texts = F.when(F.col("r_regionkey") % 2 == 0, F.lit(_PLAN)).otherwise(F.lit(canonical(Aggregate(source=Select(entity="orders"), metric="count", by="space"))))
    return table(spark, sf_dir, "region").agg(F.count_distinct(texts).cast("int").alias("distinct_plans"), F.count(F.lit(1)).alias("reps"))


@_query("""SELECT page_id, 0 AS pos, left(url, 160) AS url, page_id % 5 <> 0 OR page_id % 7 = 0 AS resolves,
CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN '' WHEN page_id % 2 = 0 THEN CAST(page_id + 100000 AS VARCHAR) ELSE '' END AS numbers FROM pages""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a page and name a number; some pages are missing, some failed, half of the others have the number.

    Each answer's page was fetched for it, as pages share urls, and the numbers in urls are none of the answer's.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.format_number(F.col("page_id") + 100_000, 0)
    runs = pages.select("page_id", F.concat(F.lit("It is "), number, F.lit(" of 12 [see "), "url", F.lit("].")).alias("body"))
    body = F.when(F.col("page_id") % 5 == 0, F.lit(citations.FAILED)).when(F.col("page_id") % 2 == 0, F.concat(F.lit("in all "), number)).otherwise("nothing")
    found = citations.citations(runs, pages.where("page_id % 7 <> 0").select("page_id", "url", body.alias("body")), ["page_id"], by=["page_id"], linked=False)
    return found.withColumn("numbers", F.array_join("numbers", ";"))


@_query("""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS gold_num_present, 1 AS n_citations, conv_id % 2 = 0 AS askback_hint,
60 + length(CAST(conv_id AS VARCHAR)) + CASE WHEN conv_id % 2 = 0 THEN 20 ELSE 0 END AS chars FROM (SELECT DISTINCT conv_id FROM conversations)""")
def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    bank = spark.createDataFrame([(0, "about 25"), (1, "26 of them"), (2, "none")], "q int, gold string")
    ask = F.when(i % 2 == 0, " Which one is meant?").otherwise("")
    runs = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("q", (i % 3).cast("int"))
    runs = runs.withColumn("body", F.concat(F.rpad(F.lit("It was 25 then, says http://a.example/x"), 60, "."), i.cast("string"), ask))
    found = citations.run_features(citations.with_question(runs, bank, "q"))
    return found.select("conv_id", "gold_num_present", F.col("n_citations").cast("int").alias("n_citations"), "askback_hint", "chars")


_SURVEY = "SELECT user_id AS form, event_id, ts, CASE event_type WHEN 'signup' THEN 'begin_repeat' WHEN 'error' THEN 'end_repeat' WHEN 'click' THEN 'select_multiple x' WHEN 'view' THEN 'integer' ELSE 'image' END AS type FROM events"


@_query(f"""WITH s AS (SELECT form, type, row_number() OVER (PARTITION BY form ORDER BY ts, event_id) AS pos FROM ({_SURVEY})),
a AS (SELECT *, sum(CASE type WHEN 'begin_repeat' THEN 1 WHEN 'end_repeat' THEN -1 ELSE 0 END) OVER (PARTITION BY form ORDER BY pos) AS s FROM s),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY form ORDER BY pos)) AS depth FROM a),
i AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY form ORDER BY pos), 0) AS b, sum(CASE WHEN type IN ('select_multiple x', 'integer') AND depth >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY form ORDER BY pos) AS q FROM d),
o AS (SELECT *, max(CASE WHEN type = 'begin_repeat' THEN pos END) OVER (PARTITION BY form ORDER BY pos) AS p FROM i),
r AS (SELECT o.form, o.pos, o.q - c.q AS n FROM o JOIN o c ON c.form = o.form AND c.pos = o.p WHERE o.type = 'end_repeat' AND o.b = 1),
g AS (SELECT form, string_agg(CAST(n AS VARCHAR), ';' ORDER BY pos) AS regions FROM r GROUP BY 1)
SELECT d.form, count(*) FILTER (WHERE type IN ('select_multiple x', 'integer')) AS questions, count(*) FILTER (WHERE type = 'select_multiple x') AS select_multiple, count(*) FILTER (WHERE type = 'image') AS media,
count(*) FILTER (WHERE type = 'begin_repeat') AS repeats, CAST(max(depth) AS BIGINT) AS max_depth, coalesce(any_value(g.regions), '') AS regions FROM d LEFT JOIN g ON g.form = d.form GROUP BY 1""")
def form_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.col("event_type")
    named = F.when(kind == "signup", "begin_repeat").when(kind == "error", "end_repeat").when(kind == "click", "select_multiple x").when(kind == "view", "integer").otherwise("image")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("form"), F.row_number().over(order).alias("pos"), named.alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("relevant", "constraint", "choice_filter")])
    found = forms.form_features(rows)
    return found.select("form", "questions", "select_multiple", "media", "repeats", "max_depth", F.array_join(F.transform("regions", lambda n: n.cast("string")), ";").alias("regions"))


# --- jobs and sequences ------------------------------------------------------------------------------------------


@_query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").withColumn("error", F.when(F.col("toxic") != 0, "toxic"))
    return jobs.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), done, ["doc_id"], retry_errors=True)


@_query("SELECT n_name, event_type, r AS rep, CASE WHEN s.n IS NULL THEN 'no source run' ELSE 'ready' END AS status, s.n AS prior FROM nation CROSS JOIN (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest([1, 2]) AS r) LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey")
def job_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = spark.range(1, 3).select(F.col("id").cast("int").alias("rep"))
    grid = jobs.job_grid(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "events").select("event_type").distinct(), reps)
    prior = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("prior"))
    return jobs.with_prior(grid, prior, ["n_nationkey"], "prior").select("n_name", "event_type", "rep", "status", "prior")


@_query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM i GROUP BY 1, 2""")
def legend_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@_query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY user_id ORDER BY k) AS b, min(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT f.event_id, s.v AS filled FROM f LEFT JOIN e s ON s.user_id = f.user_id AND s.k = CASE WHEN a IS NOT NULL AND (b IS NULL OR a - f.k < f.k - b) THEN a ELSE b END""")
def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return sequences.nearest_fill(e, "user_id", ["ts", "event_id"], "v", "filled").select("event_id", "filled")


@_query("""WITH s AS (SELECT user_id, ts, event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
d AS (SELECT user_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS depth FROM s)
SELECT user_id, CAST(max(depth) AS BIGINT) AS max_depth, count(*) FILTER (WHERE depth > 0) AS inside FROM d GROUP BY 1""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, end = F.col("event_type") == "signup", F.col("event_type") == "error"
    deep = sequences.nesting(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], begin, end)
    return deep.groupBy("user_id").agg(F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > 0).alias("inside"))


@_query("""WITH b AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT *, sum(CASE WHEN event_type = 'error' AND b > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM b)
SELECT event_id, user_id FROM e WHERE b > 0 AND e = 0 AND event_type <> 'signup'""")
def first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, end = F.col("event_type") == "signup", F.col("event_type") == "error"
    return sequences.first_region(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], begin, end).select("event_id", "user_id")


@_query("""WITH f AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY lower(sha256(text)) ORDER BY doc_id) AS seen FROM documents WHERE n_chars BETWEEN 500 AND 20000),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM f WHERE seen = 1)
SELECT doc_id, source, n_chars FROM t WHERE k <= 6 ORDER BY doc_id LIMIT 60""")
def first_seen_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query is a report with limits: six of a source, sixty in all."""
    docs = table(spark, sf_dir, "documents").where(F.col("n_chars").between(500, 20000))
    seen = jobs.first_seen(docs, F.sha2(F.col("text").cast("binary"), 256), "doc_id").select("doc_id", "source", "n_chars")
    return jobs.top_per_group(seen, "source", 6, 60, "doc_id")


# --- integrity and publishing ------------------------------------------------------------------------------------


@_query("SELECT printf('%05d-page.md', doc_id) AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five digits at least, as longer ids go whole into the name; a null text is an empty file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("%05d-page.md", "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    listed = integrity.manifest(docs, "name", "text")
    there = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return integrity.check_manifest(listed, integrity.manifest(there, "name", "text"))


@_query("""WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2024-05-01T0930-entry-' || doc_id || '.md' WHEN 1 THEN '0' || doc_id || '-entry.md' ELSE 'Entry ' || doc_id || '.txt' END AS name FROM documents)
SELECT CASE doc_id % 3 WHEN 0 THEN 'stamped' WHEN 1 THEN 'numbered' ELSE 'other' END AS kind, count(*) AS n FROM n GROUP BY 1""")
def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2024-05-01T0930-entry-"), i, F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("0"), i, F.lit("-entry.md"))).otherwise(F.concat(F.lit("Entry "), i, F.lit(".txt")))
    return reports.histogram(table(spark, sf_dir, "documents").select(integrity.entry_kind(name).alias("kind")), "kind")


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS path FROM pages"


@_query(f"WITH l AS ({_LINKS}) SELECT page_id, path, count(*) AS n FROM l WHERE page_id % 2 = 1 AND path NOT IN (SELECT path FROM l WHERE page_id % 2 = 0) GROUP BY 1, 2")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(integrity.hrefs(F.col("html"))).alias("href")).select("page_id", integrity.local_path(F.col("href")).alias("path"))
    found = integrity.broken_links(links.where("page_id % 2 = 1"), links.where("page_id % 2 = 0"))
    return found.groupBy("page_id", "path").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT page_id, path AS href, count(*) AS n FROM ({_LINKS}) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.repeated(table(spark, sf_dir, "pages").select("page_id", F.explode(integrity.hrefs(F.col("html"))).alias("href")), "page_id", "href")


@_query("SELECT p_partkey, slug, slug || repeat('_', CAST(row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS INTEGER)) AS key FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS slug FROM part)")
def slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = fx.clean_label(F.concat(F.lit("<b>"), F.initcap("p_name"), F.lit("</b> ${x}:")))
    return sequences.unique_keys(table(spark, sf_dir, "part").select("p_partkey", fx.slug(label).alias("slug")), "slug", ["p_partkey"])


@_query("SELECT s_suppkey, s_name || ', \"' || s_nationkey || '\"' AS name, s_nationkey AS nation, true AS shape_ok FROM supplier")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.lit(', "'), "s_nationkey", F.lit('"'))
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("\n```"), fx.csv_line(F.col("s_suppkey"), name, F.col("s_nationkey"))).alias("line"))
    back = lines.select("s_suppkey", fx.csv_fields(F.col("line"), 3).alias("f"))
    return back.select("s_suppkey", F.get("f.values", F.lit(1)).alias("name"), F.get("f.values", F.lit(2)).cast("int").alias("nation"), "f.shape_ok")


@_query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '../p' || page_id WHEN page_id % 13 = 0 THEN '/p' || page_id ELSE 'p' || page_id END AS path FROM pages)
SELECT page_id, path FROM p WHERE page_id % 4 <> 3 AND page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def publish_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("p"), F.col("page_id"))
    path = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("../"), page)).when(F.col("page_id") % 13 == 0, F.concat(F.lit("/"), page)).otherwise(page)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.when(F.col("page_id") % 4 == 3, "draft").otherwise("published").alias("status"))
    withheld = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("p"), F.col("doc_id")).alias("path"))
    return integrity.publishable(pages, "status", "path", withheld).select("page_id", "path")


@_query("SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.inventory(table(spark, sf_dir, "documents"), "lang", "source", size="n_chars")


@_query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT p_partkey, word, CASE WHEN p_partkey % 2 = 0 THEN left(word, 2) || 'x' || substr(word, 3) ELSE upper(word) END AS read, CASE WHEN length(word) >= 4 THEN word END AS snapped FROM w""")
def fuzzy_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part words snapped to the known ones; one letter too many, or upper case, must not change the answer."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    slip = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.left("word", F.lit(2)), F.lit("x"), F.substring("word", 3, 100))).otherwise(F.upper("word"))
    return snapping.snap(parts.withColumn("read", slip), "read", parts.select(F.col("word").alias("known")), "known")


@_query("SELECT p_partkey, '<strong>' || p_brand || '</strong> &amp; <em>' || p_name || '</em> &lt;' || p_size || '&gt; <a href=\"/p/' || p_partkey || '\">more</a>' AS html FROM part")
def md_inline_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("**"), "p_brand", F.lit("** & *"), "p_name", F.lit("* <"), "p_size", F.lit("> [more](/p/"), "p_partkey", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", fx.inline_markdown(text).alias("html"))


@_query("SELECT event_id, props AS found, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.json_object(F.concat(F.lit("Here it is:\n"), "props", F.lit(" - done.")))
    return table(spark, sf_dir, "events").select("event_id", found.alias("found"), F.get_json_object(found, "$.k").cast("bigint").alias("k"))


@_query("SELECT o_orderpriority AS kind, round(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END), 4) AS without, round(avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END), 4) AS with_it FROM orders GROUP BY 1")
def ablation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).alias("arm"), F.col("o_orderpriority").alias("kind"), "o_totalprice")
    return reports.ablation(rows, "arm", "kind", "o_totalprice").drop("gain")


def queries() -> dict[str, Query]:
    from plumbline import queries_fitting, queries_matching, queries_more  # noqa: F401  they register their queries as they are imported

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    known = queries()
    return {name: sql for name, sql in SQL.items() if name in known}
