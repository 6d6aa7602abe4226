"""More registered queries: provenance, determinism, edges, forms, files, prompts; each with the SQL that it must equal.

They take the tables' own texts and values wherever these can give mixed answers, and stand-ins only where they cannot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import citations, forms, integrity, jobs, reports, rules, scoring, sequences, spatial
from plumbline.plans.algebra import Aggregate, Compare, Region, Select
from plumbline.plans.compile import Answer, compile_plan, result_determinism
from plumbline.queries import _JUDGED, _PLACED, _POINTS, _grids
from plumbline.registry import query as _query
from plumbline.sources.catalog import table

# --- plans and places --------------------------------------------------------------------------------------------

_OPEN = f"SELECT year(o_orderdate) AS y FROM {_PLACED} WHERE o_orderstatus = 'O' AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-01-01'"
_PLAN = Compare("trend_direction", Aggregate("time", "count", Select("open orders", Region("Asia"), ("1996-03", "1997"))))


@_query(f"WITH o AS ({_OPEN}) SELECT 'SELECT' AS op, count(*) AS rows FROM o UNION ALL SELECT 'AGGREGATE', count(DISTINCT y) FROM o UNION ALL SELECT 'COMPARE', 1")
def alg_provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each operator of a plan made, counted while the answer was computed."""
    answer = compile_plan(spark, sf_dir, _PLAN, counts=True)
    assert isinstance(answer, Answer)
    answer.data.collect()  # one row
    return spark.createDataFrame([(s["op"], s["rows"]) for s in answer.counted() if "rows" in s], "op string, rows long")


@_query("SELECT 3 AS reps, 1 AS distinct_results")
def result_determinism_of_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three computations of one plan give one result."""
    found = result_determinism(spark, sf_dir, _PLAN)
    return found.select(F.col("reps").cast("int").alias("reps"), F.col("distinct_results").cast("int").alias("distinct_results"))


_EDGES = f"SELECT a.x AS lon1, a.y AS lat1, b.x AS lon2, b.y AS lat2 FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM ({_POINTS}) WHERE label = 0) a JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM ({_POINTS}) WHERE label = 0) b ON b.k = a.k + 1"


@_query(f"""WITH e AS ({_EDGES}), p AS (SELECT vec_id, x AS lon, y AS lat FROM ({_POINTS})),
s AS (SELECT p.*, e.*, cos(radians(lat)) AS c FROM p CROSS JOIN e),
d AS (SELECT *, (lon1 - lon) * c AS ax, lat1 - lat AS ay, (lon2 - lon1) * c AS dx, lat2 - lat1 AS dy FROM s),
t AS (SELECT *, least(1.0, greatest(0.0, coalesce(-(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0), 0.0))) AS t FROM d),
n AS (SELECT vec_id, lat, lon, lat1 + t * (lat2 - lat1) AS nlat, lon1 + t * (lon2 - lon1) AS nlon FROM t),
h AS (SELECT vec_id, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(nlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(nlat)) * pow(sin(radians(nlon - lon) / 2), 2)))) AS km FROM n)
SELECT vec_id FROM h GROUP BY 1 HAVING min(km) <= 0.25""")
def alg_within_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at 250 metres or less from the line through the label-0 points in the order of their ids."""
    points = spatial.xy_of(table(spark, sf_dir, "embeddings")).select("vec_id", "label", F.col("x").alias("lon"), F.col("y").alias("lat"))
    corners = sequences.numbered(points.where("label = 0"), "label", ["vec_id"], "k")
    ends = corners.select((F.col("k") - 1).alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    edges = corners.select("k", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(ends, "k").drop("k")
    return spatial.within_km_of_edges(points, edges, 0.25).select("vec_id")


@_query(f"SELECT cx, cy, vec_id, label FROM (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, row_number() OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1) ORDER BY label, vec_id) AS k FROM ({_POINTS})) WHERE k = 1")
def alg_best_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.best_per_cell(spatial.xy_of(table(spark, sf_dir, "embeddings")), 0.1, "label", "vec_id")
    return found.select(F.floor(F.col("x") / 0.1).alias("cx"), F.floor(F.col("y") / 0.1).alias("cy"), "vec_id", "label")


# --- reports -----------------------------------------------------------------------------------------------------

_ALL = "labels JOIN documents USING (doc_id)"


@_query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE toxic <> 0) AS n_error, round(avg(CASE WHEN toxic = 0 THEN quality END), 4) AS quality,
(SELECT string_agg(v || '=' || CAST(c AS VARCHAR), ';' ORDER BY v) FROM (SELECT coalesce(CASE WHEN n_chars % 5 <> 0 THEN lang END, '?') AS v, count(*) AS c FROM {_ALL} GROUP BY 1)) AS verdicts,
round(avg(CASE WHEN n_chars % 3 <> 0 THEN n_chars END), 4) AS mean_latency FROM {_ALL}""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("error", F.when(F.col("toxic") != 0, "toxic"))
    rows = rows.withColumn("verdict", F.when(F.col("n_chars") % 5 != 0, F.col("lang"))).withColumn("latency", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars")).otherwise(0))
    found = reports.run_summary(rows, ["quality"], "verdict", "latency")
    said = F.array_join(F.transform(F.map_entries("verdicts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return found.select("n", "n_error", "quality", said.alias("verdicts"), "mean_latency")


@_query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY 1)
SELECT e.event_id, e.event_type FROM events e JOIN q USING (event_type) WHERE e.value < b + 1.5 * (c - a + 4)""")
def outlier_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.iqr_cut(table(spark, sf_dir, "events"), "event_type", "value", factor=1.5).select("event_id", "event_type")


@_query("SELECT format('{:>6} {:<10} {:>12}', CAST(s_suppkey AS VARCHAR), left(s_name, 10), left(CAST(s_nationkey AS VARCHAR), 12)) AS line FROM supplier")
def fixed_width_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fixed_width(table(spark, sf_dir, "supplier"), s_suppkey=6, s_name=10, s_nationkey=12)


@_query("SELECT doc_id, CASE WHEN n_chars % 4 <> 0 THEN n_chars END AS created FROM documents ORDER BY coalesce(created, 0) DESC, doc_id LIMIT 50")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query is a report with a limit: the fifty newest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 4 != 0, F.col("n_chars")).alias("created"))
    return jobs.newest_first(docs, "created", "doc_id", most=50)


@_query("""SELECT doc_id, name FROM (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN '~$' ELSE '' END || source || CASE doc_id % 3 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.xlsx' ELSE '.xls' END AS name FROM documents)
WHERE n_chars BETWEEN 1000 AND 20000 AND ends_with(lower(name), '.xlsx') AND NOT starts_with(name, '~$')""")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 4 == 0, "~$").otherwise(""), "source", F.when(i % 3 == 0, ".XLSX").when(i % 3 == 1, ".xlsx").otherwise(".xls"))
    return table(spark, sf_dir, "documents").withColumn("name", name).where(jobs.acceptable(F.col("name"), F.col("n_chars"), ".xlsx", 1000, 20_000)).select("doc_id", "name")


# --- texts as they are -------------------------------------------------------------------------------------------

_LINK = r"""https?://[^\s\)\]>"'']+"""


@_query(f"""WITH t AS (SELECT page_id, html || ' <' || url || '> (' || url || ') and ' || replace(url, 'http:', 'https:') || '"' AS body FROM pages)
SELECT page_id, len(regexp_extract_all(body, '{_LINK}')) AS n_all, list_aggregate(list_sort(list_distinct(regexp_extract_all(body, '{_LINK}'))), 'string_agg', ' ') AS links FROM t""")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in pages with their address written in three ways."""
    u = F.col("url")
    body = F.concat("html", F.lit(" <"), u, F.lit("> ("), u, F.lit(") and "), F.replace(u, F.lit("http:"), F.lit("https:")), F.lit('"'))
    found = table(spark, sf_dir, "pages").withColumn("body", body)
    return found.select("page_id", F.size(fx.urls(F.col("body"), 1 << 30)).cast("long").alias("n_all"), F.array_join(F.sort_array(fx.all_urls(F.col("body"))), " ").alias("links"))


@_query(r"""SELECT page_id, len(n) AS n_numbers, list_aggregate(list_transform(n, lambda x: replace(x, ',', '')), 'string_agg', ' ') AS numbers
FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '\d[\d,]*\.?\d*') AS n FROM pages) WHERE len(n) > 0""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", fx.numbers(F.concat_ws(" ", "url", "html")).alias("n")).where(F.size("n") > 0)
    return found.select("page_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


_NUMBERS = r"list_transform(regexp_extract_all({x}, '\d[\d,]*\.?\d*'), lambda n: replace(n, ',', ''))"


@_query(f"""WITH n AS (SELECT page_id, {_NUMBERS.format(x='url')} AS g, {_NUMBERS.format(x="html || ' ' || CAST(page_id * 3 AS VARCHAR) || '. of 1,' || CAST(100 + page_id % 900 AS VARCHAR)")} AS t FROM pages)
SELECT page_id, CASE WHEN len(g) > 0 THEN list_has_any(g, t) END AS hit FROM n""")
def page_gold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a page's address, looked for among those of its text, some with commas or a sentence's dot."""
    i = F.col("page_id")
    text = F.concat("html", F.lit(" "), (i * 3).cast("string"), F.lit(". of 1,"), (100 + i % 900).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", fx.gold_hit(F.col("url"), text).alias("hit"))


@_query(f"""WITH r AS (SELECT page_id, 'It is ' || CAST(page_id % 40 + 800 AS VARCHAR) || ', says ' || url || ' and ' || url || ' of 1,200.' AS body FROM pages),
u AS (SELECT url, any_value(CASE WHEN page_id % 5 = 0 THEN '{citations.FAILED}' ELSE url || html || ' 1,2' || CAST(page_id % 3 AS VARCHAR) || '00' END) AS page FROM pages WHERE page_id % 3 <> 0 GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT page_id, body, unnest(regexp_extract_all(body, '{_LINK}')) AS url, unnest(range(len(regexp_extract_all(body, '{_LINK}')))) AS pos FROM r),
j AS (SELECT c.*, coalesce(replace(page, ',', ''), '') AS plain FROM c LEFT JOIN u USING (url))
SELECT page_id, CAST(pos AS INTEGER) AS pos, left(url, 160) AS url, NOT starts_with(plain, '{citations.FAILED}') AS resolves,
CASE WHEN starts_with(plain, '{citations.FAILED}') THEN '' ELSE coalesce(list_aggregate(list_slice(list_filter({_NUMBERS.format(x='body')}, lambda n: length(n) >= 3 AND contains(plain, n)), 1, 4), 'string_agg', ';'), '') END AS numbers FROM j""")
def page_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a page twice, with numbers that its own text may have; some pages failed or were never fetched."""
    i, url = F.col("page_id"), F.col("url")
    pages = table(spark, sf_dir, "pages")
    runs = pages.select("page_id", F.concat(F.lit("It is "), (i % 40 + 800).cast("string"), F.lit(", says "), url, F.lit(" and "), url, F.lit(" of 1,200.")).alias("body"))
    body = F.when(i % 5 == 0, F.lit(citations.FAILED)).otherwise(F.concat(url, F.col("html"), F.lit(" 1,2"), (i % 3).cast("string"), F.lit("00")))
    known = pages.where("page_id % 3 <> 0").groupBy("url").agg(F.first(body).alias("body"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    found = citations.citations(runs, known, ["page_id"])
    return found.withColumn("numbers", F.array_join("numbers", ";"))


_SAID = "SELECT conv_id, turn, replace(replace(replace(text, 'ou', 'which'), 'pa.', 'pa?'), 'la', 'not available') AS text FROM conversations"
_ASK = r"(?i)(which|what|where|could you|can you|please (tell|share|clarify)|need to know)[^.]{0,60}\?"
_LACK = r"(?i)(not (publicly )?(available|collected|published)|no (official|public) (data|source|statistics)|does ?n.t exist|couldn.t find|could not find|isn.t tracked|not tracked)"


@_query(rf"""WITH s AS ({_SAID}) SELECT conv_id, turn, regexp_matches(text, '{_ASK}') AS asked, regexp_matches(text, '{_LACK}') AS no_data,
trim(regexp_replace(right(text, 80), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS ending FROM s""")
def turn_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints in every turn of the conversations, in which some syllables stand for the words that the hints look for."""
    t = F.col("text")
    for old, new in (("ou", "which"), ("pa.", "pa?"), ("la", "not available")):
        t = F.replace(t, F.lit(old), F.lit(new))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("text"))
    return said.select("conv_id", "turn", F.col("text").rlike(fx.ASK_BACK).alias("asked"), F.col("text").rlike(fx.NO_DATA).alias("no_data"), fx.excerpt_end(F.col("text"), 80).alias("ending"))


@_query("""SELECT doc_id, starts_with(ltrim(t, ' '), '#') AS heading FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  # ' WHEN 1 THEN '' ELSE '> #' END || text AS t FROM documents)""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    text = F.concat(F.when(i == 0, "  # ").when(i == 1, "").otherwise("> #"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", integrity.starts_with_heading(text).alias("heading"))


@_query("""WITH h AS (SELECT doc_id, lower(sha256(text)) AS sha FROM documents)
SELECT a.doc_id, CASE WHEN b.sha IS NULL THEN 'missing' WHEN b.sha <> a.sha THEN 'changed' ELSE 'ok' END AS status
FROM h a LEFT JOIN (SELECT doc_id - 1 AS doc_id, sha FROM h) b USING (doc_id)""")
def manifest_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document checked against the next one, so equal neighbours are ok and the last is missing."""
    docs = table(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    listed, found = integrity.manifest(docs, "name", "text"), integrity.manifest(docs.withColumn("name", (F.col("doc_id") - 1).cast("string")), "name", "text")
    return integrity.check_manifest(listed, found).select(F.col("name").cast("long").alias("doc_id"), "status")


_ESCAPED = "replace(replace(replace(replace('*' || html || '*', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
for _pattern, _html in (("`([^`]+)`", "<code>\\1</code>"), (r"\*\*([^*]+)\*\*", "<strong>\\1</strong>"), (r"\*([^*]+)\*", "<em>\\1</em>"), (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="\\2">\\1</a>')):
    _ESCAPED = f"regexp_replace({_ESCAPED}, '{_pattern}', '{_html}', 'g')"


@_query(f"SELECT page_id, {_ESCAPED} AS html FROM pages")
def md_escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as emphasised text, with whatever marks they have of their own."""
    return table(spark, sf_dir, "pages").select("page_id", fx.inline_markdown(F.concat(F.lit("*"), "html", F.lit("*"))).alias("html"))


@_query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS line, true AS shape_ok,
replace(trim(regexp_replace(t, '[\\r\\n]+', ' ', 'g'), ' '), '`', '') AS back FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def csv_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a CSV field, line breaks kept in quotes; and, on one line, as a field and back."""
    docs = table(spark, sf_dir, "documents")
    flat = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " "))
    back = docs.select("doc_id", fx.csv_line(F.col("doc_id"), F.col("text")).alias("line"), fx.csv_fields(fx.csv_line(F.col("doc_id"), flat), 2).alias("f"))
    return back.select("doc_id", "line", "f.shape_ok", F.get("f.values", F.lit(1)).alias("back"))


# --- forms -------------------------------------------------------------------------------------------------------


@_query("SELECT event_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(CASE WHEN event_id % 3 = 0 THEN '{\"label::' || event_type || '\": 1}' ELSE props END)) AS key FROM events) GROUP BY 1, 2")
def header_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that rows of each kind have, with the number of rows that have them."""
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"label::'), "event_type", F.lit('": 1}'))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json(props, "map<string,string>").alias("fields"))
    names = forms.header_names(rows, "event_type")
    counted = rows.select("event_type", F.explode(F.map_keys("fields")).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumnRenamed("name", "key").join(counted, ["event_type", "key"])


@_query("SELECT source, count(DISTINCT lang) FILTER (WHERE lang <> 'en') AS languages FROM documents GROUP BY 1")
def form_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as forms whose rows have a label in the language of each document, and a plain one for English."""
    name = F.when(F.col("lang") == "en", "label").otherwise(F.concat(F.lit("label::"), "lang"))
    sheets = table(spark, sf_dir, "documents").where("lang is not null").select("source", F.create_map(name, F.lit("x"), F.lit("type"), F.lit("text")).alias("fields"))
    return forms.languages(forms.header_names(sheets, "source"), "source")


_FORM_TYPES = ["text", "select_one x", "select_multiple x", "image", "file", "barcode", "integer", "begin_repeat", "end_repeat", "geopoint", "note"]


@_query(f"""WITH t AS (SELECT o_custkey AS form, o_orderkey AS pos, {_FORM_TYPES}[CAST(1 + o_orderkey * 7 % 11 AS BIGINT)] AS type, o_orderkey % 5 = 0 AS c FROM orders)
SELECT form, count(*) FILTER (WHERE type IN ('text', 'integer', 'select_one x', 'select_multiple x')) AS questions, count(*) FILTER (WHERE type IN ('image', 'file', 'barcode', 'geopoint')) AS media,
count(*) FILTER (WHERE type = 'select_one x') AS select_one, count(*) FILTER (WHERE c) AS cascading FROM t GROUP BY 1""")
def form_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as forms, their orders as questions of eleven kinds."""
    kind = F.array(*[F.lit(t) for t in _FORM_TYPES])[(F.col("o_orderkey") * 7 % 11).cast("int")]
    blank = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("pos"), kind.alias("type"), blank.alias("relevant"), blank.alias("constraint"), F.when(F.col("o_orderkey") % 5 == 0, "x").alias("choice_filter"))
    return forms.form_features(rows).select("form", "questions", "media", "select_one", "cascading")


_COUNTS = """SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS q, (length(html) - length(replace(html, '<a ', ''))) // 3 AS links,
(length(html) - length(replace(html, '<div', ''))) // 4 AS media, page_id % 3 AS depth, page_id % 2 AS cascading FROM pages"""


@_query(f"""WITH t AS ({_COUNTS}), r AS (SELECT *, CASE page_id % 4 WHEN 0 THEN [] WHEN 1 THEN [links] WHEN 2 THEN [links, q] ELSE [q * 4] END AS regions FROM t),
u AS (SELECT *, len(list_filter(regions, lambda n: n >= 2)) AS k, coalesce(list_filter(regions, lambda n: n >= 2)[1], 0) AS w, depth >= 2 OR media > greatest(2, q / 2) AS early FROM r)
SELECT page_id, concat_ws('; ', CASE WHEN depth >= 2 THEN 'nested repeats' END, CASE WHEN media > q / 2 THEN 'media/geo-centric' END,
  CASE WHEN cascading > 0 THEN cascading || ' cascading selects (domains become context-dependent)' END,
  CASE WHEN early OR (k = 1 AND w <= 12) THEN NULL WHEN k > 1 THEN k || ' sibling repeat groups' WHEN k = 1 THEN 'repeat has ' || w || ' columns' WHEN q >= 4 THEN 'no repeat group — card layout needed' ELSE 'too little paper-mappable content' END) AS reasons FROM u""")
def census_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda tag: F.floor((F.length("html") - F.length(F.replace("html", F.lit(tag), F.lit("")))) / len(tag)).cast("long")
    t = table(spark, sf_dir, "pages").select("page_id", count("<p>").alias("q"), count("<a ").alias("links"), count("<div").alias("media"))
    turn, none = F.col("page_id") % 4, F.array().cast("array<bigint>")
    regions = F.when(turn == 0, none).when(turn == 1, F.array("links")).when(turn == 2, F.array("links", "q")).otherwise(F.array(F.col("q") * 4))
    t = t.withColumn("regions", regions)
    return t.select("page_id", F.array_join(rules.layout_reasons(F.col("q"), F.col("media"), F.col("page_id") % 3, F.col("regions"), F.col("page_id") % 2), "; ").alias("reasons"))


@_query("SELECT l_orderkey, l_linenumber, l_orderkey % 5 IN (2, 4) AS mismatch, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def serial_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed line numbers read back right, wrong, not at all, or in another spelling."""
    line, turn = F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 5
    read = F.when(turn == 0, "").when(turn == 1, F.concat(F.lit(" "), line, F.lit(".0"))).when(turn == 2, (F.col("l_linenumber") + 1).cast("string")).when(turn == 3, F.concat(F.lit("0"), line)).otherwise("l")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.serial_mismatch(read, F.col("l_linenumber").cast("long") - 1).alias("mismatch"))
    return rows.groupBy("l_orderkey", "l_linenumber", "mismatch").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(q, '^[0-9]+([.,][0-9]+)?$') AND CAST(replace(q, ',', '.') AS DOUBLE) BETWEEN 5 AND 40 AND (CAST(replace(q, ',', '.') AS DOUBLE) % 1 = 0) OR q = '' THEN 1 ELSE 0 END) AS BIGINT) AS in_range,
CAST(sum(CASE WHEN q = '' OR lower(f) IN ('a', 'r') THEN 1 ELSE 0 END) AS BIGINT) AS in_domain FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 5 = 0 THEN replace(CAST(l_quantity + 0.5 AS VARCHAR), '.', ',') ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS q, l_returnflag AS f FROM lineitem) GROUP BY 1, 2""")
def value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities against a range of whole numbers, flags against a domain, empty cells allowed in both."""
    part = F.col("l_partkey")
    q = F.when(part % 7 == 0, "").when(part % 5 == 0, F.replace((F.col("l_quantity") + 0.5).cast("string"), F.lit("."), F.lit(","))).otherwise(F.col("l_quantity").cast("long").cast("string"))
    flag = F.when(part % 7 == 0, "").otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.in_range(q, 5, 40, whole=True).cast("long").alias("r"), rules.in_domain(flag, F.array(F.lit("a"), F.lit("R"))).cast("long").alias("d"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("in_range"), F.sum("d").alias("in_domain"))


@_query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE lower(o_orderpriority) END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'blank' WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderpriority END AS b FROM orders),
c AS (SELECT o_orderkey, a, CASE WHEN b = 'blank' THEN '' ELSE b END AS b FROM r)
SELECT o_orderkey, CASE WHEN b <> '' THEN b ELSE a END AS value, a <> '' AND b <> '' AND lower(a) <> lower(b) AS disagree FROM c""")
def two_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a cell: words for nothing go, the second reading counts, differences are marked."""
    k = F.col("o_orderkey")
    first = F.when(k % 4 == 0, "").otherwise(F.lower("o_orderpriority"))
    second = rules.clean_cell(F.when(k % 3 == 0, "blank").when(k % 5 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.agree(first, second).alias("r")).select("o_orderkey", "r.value", "r.disagree")


@_query(_JUDGED + """, s AS (SELECT form, col, count(*) FILTER (WHERE golden <> '') AS filled, round(count(*) FILTER (WHERE verdict = 'ok') / CAST(count(*) AS DOUBLE), 4) AS acc FROM j GROUP BY 1, 2)
SELECT CASE col WHEN 'customer' THEN 'int' WHEN 'date' THEN 'date' ELSE 'choice' END AS type, count(*) AS columns, round(avg(acc), 4) AS cell_acc FROM s WHERE filled > 0 AND NOT (form % 2 = 0 AND col = 'status') GROUP BY 1""")
def score_by_column_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by the type that the template gives each column; templates of even forms lack the status column."""
    scores = scoring.cell_scores(scoring.judge_cells(*_grids(spark, sf_dir)), "form", "col")
    kinds = spark.createDataFrame([("status", "choice"), ("priority", "choice"), ("customer", "int"), ("date", "date"), ("extra", "text")], "label string, type string")
    columns = scores.select("form").distinct().crossJoin(F.broadcast(kinds)).where("not (form % 2 = 0 and label = 'status')")  # a template has these five
    return forms.by_column_type(scores, columns)


@_query("SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS slug, 'PR' || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) || 'QZ2' AS form_id FROM nation WHERE n_nationkey % 3 <> 0")
def slug_form_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of names with the ids that a printed list gives them, read out of its lines; a third is not listed."""
    nation = table(spark, sf_dir, "nation").withColumn("slug", fx.slug(F.col("n_name")))
    line = F.concat(F.lit("form no. PRX, "), F.lit("PR"), F.chr(F.lit(65) + F.col("n_nationkey") % 26), F.lit("QZ2 of "), F.col("n_name"))
    listed = nation.where("n_nationkey % 3 <> 0").select("slug", fx.form_id(line).alias("form_id"))
    return forms.with_form_id(nation.select("n_name", "slug"), listed).select("n_name", "slug", "form_id")


@_query("""SELECT p_partkey, 'Read the label of ' || p_name || ' {' || p_brand || '}, size ' || p_size || '.' AS prompt FROM part""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = fx.filled("Read the label of {name} {{{brand}}}, size {size}.", name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@_query(_JUDGED + """, s AS (SELECT form, col, round(count(*) FILTER (WHERE verdict = 'ok') / CAST(count(*) AS DOUBLE), 4) AS acc FROM j GROUP BY 1, 2)
SELECT form, round(max(CASE WHEN col = 'customer' THEN acc END), 4) AS customer, round(max(CASE WHEN col = 'status' THEN acc END), 4) AS status, count(*) AS columns FROM s GROUP BY 1""")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form's scores as a map of columns, and of them the accuracies alone."""
    scores = scoring.cell_scores(scoring.judge_cells(*_grids(spark, sf_dir)), "form", "col")
    entry = F.struct("col", F.struct("total", "cell_acc").alias("score"))
    held = scores.groupBy("form").agg(F.map_from_entries(F.collect_list(entry)).alias("per_col"))  # a form has few columns
    acc = held.select("form", fx.field_of_each(F.col("per_col"), "cell_acc").alias("acc"))
    return acc.select("form", F.col("acc")["customer"].alias("customer"), F.col("acc")["status"].alias("status"), F.size("acc").cast("long").alias("columns"))


@_query("""WITH l AS (SELECT p_brand AS list_name, p_partkey AS pos, p_name AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY pos, name) AS r FROM l),
c AS (SELECT list_name, list(name ORDER BY pos, name) AS codes FROM k WHERE r <= 8 GROUP BY 1)
SELECT list_name, list_aggregate(CASE WHEN list_aggregate(list_transform(codes, lambda x: CASE WHEN length(x) > 3 THEN 0 ELSE 1 END), 'sum') = 0 AND len(list_distinct(list_transform(codes, lambda x: upper(left(x, 1))))) = len(codes) THEN list_transform(codes, lambda x: upper(left(x, 1))) ELSE codes END, 'string_agg', ';') AS domain FROM c""")
def choice_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as lists of choices, the first eight parts of each; first letters where these tell them apart."""
    choices = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list_name"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return forms.choice_lists(choices).select("list_name", F.array_join(fx.initials(F.col("codes")), ";").alias("domain"))


@_query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 7 = 0 THEN 'title is required' END, CASE WHEN p_partkey % 5 = 0 THEN 'a column has no label' END, CASE WHEN p_partkey % 3 = 0 THEN 'unknown column type' END,
CASE WHEN p_size * 2 > 60 THEN 'rows must be from 1 to 60' END, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD') THEN 'unknown orientation' END) AS errors FROM part""")
def template_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as templates with every kind of mistake, alone and together."""
    k = F.col("p_partkey")
    title = F.when(k % 7 != 0, F.col("p_name")).otherwise("  ")
    labels = F.array(F.col("p_brand"), F.when(k % 5 != 0, F.lit("Size")))
    types = F.array(F.lit("text"), F.when(k % 3 != 0, "int").otherwise("number"))
    way = F.when(F.col("p_type") == "ECONOMY", "portrait").when(F.col("p_type") == "STANDARD", "landscape").otherwise("upright")
    found = rules.template_errors(title, labels, types, F.col("p_size").cast("int") * 2, way)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "; ").alias("errors"))


@_query("""SELECT o_orderkey, pos, flag FROM (SELECT o_orderkey, 0 AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 'whole row' WHEN o_orderkey % 2 = 0 THEN 'own' END AS flag FROM orders
UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN 'whole row' END FROM orders)""")
def first_flags_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells an order: the first flag of the cell or of its row, whichever came first."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    cells = orders.select(F.lit(1).alias("form"), k.alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col"))
    flag = lambda cond, col, pos, name: orders.where(cond).select(F.lit(1).alias("form"), k.alias("row"), F.lit(col).cast("int").alias("col"), F.lit(pos).alias("pos"), F.lit(name).alias("flag"))
    flags = flag(k % 3 == 0, None, 1, "whole row").unionByName(flag(k % 2 == 0, 0, 2, "own")).unionByName(flag(k % 2 == 0, 0, 3, "later"))
    return rules.first_flags(cells, flags).select(F.col("row").alias("o_orderkey"), F.col("col").alias("pos"), "flag")


@_query(f"""WITH c AS (SELECT vec_id, vec_id // 7 AS label, round(x * 8 * (vec_id // 7 % 3)) AS x, round(y * 8 * (vec_id // 7 % 3)) AS y FROM ({_POINTS})),
d AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist FROM c a JOIN c b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, id_a, id_b, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist DESC, id_a, id_b) AS k FROM d) WHERE k = 1""")
def alg_farthest_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farthest pairs of small groups on a coarse grid, where points coincide, lie on lines and tie."""
    group = F.floor(F.col("vec_id") / 7).cast("long")
    scale = 8 * (group % 3)
    points = spatial.xy_of(table(spark, sf_dir, "embeddings")).select("vec_id", group.alias("label"), F.round(F.col("x") * scale).alias("x"), F.round(F.col("y") * scale).alias("y"))
    return spatial.farthest_pairs(points, "label", "vec_id")


@_query("""SELECT user_id, event_id, event_type || repeat('_', CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1 AS INTEGER) % 3) AS key FROM events""")
def unique_keys_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with many rows each, numbered in blocks; shown modulo three."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sequences.unique_keys(rows, "event_type", ["user_id", "event_id"], most=500, modulo=3).select("user_id", "event_id", "key")
