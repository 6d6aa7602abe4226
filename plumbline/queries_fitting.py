"""Registered queries of percentiles, fitted lines, shares, table columns and pruning; each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import fitting, forms, jobs
from plumbline.registry import query as _query
from plumbline.sources.catalog import table


@_query("""SELECT source, count(text) AS texts, quantile_cont(length(text), 0.1) AS p10, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90, CAST(max(length(text)) AS DOUBLE) AS longest
FROM documents GROUP BY 1 HAVING count(text) > 0""")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the lengths of each source's texts."""
    lengths = table(spark, sf_dir, "documents").select("source", F.length("text").alias("n"))
    found = fitting.percentiles(lengths, "source", "n", [0.1, 0.5, 0.9, 1.0], "p").withColumnRenamed("source", "of")
    texts = lengths.groupBy("source").agg(F.count("n").alias("texts"))
    return texts.join(found, F.col("source").eqNullSafe(F.col("of"))).select("source", "texts", *[F.col("p")[k].alias(c) for k, c in enumerate(("p10", "p50", "p90", "longest"))])


# One refit in SQL: lines, distances, the percentile by rank, and the line of the points under the limit.
_REFIT = """l{k} AS (SELECT lang, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS used FROM {points} GROUP BY 1),
o{k} AS (SELECT p.lang, x, y, abs(a + b * x - y) AS off FROM p JOIN l{k} ON l{k}.lang IS NOT DISTINCT FROM p.lang),
n{k} AS (SELECT lang, off, row_number() OVER (PARTITION BY lang ORDER BY off) - 1 AS r, (count(*) OVER (PARTITION BY lang) - 1) * CAST(0.8 AS DOUBLE) AS pos FROM o{k}),
q{k} AS (SELECT lang, greatest(4.0, max(off) FILTER (WHERE r = floor(pos)) + (max(off) FILTER (WHERE r = ceil(pos)) - max(off) FILTER (WHERE r = floor(pos))) * (max(pos) - floor(max(pos)))) AS lim FROM n{k} GROUP BY 1),
k{k} AS (SELECT o{k}.lang, x, y FROM o{k} JOIN q{k} ON q{k}.lang IS NOT DISTINCT FROM o{k}.lang WHERE off < lim),
"""


@_query(
    "WITH p AS (SELECT lang, CAST(length(text) AS DOUBLE) AS x, CAST(len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS DOUBLE) AS y FROM documents WHERE text IS NOT NULL),\n"
    + _REFIT.format(k=1, points="p") + _REFIT.format(k=2, points="k1")
    + "z AS (SELECT lang, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS used FROM k2 GROUP BY 1)\n"
    "SELECT p.lang, count(*) AS n, any_value(z.used) AS used, round(any_value(z.a), 4) AS intercept, round(any_value(z.b), 6) AS slope FROM p JOIN z ON z.lang IS NOT DISTINCT FROM p.lang GROUP BY 1"
)
def words_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How words grow with characters in the texts of each language, fitted twice again without texts that lie far off."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), 0))
    points = table(spark, sf_dir, "documents").where("text is not null").select("lang", F.length("text").alias("x"), words.alias("y"))
    found = fitting.robust_lines(points, "lang", "x", "y", refits=2)
    return found.select("lang", "n", "used", F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"))


@_query("""WITH s AS (SELECT *, l_quantity * 416.0 / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS plain, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
f AS (SELECT *, greatest(plain, 26.0) AS fixed FROM s),
t AS (SELECT *, sum(fixed) OVER (PARTITION BY l_orderkey) - 416.0 AS over_, sum(fixed - 26.0) OVER (PARTITION BY l_orderkey) AS red FROM f)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN 26.0 * n > 416.0 THEN NULL ELSE round(fixed - CASE WHEN red = 0 THEN 0 ELSE over_ * (fixed - 26.0) / red END, 6) END AS width FROM t""")
def line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A width of 416 shared among the lines of each order by their quantities, none under 26."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    found = fitting.shares_with_floor(lines, "l_orderkey", "l_quantity", 416.0, 26.0, "width")
    return found.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("width", 6).alias("width"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labels do not know, as names that a mirror would drop."""
    return jobs.prunable(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@_query("""WITH q AS (SELECT o_custkey AS form, CASE o_orderstatus WHEN 'O' THEN 'integer' WHEN 'F' THEN 'select_one L' || o_custkey % 7 ELSE 'note' END AS type FROM orders),
t AS (SELECT form, CASE type WHEN 'integer' THEN 'int' WHEN 'select_one L0' THEN 'yn' WHEN 'note' THEN NULL ELSE 'choice' END AS type FROM q WHERE type NOT IN ('select_one L5', 'select_one L6'))
SELECT form, type, CASE type WHEN 'int' THEN 'amount' ELSE 'code' END AS kind, count(*) AS columns FROM t WHERE type IS NOT NULL GROUP BY 1, 2""")
def template_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions of their customer's form: what columns a table of each form gets, and what these hold."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "O", "integer").when(status == "F", F.concat(F.lit("select_one L"), F.col("o_custkey") % 7)).otherwise("note")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("label"), kind.alias("type"))
    region = F.col("n_regionkey")  # a list a region; the first one is yes and no
    name = F.when(region == 0, F.when(F.col("n_nationkey") % 2 == 0, "Yes").otherwise("no")).otherwise(F.col("n_name"))
    choices = table(spark, sf_dir, "nation").select(F.concat(F.lit("L"), region).alias("list_name"), F.col("n_nationkey").alias("pos"), name.alias("name"))
    columns = forms.table_columns(rows, choices).withColumn("kind", forms.value_kind(F.col("type")))
    return columns.groupBy("form", "type", "kind").agg(F.count(F.lit(1)).alias("columns"))
