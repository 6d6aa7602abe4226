"""URL rules by host suffix and path prefix, matched on short hash prefixes and confirmed by full digests.

Every URL is expanded into the host suffixes and path prefixes that the rules' own lengths allow, each expression is
joined to the rules on the first bytes of its SHA-256, the whole digest confirms, and the longest rule decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to this many rows; beyond, Spark joins by shuffle.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if url is null or has no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty if url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The host suffixes with path prefixes that rules can match: one for each (labels, path length) among the rules'.

    The shapes are one constant array, so the plan's size does not depend on their number.
    """
    text = json.dumps([{"k": k, "m": m} for k, m in shapes])
    known = F.from_json(F.lit(text), "array<struct<k:int,m:int>>")
    labels = F.split(host, r"\.")
    fits = F.filter(known, lambda s: (F.size(labels) >= s["k"]) & (F.length(path) >= s["m"]))
    return F.transform(fits, lambda s: F.concat(F.concat_ws(".", F.slice(labels, F.size(labels) - s["k"] + 1, s["k"])), F.lit("\n"), F.substring(path, F.lit(1), s["m"])))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (or null) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains if the url's path starts with the rule's path;
    of those that fit the one with the longest host and path wins, then by verdict (block first) and rule. No rule gives
    `default`. Null urls and urls without :// have an empty host and path, which fit a rule of an empty host only.
    Repeated rows get a row each; an empty table of rules allows all, an empty table of pages gives no rows. Very long
    urls cost what the rules' own lengths cost; other columns are ignored, whatever their names.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    labels = F.size(F.split("r_host", r"\."))
    shape = rules.agg(F.collect_set(F.struct(labels.alias("labels"), F.length("r_path").alias("path"))).alias("s"), F.count(F.lit(1)).alias("n")).first()
    shapes = sorted((s["labels"], s["path"]) for s in shape["s"])
    # Equal rows are judged once. This is the only shuffle of all urls: what follows is grouped by the same columns.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("page_id", "url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    expanded = rows.select("page_id", "url", "n", "host", "path", F.explode_outer(_expressions(F.col("host"), F.col("path"), shapes)).alias("tried"))
    hashed = expanded.withColumn("digest", F.sha2(F.col("tried").cast("binary"), 256)).withColumn("short", F.substring("digest", 1, prefix_digits))
    r_digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path").cast("binary"), 256)
    keyed = rules.withColumn("r_digest", r_digest).withColumn("r_short", F.substring("r_digest", 1, prefix_digits))
    keyed = F.broadcast(keyed) if shape["n"] <= BROADCAST_RULES else keyed
    matched = hashed.join(keyed, F.col("short") == F.col("r_short"), "left")
    fits = F.col("digest") == F.col("r_digest")
    best = F.max(F.when(fits, F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))))
    judged = matched.groupBy("page_id", "url", "n", "host", "path").agg(best.alias("best"))
    each = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.drop("copy")
