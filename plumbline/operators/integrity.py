"""Checks of manifests, links, identifiers and published pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of entries with a time stamp, and of older ones.
STAMPED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{4}-[a-z0-9-]+\.md$"
NUMBERED = r"^[0-9]{2,}-[a-z0-9-]+\.md$"


def entry_kind(name: Column) -> Column:
    return F.when(name.rlike(STAMPED), "stamped").when(name.rlike(NUMBERED), "numbered").otherwise("other")


def starts_with_heading(text: Column) -> Column:
    return F.ltrim(text).startswith("#")


def manifest(files: DataFrame, name: str, content: str) -> DataFrame:
    """(name, sha256, bytes) of contents."""
    raw = F.col(content).cast("binary")
    return files.select(F.col(name).alias("name"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"))


def check_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status) of every listed file: ok, missing or changed. A file that is there without contents is not missing."""
    there = found.select("name", F.col("sha256").alias("__sha"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "missing").when(~F.col("__sha").eqNullSafe(F.col("sha256")), "changed").otherwise("ok")
    return listed.join(there, "name", "left").select("name", status.alias("status"))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def element_ids(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('\\bid="([^"]*)"'), F.lit(1))


def local_path(href: Column) -> Column:
    """The path of a link within the site, without query and fragment; null if it leads elsewhere."""
    path = F.regexp_extract(href, "^([^?#]*)", 1)
    return F.when(~href.contains("://") & ~href.startswith("mailto:") & (path != ""), path)


def broken_links(links: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """The links (any columns, with `path`) that lead to no known path; null paths are not looked at."""
    return links.where(F.col(path).isNotNull()).join(known.select(path).distinct(), path, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of those that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def safe_path(path: Column) -> Column:
    """Relative, and never up a folder."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def publishable(pages: DataFrame, status: str, path: str, withheld: DataFrame) -> DataFrame:
    """Published pages with safe paths that are not under any withheld path."""
    return pages.where((F.col(status) == "published") & safe_path(F.col(path))).join(withheld.select(path).distinct(), path, "left_anti")
