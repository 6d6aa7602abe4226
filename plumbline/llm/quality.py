"""Quality rules: countable base rules, and a log-likelihood ratio of hashed word n-grams.

The ratio compares two multinomials over hashed word unigrams and bigrams: one of the trusted target (documents that the
labels call good), one of the raw corpus (all documents). A document's score is the mean over its n-grams, so length
does not matter, and a fixed threshold decides. Built of DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, columns_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Trusted ids are broadcast up to this many (8 MB of longs); beyond, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _ngrams(words: Column, buckets: int) -> Column:
    """The bucket of every word and of every pair of neighbouring words."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), bucket(a, b)))
    return F.concat(F.transform(words, lambda w: bucket(w)), F.array_compact(pairs))


def llr_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 14, smoothing: float = 1.0) -> list[float]:
    """For each bucket the log ratio of its share in the trusted documents (ids in column doc_id) to that in all docs."""
    ids = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # Words come after the join, so that beyond the broadcast no more than the texts is shuffled.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(ids, F.col("__id") == F.col("__trusted"), "left")
    flagged = rows.select(_words(F.col("__text")).alias("__words"), F.col("__trusted").isNotNull().cast("long").alias("__good"))
    counts = (
        flagged.select("__good", F.explode(_ngrams(F.col("__words"), buckets)).alias("__bucket"))
        .groupBy("__bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("__good").alias("good"))
    )
    raw, good = [0] * buckets, [0] * buckets
    for row in counts.collect():  # one row a bucket at most
        raw[row["__bucket"]], good[row["__bucket"]] = row["raw"], row["good"]
    if not sum(good):
        return [0.0] * buckets
    a, b = sum(good) + smoothing * buckets, sum(raw) + smoothing * buckets
    return [math.log((g + smoothing) / a) - math.log((r + smoothing) / b) for g, r in zip(good, raw, strict=True)]


def _measures(docs: DataFrame, text_col: str, ratios: list[float]) -> DataFrame:
    """docs and the rules' columns, each with the prefix __q_ so that none can clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The ratios as one constant that the optimizer folds: no join and no Python.
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    df = docs.withColumn("__q_words", _words(text))
    n = F.size("__q_words")
    windows = F.transform(
        F.slice("__q_words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__q_words", i + 1), F.get("__q_words", i + 2)),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    df = df.withColumn("__q_windows", windows).withColumn("__q_lines", lines).withColumn("__q_grams", _ngrams(F.col("__q_words"), len(ratios)))
    # Only texts with a repeated window need its places: windows and places sorted, equal neighbours marked.
    placed = F.sort_array(F.transform("__q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__q_placed", F.when(F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"), placed))
    again = F.filter("__q_placed", lambda x, k: (x["h"] == F.get("__q_placed", k - 1)["h"]) | (x["h"] == F.get("__q_placed", k + 1)["h"]))
    df = df.withColumn("__q_again", F.transform(again, lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__q_again", lambda i: F.array(i, i + 1, i + 2)))))
    total = F.aggregate("__q_grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    # A filter on these columns would be pushed below them with their definitions written into it, and lambdas would then
    # sort a text's windows again for every window. Spark pushes no filter past a column that depends on the partition.
    pinned = lambda c: F.when(F.spark_partition_id() >= 0, c)
    measures = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__q_again").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "score": F.when(F.size("__q_grams") == 0, F.lit(0.0)).otherwise(total / F.size("__q_grams")),
    }
    return df.select(*columns_of(docs), *[pinned(c).alias(f"__q_{name}") for name, c in measures.items()])


def _rule_columns(min_words: int, max_repeat_percent: int, min_score: float) -> tuple[Column, Column]:
    failed = (F.col("__q_n_words") < min_words) | (100 * F.col("__q_n_repeat_words") > max_repeat_percent * F.col("__q_n_words"))
    return failed, ~failed & (F.col("__q_score") >= min_score)


def quality_report(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 14, min_words: int = 50, max_repeat_percent: int = 50, min_score: float = -0.1
) -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, score (mean log ratio of its n-grams) and kept.

    Words are maximal runs of other than ASCII white space. n_dup_lines: lines with a word that equal an earlier line;
    n_repeat_words: words in a three-word window that the text has at least twice, the first one included. Null texts
    have no words and so fail; repeated rows get a row each; without trusted documents every score is 0 and the base
    rules decide; an empty table gives no rows.
    """
    ratios = llr_table(docs, trusted, id_col, text_col, buckets)
    failed, kept = _rule_columns(min_words, max_repeat_percent, min_score)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _measures(rows, "text", ratios).select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in names], failed.alias("base_failed"), F.col("__q_score").alias("score"), kept.alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 14, min_words: int = 50, max_repeat_percent: int = 50, min_score: float = -0.1) -> DataFrame:
    """The rows of docs that quality_report keeps, columns as they are."""
    ratios = llr_table(docs, trusted, id_col, text_col, buckets)
    _, kept = _rule_columns(min_words, max_repeat_percent, min_score)
    return _measures(docs, text_col, ratios).where(kept).select(*columns_of(docs))
