"""Checks of answers in prose: their links against fetched pages, their numbers against known ones, hints to their outcome."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as fx

#: What a page that could not be fetched begins with, and the most bytes that are kept of one.
FAILED, MOST = "__FETCH_FAIL__", 400_000
#: Most characters of short passages that are broadcast; more of them meet the texts without one.
BROADCAST = 2_000_000


def fetched(urls: DataFrame, fetch: Callable[[str], str], column: str = "url", retries: int = 0, wait: float = 2.0) -> DataFrame:
    """(url, body) of the distinct links; fetch runs in the tasks, and what it raises becomes a failed body.

    A call that fails is made again up to `retries` times, after wait, 2 x wait, ... seconds. A task that is run again
    fetches again, so fetch must bear that; a model is called in the same way, with its prompt as the url.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def body(url: str) -> str:
            for attempt in range(retries + 1):
                try:
                    return fetch(url).encode("utf-8", "replace")[:MOST].decode("utf-8", "ignore")
                except Exception as e:  # noqa: BLE001  any failure is a result here
                    failure = e
                    if attempt < retries:
                        time.sleep(wait * (attempt + 1))
            return f"{FAILED} {failure}"

        for batch in batches:
            yield pd.DataFrame({"url": batch["url"], "body": [body(u) for u in batch["url"]]})

    return urls.select(F.col(column).alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, body string")


def replayed(requests: DataFrame, recorded: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """requests with the recorded answer of each, and `error` where there is none; nothing is called."""
    joined = requests.join(recorded.select(*keys, answer), keys, "left")
    return joined.withColumn("error", F.when(F.col(answer).isNull(), "not recorded"))


def with_question(runs: DataFrame, bank: DataFrame, key: str = "qid") -> DataFrame:
    """runs with the columns of their question; fails, as it runs, on a run whose question the bank lacks."""
    known = bank.withColumn("__known", F.lit(True))
    joined = runs.join(known, key, "left")
    return joined.withColumn(key, F.when(F.col("__known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no such question: "), F.col(key))))).drop("__known")


def citations(runs: DataFrame, pages: DataFrame, keys: list[str], text: str = "body", links: int = 8, shown: int = 4, by: list[str] | None = None, linked: bool = True) -> DataFrame:
    """(keys, pos, url, resolves, numbers): each of the first `links` links of a run, in order and with repeats.

    numbers: up to `shown` numbers of the run, of three characters or more, that the page contains once its commas are
    gone. A link without a page resolves, but contains nothing. `by`: those of the keys that pages has as well, where
    each run's pages were fetched for it alone. Of several pages of one link the smallest body counts, a failed one last.
    Without `linked`, numbers that are part of a link are not numbers of the run.
    """
    own = by or []
    prose = F.col(text) if linked else F.regexp_replace(text, fx.URL, " ")
    said = F.filter(fx.numbers(prose), lambda n: F.length(n) >= 3)
    cited = runs.select(*keys, said.alias("said"), F.posexplode(fx.urls(F.col(text), links)).alias("pos", "url"))
    bodies = pages.groupBy(*own, "url").agg(F.min_by("body", F.struct(F.col("body").startswith(FAILED), "body")).alias("body"))
    bodies = bodies.select(*own, "url", F.replace("body", F.lit(","), F.lit("")).alias("plain"))
    joined = cited.join(bodies, [*own, "url"], "left").withColumn("plain", F.coalesce("plain", F.lit("")))
    resolves = ~F.col("plain").startswith(FAILED)
    there = F.slice(F.filter("said", lambda n: F.contains(F.col("plain"), n)), 1, shown)
    return joined.select(*keys, "pos", F.left("url", F.lit(160)).alias("url"), resolves.alias("resolves"), F.when(resolves, there).otherwise(F.array().cast("array<string>")).alias("numbers"))


def run_features(runs: DataFrame, gold: str = "gold", text: str = "body") -> DataFrame:
    """runs with gold_num_present (null without a gold number), n_citations, askback_hint, nodata_hint, chars, ending."""
    t = F.col(text)
    return (
        runs.withColumn("gold_num_present", fx.gold_hit(F.coalesce(F.col(gold).cast("string"), F.lit("")), t)).withColumn("n_citations", F.size(fx.urls(t)).cast("long"))
        .withColumn("askback_hint", t.rlike(fx.ASK_BACK)).withColumn("nodata_hint", t.rlike(fx.NO_DATA)).withColumn("chars", F.length(t).cast("long")).withColumn("ending", fx.excerpt_end(t))
    )


def digest(features: DataFrame, *order: str) -> DataFrame:
    """(entry) one Markdown block per run, in order."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    title = F.concat_ws(" / ", *[F.col(c).cast("string") for c in order])
    auto = F.format_string("auto: gold_num=%s cites=%s ask=%s nodata=%s", shown("gold_num_present"), shown("n_citations"), shown("askback_hint"), shown("nodata_hint"))
    return features.orderBy(*order).select(F.concat(F.lit("### "), title, F.lit("\n"), auto, F.lit("\n"), F.col("ending")).alias("entry"))


def _triples(words: Column) -> Column:
    """(size, key) of every three words in a row."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.struct(
        (F.length(w) + F.length(F.get(words, i + 1)) + F.length(F.get(words, i + 2))).alias("size"), F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("key")
    ))


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """(doc_id, item_id): each row of docs with each row of items whose whole text it contains; every text contains the empty one.

    A passage's first and last word may go on in the document, the words between them cannot. Passages with three of
    these or more are looked up by the longest three in a row; shorter ones are compared with every document. Repeated
    rows and null ids count as in a join; a null text contains nothing and is in nothing.
    """
    split = lambda c: F.split(c, r"\s+", -1)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    passages = items.select(F.col(text).alias("passage")).where("passage is not null").distinct().withColumn("words", split(F.col("passage")))
    passages = passages.select("passage", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))).alias("words"))
    short = passages.where(F.size("words") < 3).select("passage")
    long = passages.where(F.size("words") >= 3).select("passage", F.array_max(_triples(F.col("words")))["key"].alias("key"))
    # Ids alone go through the join on keys; the texts are looked at only where a key is shared.
    keys = texts.select("doc_id", split(F.col("text")).alias("words")).select("doc_id", F.explode(F.array_distinct(F.transform(_triples(F.col("words")), lambda t: t["key"]))).alias("key"))
    pairs = keys.join(long, "key").select(F.col("doc_id").alias("id"), "passage").distinct()
    found = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("id"))).where(F.contains("text", "passage")).select("doc_id", "passage")
    n, size = short.agg(F.count(F.lit(1)), F.sum(F.length("passage") + 16)).first()
    if n:
        few = short.hint("broadcast" if size <= BROADCAST else "shuffle_replicate_nl")
        found = found.unionByName(texts.join(few, F.contains("text", "passage")).select("doc_id", "passage"))
    return found.join(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("passage")), "passage").select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
