"""Exact deduplication by a log-structured merge index of text digests.

Each task fills a memtable (digest to smallest id and count) and flushes it as a run sorted by digest. Compaction merges
the runs of each range of digests in their order, keeping the smallest identifier, into one run a range; a range's run has
a Bloom filter of the digests that several documents have, as large as their number asks for. A second scan probes the
filters and sends on only the texts that pass, and each hit is compared byte by byte with the text that it would repeat.
Digests that turn out to cover different texts are grouped by the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, columns_of, durable, rows_of

#: Bits in one aggregated bitmap of Spark SQL; hash functions of a filter and its bits a digest (1 % pass by chance).
_BITMAP, _HASHES, _BITS_EACH = 32768, 7, 10
#: Ranges of digests, by their first three hexadecimal digits.
_RANGES = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def flush_runs(entries: DataFrame, memtable_rows: int = 200_000) -> DataFrame:
    """(digest, keep_id, n): sorted runs of at most memtable_rows digests, from rows (digest, doc_id, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            keys = sorted(table)
            columns = [pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], id_type), pa.array([table[k][1] for k in keys], pa.int64())]
            table.clear()
            return pa.RecordBatch.from_arrays(columns, ["digest", "keep_id", "n"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(1).type
            for digest, doc_id, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (held := table.get(digest)) is None:
                    table[digest] = [doc_id, m]
                    if len(table) >= memtable_rows:
                        yield flush()
                else:
                    held[0] = doc_id if held[0] is None or doc_id is not None and doc_id < held[0] else held[0]
                    held[1] += m
        if table:
            yield flush()

    kind = entries.schema["doc_id"].dataType.simpleString()
    return entries.select("digest", "doc_id", "m").mapInArrow(run, f"digest binary, keep_id {kind}, n long")


def digest_range(digest: Column) -> Column:
    """The number of a digest's range; ranges are in the order of digests."""
    return F.conv(F.substring(F.rpad(F.hex(digest), 3, "0"), 1, 3), 16, 10).cast("int")


def compact(runs: DataFrame) -> DataFrame:
    """One run a range of (digest, keep_id, n): the smallest id and the whole count of each digest of all runs.

    The runs of a range meet sorted, as Spark's sort merges them, and are walked through once; a digest that a third of
    all documents have is one row of each flushed run, so no range grows with it.
    """
    merged = runs.withColumn("range", digest_range(F.col("digest"))).repartition("range").sortWithinPartitions("digest").drop("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, total = None, None, 0
        for batch in batches:
            out = []
            for digest, keep_id, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest == last:
                    least = keep_id if least is None or keep_id is not None and keep_id < least else least
                    total += n
                else:
                    if last is not None:
                        out.append((last, least, total))
                    last, least, total = digest, keep_id, n
            if out:
                yield _rows(out, batch.schema)
        if last is not None:
            yield _rows([(last, least, total)], batch.schema)

    return merged.mapInArrow(run, runs.select("digest", "keep_id", "n").schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)


@dataclass
class DigestFilter:
    """Bloom filters of the ranges, one after the other: where each begins, how many bits it has, all bits."""

    starts: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray


def _spots(digest: Column, starts: np.ndarray, sizes: np.ndarray) -> Column:
    """Where a digest's bits are in the filter of its range; null where the range has none."""
    constant = lambda values: F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")
    start, size = F.get(constant(starts), digest_range(digest)), F.nullif(F.get(constant(sizes), digest_range(digest)), F.lit(0))
    return F.array(*[start + F.pmod(F.xxhash64(digest, F.lit(j)), size) for j in range(_HASHES)])


def digest_filter(digests: DataFrame, most_bytes: int) -> DigestFilter | None:
    """Filters over column digest, sized by the number of rows in each range; None if they would exceed most_bytes."""
    counts = digests.groupBy(digest_range(F.col("digest")).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a range
    sizes = np.zeros(_RANGES, np.int64)
    for row in counts:
        sizes[row["r"]] = -(-row["n"] * _BITS_EACH // 64) * 64
    if sizes.sum() > most_bytes * 8:
        return None
    starts = np.cumsum(sizes) - sizes
    spots = digests.select(F.explode(_spots(F.col("digest"), starts, sizes)).alias("spot"))
    parts = spots.groupBy(F.floor(F.col("spot") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("spot") % _BITMAP).alias("bitmap"))
    whole = np.zeros((int(-(-sizes.sum() // _BITMAP)), _BITMAP // 8), np.uint8)
    for row in parts.collect():  # most_bytes in rows of 4 KB, at most
        whole[row["part"]] = np.frombuffer(row["bitmap"], np.uint8)
    return DigestFilter(starts, sizes, whole.reshape(-1))


def may_hold(digest: Column, spark, found: DigestFilter | None) -> Column:
    """Whether the filter may hold a digest: always true for those that it was built from, and without a filter."""
    if found is None:
        return F.lit(True)
    held = spark.sparkContext.broadcast(found.bits)  # its size was checked as it was made

    @F.pandas_udf("boolean")
    def test(spots):
        import pandas as pd

        none = spots.map(lambda s: s is None or s[0] is None or s[0] != s[0])
        at = np.array([np.zeros(_HASHES, np.int64) if skip else s for s, skip in zip(spots, none, strict=True)], np.int64).reshape(-1, _HASHES)
        bits = held.value if len(held.value) else np.zeros(1, np.uint8)
        return pd.Series((bits[at >> 3] >> (at & 7) & 1).all(axis=1) & ~none.to_numpy(bool))

    spots = _spots(digest, found.starts, found.sizes)
    return test(F.when(F.get(spots, F.lit(0)).isNotNull(), spots))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 200_000, filter_bytes: int = 64 << 20, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as empty. The row
    with the smallest doc_id of equal texts stays. Of repeated rows with that id one stays; null ids come last, and a
    group of nothing but null ids has a null keep_id and keeps one row. An empty table gives no rows; other columns are
    ignored. `digest_bytes` is the part of the SHA-256 that serves as key; texts are compared, so any length is exact.
    `filter_bytes`: up to this size (50 million repeated texts) the filters are broadcast; beyond it all texts are joined.
    """
    spark = docs.sparkSession
    whole = rows_of(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    hashed = whole.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    hashed = hashed.withColumn("digest", F.unhex(F.substring("text_sha256", 1, 2 * digest_bytes)))
    entries = durable(hashed.groupBy("doc_id", "digest", "text_sha256").agg(F.count(F.lit(1)).alias("m")))

    index = durable(compact(flush_runs(entries, memtable_rows)))
    multi = index.where("n > 1").withColumnRenamed("digest", "key")
    found_by = digest_filter(multi.select(F.col("key").alias("digest")), filter_bytes)

    # The texts that may have a copy, the filter's few false positives dropped by the join.
    maybe = hashed.where(may_hold(F.col("digest"), spark, found_by))
    texts = durable(maybe.join(multi, F.col("digest") == F.col("key")).select("doc_id", "digest", "norm", "keep_id"))
    keepers = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("digest").alias("key"), F.col("norm").alias("kept_norm"))
    # Written down, so that the comparison is a join of two plain shuffles, whose hot digests Spark can split.
    keepers = durable(keepers.dropDuplicates(["key"]))
    clashes = texts.join(keepers, F.col("digest") == F.col("key")).where("norm <> kept_norm").select("digest")
    found = entries.join(index.where("n > 1"), "digest", "left")
    found = found.select("doc_id", "text_sha256", "m", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", "m").alias("n"))
    if clashes.limit(1).count():
        # Different texts with one key: their documents are grouped by the texts themselves.
        clashes = durable(clashes.distinct())
        apart = durable(texts.join(clashes, "digest", "left_semi").withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)))
        exact = apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        again = apart.drop("keep_id").join(exact, ["digest", "norm"]).groupBy("doc_id", "text_sha256", "norm", "digest", "keep_id", "n").agg(F.count(F.lit(1)).alias("m"))
        found = found.join(clashes, "digest", "left_anti").select("doc_id", "text_sha256", "m", "keep_id", "n").unionByName(again.select("doc_id", "text_sha256", "m", "keep_id", "n"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat an equal text with a smaller id; columns stay as they are.

    Of rows that repeat both id and text one stays, the one whose other columns come first as JSON.
    """
    decided = exact_groups(docs, id_col, text_col)
    dropped = durable(decided.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__again")).distinct())
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    keys = F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    rest = docs.join(dropped.where("not __again"), keys, "left_anti")
    again = dropped.where("__again")
    if again.limit(1).count() == 0:
        return rest
    from pyspark.sql import Window

    order = Window.partitionBy("__id", "__sha").orderBy("__order")
    repeated = rest.join(again.drop("__again"), keys).withColumn("__order", F.to_json(F.struct(*columns_of(docs))))
    first = repeated.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*columns_of(docs))
    return rest.join(again, keys, "left_anti").unionByName(first)
