"""WARC archives written and read as a chunked record table.

A payload becomes rows of record identifier and chunk number; each row is one WARC record of its own (the first a
response, the rest continuation segments), so no writer or reader holds more than a chunk beyond the payload's own column.
Archives are plain files of Spark's text writer, whose line separator is the blank lines that end a WARC record; they
are read by splitting at the start of the next record, on any file system that Spark reads. Chunks never hold the mark
that a record begins with, as a payload is cut inside each place where it occurs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from plumbline.llm.common import checkpoint_dir, durable
from plumbline.llm.exact_dedup import digest_filter, may_hold

#: Format of WARC 1.1: what begins a record, what ends it.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
_SPLIT, _MARK = END + VERSION, VERSION.strip()


def record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = 100, filter_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, payload, payload_bytes, payload_digest, record_type, refers_to), a row for each row of pages.

    Of records with equal payloads of at least min_revisit bytes the one with the smallest id is the response and the
    others revisit it; smaller payloads are all responses. A null payload is empty. Rows that repeat that smallest id
    are responses too; null ids come last, and if a group has no other, all are responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), payload.alias("payload"))
    sized = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.col("payload_bytes") >= min_revisit
    index = sized.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    index = durable(index.where("n > 1").select(F.col("payload_digest").alias("digest"), "first"))
    # Only payloads that pass a filter of the repeated digests go through the join; the others stay where they are.
    maybe = large & may_hold(F.unhex("payload_digest"), pages.sparkSession, digest_filter(index.select(F.unhex("digest").alias("digest")), filter_bytes))
    alone = sized.where(~maybe).withColumn("first", F.lit(None).cast(pages.schema[id_col].dataType))
    joined = sized.where(maybe).join(index, F.col("payload_digest") == F.col("digest"), "left").drop("digest").unionByName(alone)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record_name(page_id: Column, digest: Column) -> Column:
    """A record's name: its page's id, escaped so that any id comes back whole (~ stands for null), and its digest."""
    return F.concat(F.coalesce(F.url_encode(page_id.cast("string")), F.lit("~")), F.lit(":"), digest)


def repeated_ids(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(again_id) the ids, null included, that several rows have; written down."""
    counted = pages.groupBy(F.col(id_col).alias("again_id")).agg(F.count(F.lit(1)).alias("n"))
    return durable(counted.where("n > 1").select("again_id"))


def _named(records: DataFrame, again: DataFrame) -> DataFrame:
    """records with record_id; of rows with one id and one payload, all but the first get a number as well.

    Rows are only moved where ids repeat, and then only those rows.
    """
    named = records.withColumn("record_id", _record_name(F.col("page_id"), F.col("payload_digest")))
    if again.limit(1).count() == 0:
        return named
    same = F.col("page_id").eqNullSafe(F.col("again_id"))
    turn = F.row_number().over(Window.partitionBy("record_id").orderBy("record_type"))
    repeated = named.join(again, same, "left_semi").withColumn("turn", turn)
    suffix = F.when(F.col("turn") > 1, F.concat(F.lit(":"), F.col("turn"))).otherwise(F.lit(""))
    return named.join(again, same, "left_anti").unionByName(repeated.withColumn("record_id", F.concat("record_id", suffix)).drop("turn"))


@F.pandas_udf(ArrayType(IntegerType()))
def _cuts(payloads: pd.Series) -> pd.Series:
    """Where a payload is cut so that no chunk has a whole version mark: two bytes into each, in one pass."""
    mark = re.compile(re.escape(_MARK.encode()))
    return payloads.map(lambda p: [] if p is None else [m.start() + 2 for m in mark.finditer(p)])


def chunk_rows(records: DataFrame, chunk_bytes: int = 1 << 18, again: DataFrame | None = None) -> DataFrame:
    """The records as rows of record_id, chunk_no (from 1), chunks and chunk; a revisit has one empty chunk.

    again: the repeated_ids of the records, if they are known.

    First the places of the chunks become rows, then each row takes its part of the payload, so that beside the
    payload's own column a task holds one chunk. Every row of the input is one record.
    """
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("int")
    # Where a payload has version marks, pieces end two bytes into each of them; only such payloads go to Python.
    marked = ~revisit & (F.instr(F.col("payload").cast("string"), _MARK) > 0)
    cuts = F.when(marked, _cuts(F.when(marked, F.col("payload")))).otherwise(F.array().cast("array<int>"))
    pieces = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("at"), F.concat(cuts, F.array(size)).alias("end"))
    # (first byte, length) of every chunk: each piece by size, one empty chunk for nothing.
    spans = F.flatten(F.transform(pieces, lambda p: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((p["end"] - p["at"]) / chunk_bytes).cast("int") - 1, F.lit(0))),
        lambda k: F.struct((p["at"] + k * chunk_bytes).alias("at"), F.least(F.lit(chunk_bytes), p["end"] - p["at"] - k * chunk_bytes).alias("n")),
    )))
    placed = _named(records, repeated_ids(records) if again is None else again).select("page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", spans.alias("spans"))
    rows = placed.select("*", F.size("spans").alias("chunks"), F.posexplode("spans").alias("k", "span"))
    chunk = F.substring("payload", F.col("span.at") + 1, F.col("span.n"))
    return rows.select("page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunks", chunk.alias("chunk"), (F.col("k") + 1).alias("chunk_no"))


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write the chunk rows to path as WARC files, a record a row, in the order of chunks within each record."""
    kind = F.when(F.col("chunk_no") > 1, "continuation").otherwise(F.col("record_type"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    own = F.when(F.col("chunk_no") > 1, F.concat("record_id", F.lit("/"), F.col("chunk_no"))).otherwise(F.col("record_id"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit("\r\n"))
    some = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    header = F.concat(
        F.lit(VERSION), line("WARC-Type", kind), line("WARC-Record-ID", urn(own)), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        some(F.col("refers_to").isNotNull(), line("WARC-Refers-To", urn(_record_name(F.col("refers_to"), F.col("payload_digest"))))),
        some(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        some(F.col("chunk_no") > 1, line("WARC-Segment-Origin-ID", urn(F.col("record_id")))),
        some(F.col("chunks") > 1, line("WARC-Segment-Number", F.col("chunk_no"))),
        some(F.col("chunks") == F.col("chunk_no"), line("WARC-Segment-Total-Length", F.col("payload_bytes"))),
        line("Content-Length", F.octet_length("chunk")), F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), F.col("chunk")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", END).mode("errorifexists").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of the archives: record_id, record_type, refers_to, payload_digest, chunk_no, last, chunk.

    A record whose Content-Length differs from its block fails the read.
    """
    # Every row but a file's last lacks its end, and every row but the first of a file lacks its version line.
    raw = spark.read.option("lineSep", _SPLIT).text(path).select(F.col("value").cast("binary").alias("raw"))
    raw = raw.withColumn("text", F.decode("raw", "ISO-8859-1"))
    at = F.instr("text", "\r\n\r\n")
    head = F.concat(F.lit("\r\n"), F.substring("text", F.lit(1), at + 1))
    field = lambda key: F.nullif(F.regexp_extract(head, f"\r\n{key}: ([^\r\n]*)\r\n", 1), F.lit(""))
    urn = lambda value: F.regexp_extract(value, "^<urn:page:(.*)>$", 1)
    number = F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1))
    rows = raw.select(
        F.when(field("WARC-Type") == "continuation", urn(field("WARC-Segment-Origin-ID"))).otherwise(urn(field("WARC-Record-ID"))).alias("record_id"),
        field("WARC-Type").alias("record_type"), urn(field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), number.alias("chunk_no"),
        field("WARC-Segment-Total-Length").cast("long").alias("total_bytes"), field("Content-Length").cast("int").alias("length"),
        F.substring("raw", at + 4, F.octet_length("raw")).alias("block"),
    )
    rest = F.octet_length("block") - F.col("length")
    whole = (rest == 0) | ((rest == 4) & (F.substring("block", F.col("length") + 1, F.lit(4)) == F.lit(END.encode())))
    chunk = F.when(whole, F.substring("block", F.lit(1), F.col("length"))).otherwise(F.raise_error(F.concat(F.lit("WARC record of another length than its header says: "), "record_id")))
    return rows.select("record_id", "record_type", "refers_to", "payload_digest", "chunk_no", "total_bytes", chunk.alias("chunk"))


def payload_digests(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, header_digest, payload_bytes, payload_digest) of chunk rows, a row a record.

    Records of one chunk are digested where they lie; only the chunks of longer ones are shuffled, by record, and
    digested one after the other in order of their numbers.
    """
    alone = (F.col("chunk_no") == 1) & F.col("total_bytes").isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, digest, size, first = None, None, 0, None
        names = ["record_id", "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest"]
        closed = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*first, size, digest.hexdigest()), strict=True))], schema=schema)
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        for batch in batches:
            for row in range(batch.num_rows):
                record_id, kind, refers, header, number, chunk = (c[row].as_py() for c in batch.columns)
                if record_id != kept:
                    if kept is not None:
                        yield closed()
                    kept, digest, size, first = record_id, hashlib.sha256(), 0, (record_id, kind, refers, header)
                digest.update(chunk)
                size += len(chunk)
        if kept is not None:
            yield closed()

    single = chunks.where(alone).select(
        "record_id", "record_type", "refers_to", F.col("payload_digest").alias("header_digest"),
        F.octet_length("chunk").cast("long").alias("payload_bytes"), F.sha2("chunk", 256).alias("payload_digest"),
    )
    parts = chunks.where(~alone).select("record_id", "record_type", "refers_to", "payload_digest", "chunk_no", "chunk")
    ordered = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    longer = ordered.mapInArrow(run, "record_id string, record_type string, refers_to string, header_digest string, payload_bytes long, payload_digest string")
    return single.unionByName(longer)


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", chunk_bytes: int = 1 << 18) -> DataFrame:
    """Write pages to WARC files under path, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has no block; its size and digest are those of the response that it refers to, and the read fails if the
    digest in any header differs from that of the payload. Ids of any type and with any characters come back, null ids
    too; rows that repeat an id are records of their own, whatever their payloads. Null payloads are empty ones. Very
    long payloads become several records of at most chunk_bytes. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    spark = pages.sparkSession
    write_archives(chunk_rows(record_types(pages, id_col, payload_col), chunk_bytes, repeated_ids(pages, id_col)), path)
    records = durable(payload_digests(read_archives(spark, path)))
    kind = pages.schema[id_col].dataType
    own = lambda c: F.regexp_extract(c, "^([^:]*)", 1)
    as_id = lambda c: F.when(own(c) != "~", F.url_decode(own(c))).cast(kind)
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("to_id"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"))
    # Responses refer to nothing and stay out of the join, in which they would all share one null key.
    revisits = records.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("to_id"), "left")
    joined = revisits.unionByName(records.where("record_type = 'response'"), allowMissingColumns=True)
    digest = F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("payload_digest"))
    checked = F.when(digest == F.col("header_digest"), digest).otherwise(F.raise_error(F.concat(F.lit("payload of another digest than its header says: "), "record_id")))
    size = F.when(F.col("record_type") == "revisit", F.col("bytes")).otherwise(F.col("payload_bytes"))
    return joined.select(as_id(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", as_id(F.col("refers_to")).alias("refers_to"))


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives among the files that all executors share."""
    import uuid

    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
