"""Best-fit packing planned on the histogram of lengths.

Tokenizing leaves one small row per piece of a document. Best fit, longest first, runs over the counts of each length
(as many numbers as the sequence has tokens) and yields ranges of slots; pieces take them by joining on their rank
within their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import PieceCache, encoding
from plumbline.llm.common import durable, rows_of

#: Ranks of one length in a join key of the slots, pieces of one length that are ranked together, and such shares that are summed together.
_SPAN, _RANKED, _SUMMED = 256, 500, 1000


def read_byte_level(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file, without its added tokens.

    Such files write a byte as one printable character: those that print as they are, the others as 256 and up in order.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    added = {t["content"] for t in found.get("added_tokens", [])}
    return {bytes(letter[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in added}


def read_added(path: str) -> list[dict]:
    """The added tokens of a tokenizer file: id, content and the flags that say how they match."""
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("added_tokens", [])


def added_splitter(added: list[dict]) -> Callable[[str], list[tuple[str, int | None]]]:
    """Cuts a text into (ordinary text, None) and (an added token's text, its id), as the library does before all else.

    The first match wins, of matches at one place the longest; lstrip and rstrip take in white space beside the token,
    single_word wants none of its neighbours to be a word character.
    """
    if not added:
        return lambda text: [(text, None)]
    numbers = {t["content"]: t["id"] for t in added}

    def form(t: dict) -> str:
        bare = f"(?P<t{t['id']}>{re.escape(t['content'])})"
        bare = rf"(?<!\w){bare}(?!\w)" if t.get("single_word") else bare
        return (r"\s*" if t.get("lstrip") else "") + bare + (r"\s*" if t.get("rstrip") else "")

    pattern = re.compile("|".join(map(form, sorted(added, key=lambda t: -len(t["content"])))))

    def split(text: str) -> list[tuple[str, int | None]]:
        if not any(content in text for content in numbers):
            return [(text, None)]
        out, at = [], 0
        for m in pattern.finditer(text):
            if m.start() > at:
                out.append((text[at : m.start()], None))
            out.append((m[0], int(m.lastgroup[1:])))
            at = m.end()
        return [*out, (text[at:], None)] if at < len(text) else out

    return split


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut into pieces of `size` if longer.

    Ids are those that the `tokenizers` library gives with add_special_tokens=False: nothing is put around a text, but
    the text of an added token is that token. The first piece is the shorter one. Null texts count as empty and so have
    just end_id.
    """
    rows = rows_of(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(read_byte_level(tokenizer_path))  # bounded by the vocabulary
    added = read_added(tokenizer_path)
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = encoding(held.value, pattern).encode_ordinary
        cache = PieceCache(lambda piece: np.array(ordinary(piece), "<u4").tobytes())
        split = added_splitter(added)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = b"".join(b"".join(cache.all(part)) if token is None else token.to_bytes(4, "little") for part, token in split(text.as_py())) + last
                start, n, piece = 0, len(ids) // 4, 0
                while start < n:
                    length = (n - start) % size or size
                    rows.append((doc_id.as_py(), piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            if rows:
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_slots(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts: rows (length, first rank, end rank, first sequence, offset); sequences used.

    Ranks of a row take one sequence each, one after the other. Sequences with equally much room are groups that are
    only split when part of one is taken.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: groups (first sequence, how many)
    used = 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        for free in range(length, size + 1):  # the tightest room first; what it leaves is used next while it fits
            while count > rank and room.get(free):
                first, many = room[free].pop()
                left = free
                take = min(many, count - rank)
                if take < many:
                    room[free].append((first + take, many - take))
                while left >= length and rank < count:
                    n = min(take, count - rank)
                    slots.append((length, rank, rank + n, first, size - left))
                    if n < take:
                        room[left].append((first + n, take - n))
                        take = n
                    rank, left = rank + n, left - length
                if left:
                    room[left].append((first, take))
        per = size // length
        full, rest = divmod(count - rank, per)
        for j in range(per if full else 0):
            slots.append((length, rank, rank + full, used, j * length))
            rank += full
        if full and (left := size - per * length):
            room[left].append((used, full))
        used += full
        for j in range(rest):
            slots.append((length, rank, rank + 1, used, j * length))
            rank += 1
        if rest:
            room[size - rest * length].append((used, 1))
            used += 1
    return slots, used


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated ones too; equal rows share out their slots in any order. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = durable(tokenized_pieces(docs, tokenizer_path, pattern, id_col, text_col, size, end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `size` rows at most
    slots, _ = plan_slots(counts, size)
    # Rank within length: pieces of one length are dealt to shares by hash, ranked there, and shares are laid end to end.
    shares = F.split(F.lit(",".join(str(-(-counts.get(n, 0) // _RANKED)) for n in range(size + 1))), ",").cast("array<bigint>")
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(shares, F.col("length").cast("int"))).cast("int"))
    # The shares' running sum is taken in two steps, so that a length which most pieces have is not one task's work.
    sizes = dealt.groupBy("length", "share").count().withColumn("some", F.floor(F.col("share") / _SUMMED))
    earlier = lambda n, keys, by: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy(F.col("length").alias("r_length"), F.col("some").alias("r_some")).agg(F.sum("count").alias("n"))
    runs = runs.withColumn("base", earlier("n", ["r_length"], "r_some"))
    offsets = sizes.withColumn("within", earlier("count", ["length", "some"], "share")).join(runs, (F.col("length") == F.col("r_length")) & (F.col("some") == F.col("r_some")))
    offsets = offsets.select(F.col("length").alias("o_length"), F.col("share").alias("o_share"), (F.col("base") + F.col("within")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start")) - 1
    ranked = dealt.withColumn("place", place).join(offsets, (F.col("length") == F.col("o_length")) & (F.col("share") == F.col("o_share")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).withColumn("span", F.floor(F.col("rank") / _SPAN))
    plan = spark.createDataFrame(slots, "s_length long, low long, high long, first long, offset long")
    plan = plan.withColumn("s_span", F.explode(F.sequence(F.floor(F.col("low") / _SPAN), F.floor((F.col("high") - 1) / _SPAN))))
    taken = ranked.join(plan, (F.col("length") == F.col("s_length")) & (F.col("span") == F.col("s_span")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return taken.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
