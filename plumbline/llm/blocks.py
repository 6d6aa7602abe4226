"""Documents as sequences of word codes, and values of distinct words joined back to them.

A task cuts its documents into blocks. Of each block it writes its documents as codes in order of position, some documents
a row, and one plain row for each of its distinct words. Word rows are shuffled by ranges of words: every distinct word of
the corpus comes to one place, where it is worked out once in a stream sorted by word, so nothing there grows with a bucket.
Values go back as rows of block and code and meet the documents of their block in a cogroup. Rows leave a block in the
order of words, and their codes count in that order, as neighbours that are alike take little room in a shuffle. Documents wait in a table that is
bucketed by block, so they are written once and never shuffled; what crosses the network is the distinct words of each
block, not every occurrence.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpoint_dir

#: Bytes of text after which a block is closed, distinct words after which it is too, codes in a row of documents.
BLOCK_BYTES, _WORDS, _CODES = 32 << 20, 1_000_000, 400_000
_LEVEL = 9
#: Bits of a word's code in a place; above them the block's number in its task, then the task.
_CODE_BITS, _NUMBER_BITS = 28, 12
#: Rows in a batch of words.
_BATCH = 20_000


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, most of them small, as compressed planes of bytes."""
    values = np.asarray(values, np.uint32)
    small = np.minimum(values, 255).astype(np.uint8)
    rest = values[values >= 255] - 255
    mid = np.minimum(rest, 65535).astype("<u2")
    far = (rest[rest >= 65535] - 65535).astype("<u4")
    head = np.array([len(small), len(mid), len(far)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=_LEVEL).compress(head + small.tobytes() + mid.view(np.uint8).reshape(-1, 2).T.tobytes() + far.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, n_mid, n_far = np.frombuffer(raw, "<u8", 3).astype(int)
    values = np.frombuffer(raw, np.uint8, n, 24).astype(np.uint32)
    rest = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n_mid, 24 + n).reshape(2, -1).T).view("<u2").reshape(-1).astype(np.uint32)
    rest[rest == 65535] += np.frombuffer(raw, "<u4", n_far, 24 + n + 2 * n_mid)
    values[values == 255] += rest
    return values


def _pack_order(order: np.ndarray) -> bytes:
    """Numbers in no order, as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=_LEVEL).compress(order.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_order(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class Coder(dict):
    """word -> its number in the block, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


#: Makes, for a new block, the function from a text to its codes; the Coder then holds the block's words.
Reader = Callable[[Coder], Callable[[str], "np.ndarray"]]
#: Of one block: its documents (ids, lengths, codes) some at a time, and (codes, values) of its words.
Documents = Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]


class Blocks:
    """The blocks of docs, whose columns must be (doc_id, text, learn); learn: whether the words count.

    words: place (block and code in one number), word, learnt (how often the block's learning documents have the word).
    The table stays until drop(), which must wait until what is made of it has been written.
    """

    def __init__(self, docs: DataFrame, reader: Reader, block_bytes: int = BLOCK_BYTES):
        self.spark = docs.sparkSession
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        self.name = f"plumbline_blocks.b{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS plumbline_blocks LOCATION '{checkpoint_dir(self.spark)}/plumbline_blocks'")
        schema = f"block long, word binary, place long, learnt long, ids array<{self.id_type}>, lengths binary, codes binary"
        made = docs.select("doc_id", "text", "learn").mapInArrow(_cut(reader, block_bytes), schema)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made.write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(self.name)
        table = self.spark.table(self.name)
        self.words = table.where("word is not null").select("place", "word", "learnt")
        self.docs = table.where("word is null").select("block", "ids", "lengths", "codes")

    def with_values(self, values: DataFrame, run: Callable[[Documents, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What run makes of the documents of each block and its values (code, ...), from rows (place, ...) of all words."""

        def both(docs: pa.Table, found: pa.Table) -> pa.Table:
            rows = list(zip(docs.column("ids"), *(docs.column(c).to_pylist() for c in ("lengths", "codes")), strict=True))
            # The row without documents tells the place of each code, given as words appeared, in the order of words.
            place = _unpack_order(next(codes for ids, _, codes in rows if not ids.is_valid))
            own = ((ids.values, unpack(lengths).astype(np.int64), place[unpack(codes)]) for ids, lengths, codes in rows if ids.is_valid)
            return pa.Table.from_batches(run(own, found.combine_chunks()))

        rest = [c for c in values.columns if c != "place"]
        code = F.col("place").bitwiseAND(F.lit((1 << _CODE_BITS) - 1)).cast("int").alias("code")
        placed = values.select(F.shiftright("place", _CODE_BITS).alias("of"), code, *rest)
        return self.docs.groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(both, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _cut(reader: Reader, block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["block", "word", "place", "learnt", "ids", "lengths", "codes"]
        part, number, id_type = TaskContext.get().partitionId(), 0, pa.int64()
        coder, held, size, waiting = Coder(), [], 0, 0
        read, learnt, begun = reader(coder), np.zeros(0, np.int64), False

        def row() -> pa.RecordBatch:
            """The documents that wait, as one row."""
            nonlocal learnt, waiting, begun
            codes = np.concatenate([c for _, c, _ in held])
            taught = [c for _, c, learn in held if learn]
            counts = np.bincount(np.concatenate(taught), minlength=len(coder)) if taught else np.zeros(len(coder), np.int64)
            counts[: len(learnt)] += learnt
            learnt, lengths = counts, np.array([len(c) for _, c, _ in held], np.uint32)
            ids = pa.array([pa.array([d for d, _, _ in held], id_type)], pa.list_(id_type))
            held.clear()
            waiting, begun = 0, True
            block = pa.array([part << _NUMBER_BITS | number], pa.int64())
            return pa.RecordBatch.from_arrays([block, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), ids, pa.array([pack(lengths)]), pa.array([pack(codes)])], names)

        def close() -> Iterator[pa.RecordBatch]:
            """What waits, and the block's words in order."""
            if held:
                yield row()
            words, block = list(coder), part << _NUMBER_BITS | number
            if number >> _NUMBER_BITS or len(words) >> _CODE_BITS:
                raise ValueError("a task has too many blocks, or a block too many words, for one number")
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            if begun:
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.binary()), pa.array([_pack_order(place)]),
                ], names)
            for at in range(0, len(order), _BATCH):
                own = order[at : at + _BATCH]
                n = len(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, block, np.int64)), pa.array([words[i] for i in own.tolist()], pa.binary()), pa.array(np.arange(at, at + n) | block << _CODE_BITS), pa.array(learnt[own]),
                    pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text, learn in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                held.append((doc_id.as_py(), read(text), learn.as_py()))
                size, waiting = size + len(text), waiting + len(held[-1][1])
                if waiting >= _CODES or len(held) >= _CODES:
                    yield row()
                if size >= block_bytes or len(coder) >= _WORDS:
                    yield from close()
                    coder, size, number = Coder(), 0, number + 1
                    read, learnt, begun = reader(coder), np.zeros(0, np.int64), False
        yield from close()

    return run


def distinct_runs(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a sorted array in order, and the place of each row's word among them."""
    held = words.to_pylist()
    new = np.fromiter((a != b for a, b in zip(held, [None, *held], strict=False)), bool, len(held))
    return [w for w, first in zip(held, new, strict=True) if first], np.cumsum(new) - 1
