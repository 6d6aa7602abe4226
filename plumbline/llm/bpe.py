"""Byte-level BPE: encoding by a global shuffle of distinct pre-tokens, decoding by the token-byte table.

Texts become sequences of pre-token codes in order of position. The distinct pre-tokens of every block are shuffled by
pre-token, so that each of the corpus is encoded once, in a stream sorted by pre-token; its ids join back by block and
code, and documents are put together by position. Decoding looks ids up in the token-byte table, which has the size of
the vocabulary and goes to every task: a join whose small side is sent out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.blocks import BLOCK_BYTES, Blocks, Coder, Documents, distinct_runs
from plumbline.llm.common import durable, rows_of

#: Distinct pieces of text that a task remembers at once.
_KNOWN = 200_000
#: Pre-tokens of the documents that are put together at once.
_ASSEMBLED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: token bytes and id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Unsafe(Exception):
    """A piece that begins or ends with white space, whose neighbours may change how it is split."""


def pieces(text: str) -> list[str]:
    """The text cut before each space; each piece but the first begins with that space."""
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _safe_pieces(text)


def _safe_pieces(text: str) -> list[str]:
    """Cut before single spaces between other characters only, where every pre-token pattern of this kind has a border."""
    import re

    return re.split(r"(?<=\S)(?= \S)", text)


class PieceCache(dict):
    """piece -> value, for pieces that their neighbours cannot change; others raise Unsafe."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__()
        self.value = value

    def __missing__(self, piece: str):
        bare = piece[1:] if piece[:1] == " " else piece
        if piece and (not bare or bare[0].isspace() or bare[-1].isspace()):
            raise Unsafe
        return self.keep(piece)

    def keep(self, piece: str):
        if len(self) >= _KNOWN:
            self.clear()
        self[piece] = value = self.value(piece)
        return value

    def all(self, text: str) -> list:
        """The values of the text's pieces in order."""
        try:
            return list(map(self.__getitem__, pieces(text)))
        except Unsafe:
            return [self[p] if p in self else self.value(p) for p in _safe_pieces(text)]


def _reader(pattern: str):
    def reader(coder: Coder):
        import regex

        find = regex.compile(pattern).findall
        cache = PieceCache(lambda piece: tuple(coder[w.encode("utf-8", "replace")] for w in find(piece)))
        return lambda text: np.fromiter(chain.from_iterable(cache.all(text)), np.uint32)

    return reader


def _blocks_and_values(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, block_bytes: int) -> tuple[Blocks, DataFrame]:
    """The blocks of docs, and (place, ids) of their pre-tokens, ids as binary numbers of _width() bytes."""
    from pyspark.sql import functions as F

    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary
    blocks = Blocks(rows_of(docs, id_col, text_col).withColumn("learn", F.lit(False)), _reader(pattern), block_bytes)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        # A pre-token matches the pattern as a whole, so the ids of its bytes need no further split.
        whole = encoding(known, r"(?s).+")
        last, ids, kind = None, None, _width(known)
        for batch in batches:
            words, place = distinct_runs(batch.column(1))
            found = [ids if w == last else np.array([known[w]] if w in known else whole.encode_ordinary(w.decode("utf-8")), kind).tobytes() for w in words]
            if words:
                last, ids = words[-1], found[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).take(pa.array(place))], ["place", "ids"])

    ordered = blocks.words.select("place", "word").repartitionByRange("word").sortWithinPartitions("word")
    return blocks, ordered.mapInArrow(look_up, "place long, ids binary")


def _width(ranks: dict[bytes, int]) -> str:
    """The smallest kind of number that holds every id."""
    return "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"


def _assembled(docs: Documents, values: pa.Table, kind: str) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(document ids, their token ids) of a block, some documents at a time."""
    code, wide = np.array(values.column("code"), np.int64), np.dtype(kind).itemsize
    size, begin = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    held = values.column("ids").to_pylist()
    flat = np.frombuffer(b"".join(held), kind).astype(np.int32)
    size[code] = own = np.fromiter(map(len, held), np.int64, len(held)) // wide
    begin[code] = np.cumsum(own) - own
    del held
    for ids, lengths, codes in docs:
        bounds, low = np.concatenate([[0], np.cumsum(lengths)]), 0
        while low < len(ids):  # one long document may be more than a row holds else
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + _ASSEMBLED, "right")) - 1)
            place = codes[bounds[low] : bounds[high]]
            n = size[place]
            at = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ends = np.concatenate([[0], np.cumsum(n)])[bounds[low : high + 1] - bounds[low]]
            yield ids.slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[at]))
            low = high


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs.

    Each match of pattern is encoded separately, without special tokens, as the tiktoken library would; null and empty
    texts have no ids; repeated rows get a row each; an empty table gives no rows; other columns are ignored. The rows
    are read from a table of blocks in the checkpoint folder, which stays there.
    """
    blocks, values = _blocks_and_values(docs, ranks_path, pattern, id_col, text_col, block_bytes)

    kind = _width(read_ranks(ranks_path))

    def assemble(own: Documents, found: pa.Table) -> Iterator[pa.RecordBatch]:
        for ids, tokens in _assembled(own, found, kind):
            yield pa.RecordBatch.from_arrays([ids, tokens], ["doc_id", "ids"])

    return blocks.with_values(values, assemble, f"doc_id {blocks.id_type}, ids array<int>")


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """digests() of encode(), made where the documents are put together; written down, so that no blocks stay behind."""
    blocks, values = _blocks_and_values(docs, ranks_path, pattern, id_col, text_col, block_bytes)
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def assemble(own: Documents, found: pa.Table) -> Iterator[pa.RecordBatch]:
        digest = _digester(held.value)
        for ids, tokens in _assembled(own, found, _width(held.value)):
            yield digest(ids, tokens)

    out = durable(blocks.with_values(values, assemble, f"doc_id {blocks.id_type}, {_DIGESTS}"))
    blocks.drop()
    return out


def _byte_table(ranks: dict[bytes, int]) -> pa.Array:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def _taken(table: pa.Array, lists: pa.Array) -> Iterator[memoryview]:
    """For each list of ids the bytes of its tokens, one after the other."""
    flat = table.take(lists.flatten())
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
    data = memoryview(flat.buffers()[2] or b"")
    at = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().fill_null(0)))])
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield data[ends[low] : ends[high]]


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes of the ids of each row; a null list gives no bytes. An id without a token fails."""
    held = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _byte_table(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(x) for x in _taken(table, batch.column(1))], pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digester(ranks: dict[bytes, int]):
    """From document ids and their token ids to a batch of digests()."""
    table = _byte_table(ranks)
    decimal = pa.array([b"%d," % i for i in range(len(table))], pa.large_binary())
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def digest(doc_id: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            doc_id, ids.value_lengths().fill_null(0).cast(pa.int64()),
            pa.array([sha(x[:-1]) for x in _taken(decimal, ids)], pa.string()), pa.array([sha(x) for x in _taken(table, ids)], pa.string()),
        ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of encode(): of the decimal ids and of the decoded bytes."""
    held = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digester(held.value)
        for batch in batches:
            yield digest(batch.column(0), batch.column(1))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, {_DIGESTS}")
