"""Language-model scores by subword lattice: the marginal probability of a text over all of its segmentations.

The pieces are those of an existing vocabulary; their unigram probabilities are learnt from the corpus. A piece begins
with a space mark or holds none, so a text's lattice is a chain of its words' lattices: each distinct word of the corpus is
summed over once, by a forward recursion in log space, and documents add up their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_BYTES, Blocks, Coder, Documents
from plumbline.llm.common import durable, fold
from plumbline.llm.simhash import _word_runs

#: The vocabulary's mark for the start of a word.
MARK = "▁"
_LOG10 = math.log(10)


#: Words longer than this go through the recursion one by one; the others by length, so many at once.
_LONG, _TOGETHER = 200, 20_000
#: Base of the rolling hash by which parts of words are found among the pieces of their length.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Log probabilities of a vocabulary's pieces, its single bytes and the end of a text."""

    def __init__(self, pieces: list[str], counts: np.ndarray, ends: int, smoothing: float = 0.1):
        total = counts.sum() + ends + smoothing * (len(pieces) + 1)
        self.logs = np.log((counts + smoothing) / total)
        self.end = math.log((ends + smoothing) / total)
        self.number = {p: i for i, p in enumerate(pieces) if p}
        self.byte_number = np.array([self.number[f"<0x{b:02X}>"] for b in range(256)])
        self.byte = self.logs[self.byte_number]
        self.piece = {p: float(self.logs[i]) for p, i in self.number.items() if not is_byte(p)}
        self.longest = max(map(len, self.piece), default=0)
        self.tables = {}
        for size in sorted({len(p) for p in self.piece}):
            own = [p for p in self.piece if len(p) == size]
            hashes = _prefix_hashes(_code_points(own, size))[:, -1]
            order = np.argsort(hashes)
            self.tables[size] = hashes[order], np.array([self.number[p] for p in own])[order]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations of the word with its mark."""
        out = np.empty(len(words))
        for at, some in _by_length(words):
            out[at] = [self._long(w, None, None) for w in some] if len(some[0]) > _LONG else self._forward(some)[0][-1]
        return out

    def expect(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, each so many times."""
        counts = np.zeros(len(self.logs))
        for at, some in _by_length(words):
            if len(some[0]) > _LONG:
                for word, n in zip(some, times[at], strict=True):
                    self._long(word, float(n), counts)
            else:
                self._backward(*self._forward(some), times[at].astype(float), counts)
        return counts

    def _forward(self, words: list[str]) -> tuple:
        """alpha by place, the edges that end at each place, and each character's bytes; words of one length."""
        text = _code_points([MARK + w for w in words], len(words[0]) + 1)
        hashes = _prefix_hashes(text)
        letters, letter = np.unique(text, return_inverse=True)
        letter = letter.reshape(text.shape)
        spelt = [[*chr(c).encode("utf-8", "replace")] for c in letters]
        spell = np.array([self.byte[b].sum() for b in spelt])[letter]
        alpha, edges = [np.zeros(len(words))], [[]]
        powers = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        for end in range(1, text.shape[1] + 1):
            own, sums = [], alpha[end - 1] + spell[:, end - 1]  # a character may always be written as its bytes
            for size, (table, number) in self.tables.items():
                if size > end:
                    break
                wanted = hashes[:, end] - hashes[:, end - size] * powers[size]
                found = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
                rows = np.flatnonzero(table[found] == wanted)
                if len(rows):
                    ids = number[found[rows]]
                    own.append((end - size, rows, ids))
                    sums[rows] = np.logaddexp(sums[rows], alpha[end - size][rows] + self.logs[ids])
            alpha.append(sums)
            edges.append(own)
        return alpha, edges, (spelt, letter, spell)

    def _backward(self, alpha: list, edges: list, spelling: tuple, times: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts the share of `times` that goes through each edge."""
        spelt, letter, spell = spelling
        share = [np.zeros_like(times) for _ in alpha[:-1]] + [times]
        by_letter = np.zeros(len(spelt))
        for end in range(len(alpha) - 1, 0, -1):
            through = share[end] * np.exp(alpha[end - 1] + spell[:, end - 1] - alpha[end])
            share[end - 1] += through
            by_letter += np.bincount(letter[:, end - 1], through, len(spelt))
            for start, rows, ids in edges[end]:
                through = share[end][rows] * np.exp(alpha[start][rows] + self.logs[ids] - alpha[end][rows])
                share[start][rows] += through
                counts += np.bincount(ids, through, len(counts))
        for octets, n in zip(spelt, by_letter, strict=True):
            np.add.at(counts, self.byte_number[octets], n)

    def _long(self, word: str, times: float | None, counts: np.ndarray | None) -> float:
        """The recursion over one word; with times, expectations are added to counts as well."""
        text, piece = MARK + word, self.piece
        spell = {c: float(self.byte[[*c.encode("utf-8", "replace")]].sum()) for c in set(text)}
        alpha = [0.0]
        for end in range(1, len(text) + 1):
            terms = [alpha[end - 1] + spell[text[end - 1]]]
            terms += [alpha[start] + piece[part] for start in range(max(0, end - self.longest), end) if (part := text[start:end]) in piece]
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])))
        if times is not None:
            share = [0.0] * len(text) + [times]
            for end in range(len(text), 0, -1):
                through = share[end] * math.exp(alpha[end - 1] + spell[text[end - 1]] - alpha[end])
                share[end - 1] += through
                np.add.at(counts, self.byte_number[[*text[end - 1].encode("utf-8", "replace")]], through)
                for start in range(max(0, end - self.longest), end):
                    if (x := piece.get(part := text[start:end])) is not None:
                        through = share[end] * math.exp(alpha[start] + x - alpha[end])
                        share[start] += through
                        counts[self.number[part]] += through
        return alpha[-1]


def _code_points(texts: list[str], size: int) -> np.ndarray:
    return np.array(texts, f"<U{size}").view(np.uint32).reshape(len(texts), size)


def _prefix_hashes(points: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    for i in range(points.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + points[:, i] + np.uint64(1)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(positions, words) of equally long words, at most _TOGETHER at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, bounds) if len(order) else []:
        for at in range(0, len(group), _TOGETHER):
            some = group[at : at + _TOGETHER]
            yield some, [words[i] for i in some]


def is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(path: str) -> list[str]:
    """The pieces of a vocabulary file by id, control and unknown pieces as empty strings."""
    sp = _processor(path)
    return ["" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def _reader(coder: Coder):
    """Words of the text with A-Z lower-cased."""

    def read(text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace").lower()
        return np.concatenate([np.fromiter(map(coder.__getitem__, words), np.uint32, len(words)) for words in _word_runs(raw, 1 << 24)] or [np.zeros(0, np.uint32)])

    return read


def _expected(totals: DataFrame, pieces: list[str], held) -> np.ndarray:
    """The expected count of each piece over the words that teach, under the lattice that `held` broadcasts."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(pieces))
        for batch in batches:
            counts += held.value.expect([w.decode("utf-8") for w in batch.column(0).to_pylist()], np.array(batch.column(1), np.int64))
        yield from _slices(counts)

    return _summed(totals.where("n > 0").mapInArrow(expect, "slice int, payload binary"), len(pieces))


def _slices(counts: np.ndarray, size: int = 256) -> Iterator[pa.RecordBatch]:
    """A task's counts, some `size` numbers to a row, so that what tasks send on is a few rows each."""
    starts = [at for at in range(0, len(counts), size) if counts[at : at + size].any()]
    if starts:
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([counts[at : at + size].astype(np.float64).tobytes() for at in starts], pa.binary())], ["slice", "payload"])


def _summed(slices: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counts; what reaches the driver has the vocabulary's size."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in rows.column("payload"))
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for row in slices.groupBy("slice").applyInArrow(add, "slice int, payload binary").collect():
        part = np.frombuffer(row["payload"], np.float64)
        out[row["slice"] : row["slice"] + len(part)] = part
    return out


def score_documents(docs: DataFrame, vocabulary_path: str, learn, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 0.1, rounds: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    learn: a condition on the columns of docs; its rows teach. Tokens are the words of the text, A-Z lower-cased, and one
    end. base_score: sum of log10((c + 1) / (N + V + 1)); score: log10 of the text's marginal probability over all
    segmentations, with its end. Pieces are counted in the vocabulary's own segmentation of the words that teach, then
    `rounds` times by expectation over all segmentations. Null and empty texts are just an end. With nothing to learn
    from, pieces are equally likely. Repeated rows get a row each and teach twice; an empty table gives no rows; other
    columns are ignored. The rows are written down, so that no blocks stay behind.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = Blocks(rows, _reader, block_bytes)
    ends = rows.where("learn").count()
    pieces = vocabulary(vocabulary_path)
    # One row for each distinct word of the corpus; how often it teaches.
    totals = durable(blocks.words.groupBy("word").agg(F.sum("learnt").alias("n")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the words that teach: how often each piece is in them, then how many words there are and how many distinct."""
        sp = _processor(vocabulary_path)
        counts = np.zeros(len(pieces) + 2)
        for batch in batches:
            n = np.array(batch.column(1), np.int64)
            ids = sp.encode([w.decode("utf-8") for w in batch.column(0).to_pylist()], num_threads=1)
            counts[:-2] += np.bincount([i for word in ids for i in word], np.repeat(n, [len(i) for i in ids]), len(pieces))
            counts[-2:] += n.sum(), len(n)
        yield from _slices(counts)

    learnt = _summed(totals.where("n > 0").mapInArrow(count, "slice int, payload binary"), len(pieces) + 2)
    tokens, distinct = int(learnt[-2]) + ends, int(learnt[-1]) + (ends > 0)
    counts = np.where([bool(p) for p in pieces], learnt[:-2], 0.0)
    lattice = Lattice(pieces, counts, ends, smoothing)
    for _ in range(rounds if tokens else 0):
        counts = _expected(totals, pieces, spark.sparkContext.broadcast(lattice))
        lattice = Lattice(pieces, counts, ends, smoothing)
    held = spark.sparkContext.broadcast(lattice)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.log_probabilities([w.decode("utf-8") for w in batch.column(0).to_pylist()]) / _LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.astype(np.float32))], ["word", "n", "lp"])

    scored = totals.mapInArrow(score, "word binary, n long, lp float")
    values = blocks.words.select("place", "word").join(scored, "word").select("place", "n", "lp")
    base = math.log10(tokens + distinct + 1)
    end_log, end_score = math.log10(ends + 1), lattice.end / _LOG10

    def assemble(own: Documents, found: pa.Table) -> Iterator[pa.RecordBatch]:
        code = np.array(found.column("code"), np.int64)
        logs, lps = np.zeros(len(code)), np.zeros(len(code))
        logs[code] = np.log10(np.array(found.column("n"), np.float64) + 1)
        lps[code] = np.array(found.column("lp"), np.float64)
        for ids, lengths, codes in own:
            doc = np.repeat(np.arange(len(ids)), lengths)
            add = lambda x: np.bincount(doc, x[codes], minlength=len(ids))  # noqa: B023, E731
            n = lengths + 1
            known = add((logs > 0).astype(float)).astype(np.int64) + (ends > 0)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n), pa.array(known), pa.array(np.full(len(ids), tokens, np.int64)),
                pa.array(add(logs) + end_log - n * base), pa.array(add(lps) + end_score),
            ], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {blocks.id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = durable(blocks.with_values(values, assemble, schema))
    blocks.drop()
    return out


def score_report(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2) -> DataFrame:
    """score_documents, learnt from rows whose crc32 of the id modulo `parts` is not `held`, with held_out."""
    found = score_documents(docs, vocabulary_path, fold(F.col(id_col), parts) != held, id_col, text_col)
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
