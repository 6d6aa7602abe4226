"""Language identification by prediction with partial matching (PPM).

Each language has a byte context tree of orders 0 to 3 (escape method C) whose statistics are frozen after training on a
bounded sample of labelled texts. A text's code length under a language is the sum over all of its bytes; the shortest
wins. Trees are kept as sorted tables of byte n-grams: one row holds the code lengths of a symbol in its context under
every language, escapes already added, so a text of any length is scored by table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold

ORDERS = 4
#: What stands before a text's first byte, and bytes scored at once.
_START, _PIECE = b"\n\n\n", 1 << 19
#: Tasks that count a sample, and n-grams that one holds before it sends them on.
_SAMPLE_TASKS, _COUNTED = 8, 4_000_000


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, their 4-byte grams end to end, where each begins) of up to about _PIECE bytes; texts are cut, not cropped."""
    owner, held, size = [], [], 0
    for number, raw in enumerate(texts):
        for at in range(0, len(raw), _PIECE):
            held.append((_START + raw[: at + _PIECE] if at == 0 else raw[at - 3 : at + _PIECE]))
            owner.append(number)
            size += len(held[-1])
            if size >= _PIECE:
                yield owner, *_grams(held)
                owner, held, size = [], [], 0
    if held:
        yield owner, *_grams(held)


def _grams(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
    grams = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    lengths = np.array([len(x) for x in held])
    ends = np.cumsum(lengths)
    inside = np.ones(len(b), bool)
    for k in range(3):  # a piece's first three bytes are context only
        inside[ends - lengths + k] = False
    starts = np.concatenate([[0], np.cumsum(lengths - 3)[:-1]])
    return grams[inside[3:]], starts


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


@dataclass
class PPM:
    """Frozen context trees of several languages. counts: (language, length 1 to 4, gram, n) columns."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)
    pair: np.ndarray | None = None
    grid: np.ndarray | None = None

    @classmethod
    def fit(cls, languages: list[str], language: np.ndarray, length: np.ndarray, gram: np.ndarray, n: np.ndarray) -> PPM:
        tree = cls(languages)
        for k in range(1, ORDERS + 1):
            own = length == k
            keys, at = np.unique(gram[own], return_inverse=True)
            counts = np.zeros((len(keys), len(languages)))
            counts[at, language[own]] = n[own]
            contexts, of = np.unique(keys >> 8 if k > 1 else np.zeros_like(keys), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, of, counts)
            np.add.at(distinct, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, np.log2((total + distinct) / distinct), 0.0)
                seen = np.log2((total + distinct)[of] / counts)
            lower = tree._cost(k - 1, keys & ((1 << 8 * (k - 1)) - 1))
            tree.keys.append(keys)
            tree.contexts.append(contexts)
            tree.escapes.append(escape)
            tree.costs.append(np.where(counts > 0, seen, escape[of] + lower).astype(np.float32))
        tree._index()
        return tree

    def _cost(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its first k - 1 bytes, for every language."""
        if k == 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        row, hit = _find(self.keys[k - 1], grams)
        out = np.empty((len(grams), len(self.languages)))
        out[hit] = self.costs[k - 1][row[hit]]
        if not hit.all():
            rest = grams[~hit]
            context, known = _find(self.contexts[k - 1], rest >> 8 if k > 1 else np.zeros_like(rest))
            bits = self._cost(k - 1, rest & ((1 << 8 * (k - 1)) - 1))
            bits[known] += self.escapes[k - 1][context[known]]
            out[~hit] = bits
        return out

    def _index(self, most: int = 2048) -> None:
        """A dense table from a gram's two halves to its row; halves beyond the `most` commonest are looked up by search."""
        high, low = self.keys[-1] >> 16, self.keys[-1] & 0xFFFF
        halves, n = np.unique(np.concatenate([high, low]), return_counts=True)
        halves = halves[np.argsort(-n, kind="stable")[: most - 1]]
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[halves] = np.arange(1, len(halves) + 1)
        self.grid = np.full((len(halves) + 1) ** 2, -1, np.int32)
        row = self.pair[high] * (len(halves) + 1) + self.pair[low]
        both = (self.pair[high] > 0) & (self.pair[low] > 0)
        self.grid[row[both]] = np.flatnonzero(both)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        width = int(np.sqrt(len(self.grid)))
        for owner, grams, starts in pieces(texts):
            row = self.grid[self.pair[grams >> 16] * width + self.pair[grams & 0xFFFF]]
            bits = self.costs[-1][row]
            if (missed := row < 0).any():
                bits[missed] = self._cost(ORDERS, grams[missed].astype(np.int64))
            np.add.at(out, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language, and its posterior probability under equal priors."""
        bits = self.bits(texts)
        least = bits.min(axis=1, keepdims=True)
        return bits.argmin(axis=1), 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def sample_keys(rows: DataFrame) -> DataFrame:
    """rows of (doc_id, text, ...) with what a sample is chosen by: a hash of id and text, and the text's bytes."""
    return rows.withColumn("sample_key", F.xxhash64("doc_id", "text", F.lit("sample"))).withColumn("sample_size", F.octet_length("text"))


def sample_rule(keyed: DataFrame, group: str, most: int, most_bytes: int) -> Column:
    """The condition on rows with sample_keys that a bounded sample of each value of `group` meets.

    About `most` distinct rows and about `most_bytes` bytes of whole texts for each value, chosen by the hash of id and
    text, so rows that repeat an id or have none are chosen one by one; all rows where there are no more. Texts of any
    length take part, and the shortest text of a value is always in, so a value that has nothing but long texts is not
    lost. Beyond the expected sizes there is only chance: some square roots of `most` rows, and the length of one text.
    """
    # Distinct rows are counted by sketch, as copies must not make the sample smaller.
    counts = keyed.groupBy(group).agg(
        F.approx_count_distinct("sample_key", 0.01).alias("n"), F.avg("sample_size").alias("mean"), F.min(F.struct("sample_size", "sample_key")).alias("least")
    ).collect()  # one row a value
    if not counts:
        return F.lit(False)
    rate = {r[group]: min(1.0, most / (1.02 * r["n"]) if r["n"] > most else 1.0, most_bytes / max(1.0, r["n"] * r["mean"])) for r in counts}
    # The hash as a signed long from its lowest value up: a share of all hashes, as fine as the rate needs.
    upto = {g: min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63)) for g, x in rate.items()}
    of = lambda values: F.create_map(*[F.lit(x).cast("long") if i % 2 else F.lit(x) for pair in values.items() for i, x in enumerate(pair)])[F.col(group)]
    shortest = (F.col("sample_size") == of({r[group]: r["least"]["sample_size"] for r in counts})) & (F.col("sample_key") == of({r[group]: r["least"]["sample_key"] for r in counts}))
    return (F.col("sample_key") <= of(upto)) | shortest


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, sample_bytes: int = 4 << 20) -> PPM | None:
    """Context trees of every lang of docs, from at most about sample_docs whole texts and sample_bytes for each.

    That sample bounds the trees, which the driver gathers as n-gram counts. None if no row has both lang and text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, k), found in sorted(held.items()):
                gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "length", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, grams, _ in pieces(as_bytes(texts[i]) for i in np.flatnonzero(langs == lang)):
                    for k in range(1, ORDERS + 1):
                        held.setdefault((lang, k), []).append(np.unique(grams & np.uint32((1 << 8 * k) - 1), return_counts=True))
                        size += len(held[lang, k][-1][0])
                    if size > _COUNTED:
                        yield from flush()
                        size = 0
        yield from flush()

    keyed = sample_keys(rows)
    sample = keyed.where(sample_rule(keyed, "lang", sample_docs, sample_bytes)).dropDuplicates(["lang", "sample_key"])
    # A bounded sample is counted in a few tasks, so that the tables which they send on are few as well.
    counted = sample.select("lang", "text").coalesce(_SAMPLE_TASKS).mapInArrow(count, "lang string, length int, gram long, n long")
    got = counted.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    named = got.column("lang").combine_chunks()
    named = (named.chunk(0) if isinstance(named, pa.ChunkedArray) else named).dictionary_encode()
    found = named.dictionary.to_pylist()
    languages = sorted(found)
    number = np.array([languages.index(x) for x in found])[np.array(named.indices)]
    return PPM.fit(languages, number, *(np.array(got.column(c)) for c in ("length", "gram", "n")))


def identify(docs: DataFrame, model: PPM | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred (a learned language, `und` if text is null or has no letter), score.

    score is the posterior probability of lang_pred, 0 for `und`. Ties go to the language first in the alphabet.
    Without a model all is `und`. An empty table gives no rows; other columns are ignored.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(letters, F.col(text_col)).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            known = np.array(texts.is_valid())
            number, score = held.value.predict([as_bytes(t.as_py()) for t in texts])
            names = np.array(held.value.languages, object)[number]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(known, names, "und")), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, sample_docs: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows whose crc32 of the id modulo `parts` is not `held`."""
    model = fit_languages(docs.where(fold(F.col(id_col), parts) != held), id_col, text_col, lang_col, sample_docs)
    found = identify(docs, model, id_col, text_col)
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "lang_pred", "score")
