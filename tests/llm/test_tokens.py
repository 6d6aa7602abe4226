import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import blocks, bpe, lattice, packing
from tests.llm.conftest import ODD

RANKS = files.path("byte_bpe_multi_50k.tiktoken")
PIECES = files.path("piece_bpe_32k.model")
JSON = files.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 2**32 - 1)))
def test_pack_round_trip(values):
    assert blocks.unpack(blocks.pack(np.array(values, np.uint32))).tolist() == values


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=2)))
def test_sorted_words_and_their_places(words):
    own, place = blocks.distinct_runs(pa.array(sorted(words), pa.binary()))
    assert own == sorted(set(words)) and [own[i] for i in place] == sorted(words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzA 0 1'\n\t.é東 \x1c\0"))))
def test_pieces_do_not_change_the_ids(text):
    encoder = bpe.encoding(bpe.read_ranks(RANKS), files.PATTERN)
    cache = bpe.PieceCache(encoder.encode_ordinary)
    for _ in range(2):
        assert list(itertools.chain(*cache.all(text))) == encoder.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [50, 1 << 20])
def test_encode_and_decode_odd_texts(odd, nothing, block_bytes):
    encoder = bpe.encoding(bpe.read_ranks(RANKS), files.PATTERN)
    encoded = bpe.encode(odd, RANKS, files.PATTERN, block_bytes=block_bytes)
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in encoded.collect())
    assert rows == sorted((-1 if i is None else i, encoder.encode_ordinary(t or "")) for i, t in ODD)
    decoded = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, RANKS).collect())
    assert decoded == sorted((-1 if i is None else i, (t or "").encode()) for i, t in ODD)
    assert bpe.encode(nothing, RANKS, files.PATTERN).count() == 0
    digests = lambda df: sorted(((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in df.collect()))
    assert digests(bpe.encoded_digests(odd, RANKS, files.PATTERN, block_bytes=block_bytes)) == digests(bpe.digests(encoded, RANKS))


def test_each_distinct_word_is_encoded_once_and_no_table_stays(spark, odd, monkeypatch):
    tables = lambda: {t.name for t in spark.catalog.listTables("plumbline_blocks")}
    bpe.encode(odd, RANKS, files.PATTERN, block_bytes=100)
    before = tables()
    made, values = bpe._blocks_and_values(odd, RANKS, files.PATTERN, "doc_id", "text", 100)
    rows = made.words.collect()
    assert len({r.place >> 28 for r in rows}) > 3 and len(rows) > len({bytes(r.word) for r in rows})
    places = values.collect()
    assert len(places) == len(rows) and {r.place for r in places} == {r.place for r in rows}
    made.drop()
    bpe.encoded_digests(odd, RANKS, files.PATTERN)
    assert tables() == before


def test_digests_of_documents_match_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    encoder = bpe.encoding(bpe.read_ranks(RANKS), files.PATTERN)
    found = {r.doc_id: r for r in bpe.digests(bpe.encode(docs, RANKS, files.PATTERN), RANKS).collect()}
    for r in docs.collect():
        ids = encoder.encode_ordinary(r.text)
        got = found[r.doc_id]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def _brute_word(model, word):
    """The summed probability of all ways to write the word as pieces or bytes."""
    text = lattice.MARK + word

    def rest(at):
        if at == len(text):
            return 1.0
        total = math.exp(sum(model.byte[b] for b in text[at].encode())) * rest(at + 1)
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in model.piece:
                total += math.exp(model.piece[text[at:end]]) * rest(end)
        return total

    return math.log(rest(0))


def test_lattice_sums_all_segmentations_and_expects_their_pieces(monkeypatch):
    pieces = lattice.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    model = lattice.Lattice(pieces, rng.integers(0, 100, len(pieces)).astype(float), 50)
    words = ["the", "and,", "naïve", "東x", "unseen", "zzzzz", "a\0"]
    assert model.log_probabilities(words) == pytest.approx([_brute_word(model, w) for w in words], abs=1e-9)
    monkeypatch.setattr(lattice, "_LONG", 0)
    assert model.log_probabilities(words) == pytest.approx([_brute_word(model, w) for w in words], abs=1e-9)
    one_by_one = model.expect(words, np.arange(1, 8))
    monkeypatch.setattr(lattice, "_LONG", 200)
    together = model.expect(words, np.arange(1, 8))
    assert np.allclose(one_by_one, together)
    # What is expected of a piece is how the log probability moves with its logarithm.
    for piece in ("th", "e", "<0xE6>", lattice.MARK + "the"):
        i = pieces.index(piece)
        moved = []
        for step in (-1e-4, 1e-4):
            other = lattice.Lattice(pieces, np.zeros(len(pieces)), 50)
            other.logs[:] = model.logs
            other.logs[i] += step
            other.byte = other.logs[other.byte_number]
            moved.append(float(np.arange(1, 8) @ other.log_probabilities(words)))
        assert (moved[1] - moved[0]) / 2e-4 == pytest.approx(together[i], abs=1e-4)


def test_scores_of_odd_texts_match_brute_force(odd, nothing):
    from pyspark.sql import functions as F

    found = lattice.score_documents(odd, PIECES, F.col("doc_id") != 4, block_bytes=100, rounds=1).collect()
    tokens = [(-1 if i is None else i, [*(t or "").encode().lower().split(), None]) for i, t in ODD]
    counts = Counter(x for i, ts in tokens for x in ts if i not in (4, -1))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(ts), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 5)) for i, ts in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(r.score < 0 for r in found)
    # The marginal probability of a text is that of its words by brute force, under the model that the words teach.
    pieces, words = lattice.vocabulary(PIECES), Counter(x.decode() for x, n in counts.items() if x is not None for _ in range(n))
    sp = lattice._processor(PIECES)
    own = np.zeros(len(pieces))
    for w, n in words.items():
        for i in sp.encode(w):
            own[i] += n
    ends = counts[None]
    model = lattice.Lattice(pieces, np.where([bool(p) for p in pieces], own, 0.0), ends)
    model = lattice.Lattice(pieces, model.expect(list(words), np.array(list(words.values()))), ends)
    short = {i: ts for i, ts in tokens if len(ts) < 20 and all(len(x) < 12 for x in ts[:-1])}
    got = {-1 if r.doc_id is None else r.doc_id: r.score for r in found}
    assert len(short) > 6
    for i, ts in short.items():
        assert got[i] == pytest.approx((sum(_brute_word(model, x.decode()) for x in ts[:-1]) + model.end) / math.log(10), abs=1e-4)
    assert lattice.score_documents(nothing, PIECES, F.lit(True)).count() == 0


def test_model_prefers_held_out_text_to_noise(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(5)
    noise = spark.createDataFrame([(10_000 + i, " ".join("".join(rng.choices("qxzjkvwy", k=6)) for _ in range(80))) for i in range(5)], "doc_id long, text string")
    found = lattice.score_documents(docs.union(noise), PIECES, F.col("doc_id") % 5 != 0, rounds=1).collect()
    per = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert per([r for r in found if r.doc_id < 10_000 and r.doc_id % 5 == 0]) > per([r for r in found if r.doc_id >= 10_000]) + 3


def _check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_of_odd_texts(odd, nothing, size):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(JSON)
    rows = packing.pack_documents(odd, JSON, files.PATTERN, size=size).collect()
    want = []
    for i, text in ODD:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        start = piece = 0
        while start < len(ids):
            n = (len(ids) - start) % size or size
            want.append((-1 if i is None else i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
            start, piece = start + n, piece + 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    _check_packing(rows, size)
    assert packing.pack_documents(nothing, JSON, files.PATTERN).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", "a", " ", "  b", "\n", "é", "<|"]), max_size=8).map("".join))
def test_added_tokens_are_found_as_the_library_finds_them(text):
    from tokenizers import Tokenizer

    ordinary = bpe.encoding(packing.read_byte_level(JSON), files.PATTERN).encode_ordinary
    ids = [i for part, token in packing.added_splitter(packing.read_added(JSON))(text) for i in (ordinary(part) if token is None else [token])]
    assert ids == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("flags", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_flags_of_added_tokens(flags):
    from tokenizers import AddedToken, Tokenizer

    other = Tokenizer.from_file(JSON)
    other.add_special_tokens([AddedToken("<x>", normalized=False, **flags), AddedToken("<x>y", normalized=False)])
    added = [{"id": i, "content": t.content, "lstrip": t.lstrip, "rstrip": t.rstrip, "single_word": t.single_word} for i, t in other.get_added_tokens_decoder().items()]
    ordinary = bpe.encoding(packing.read_byte_level(JSON), files.PATTERN).encode_ordinary
    split = packing.added_splitter(added)
    for text in ("a <x> b", "a<x>b", "<x>", " <x>  <x> ", "<x>y z", "q <x>.<|endoftext|>"):
        ids = [i for part, token in split(text) for i in (ordinary(part) if token is None else [token])]
        assert ids == other.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fills_slots_without_gaps_and_as_best_fit_would(histogram):
    size = 64
    slots, used = packing.plan_slots(histogram, size)
    ranks, content = Counter(), {}
    for length, low, high, first, offset in slots:
        for k in range(high - low):
            ranks[length, low + k] += 1
            content.setdefault(first + k, []).append((offset, length))
    assert ranks == Counter((n, k) for n, c in histogram.items() for k in range(c))
    for own in content.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    free = []  # best fit, longest first, one item at a time
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(size - n)
    assert used == len(content) == len(free)


def test_packing_of_documents_is_near_the_lower_bound(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), JSON, files.PATTERN).collect()
    assert _check_packing(rows, 2048) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_packing_ranks_many_pieces_of_one_length_in_shares_of_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANKED", 3)
    monkeypatch.setattr(packing, "_SUMMED", 2)
    docs = spark.createDataFrame([(i, "word " * (3 if i % 4 else 20)) for i in range(160)], "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(docs, JSON, files.PATTERN, size=16).collect()
    lengths = Counter(r.length for r in rows)
    assert max(lengths.values()) >= 120 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert _check_packing(rows, 16) == packing.plan_slots(dict(lengths), 16)[1]
