import hashlib
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import exact_dedup, simhash
from plumbline.llm.components import connected_components


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(values, near):
    top = list(range(len(values)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_match_brute_force_also_across_segments(monkeypatch):
    texts = [None, "", "one", "one two three", "One TWO three four", "a b c d e f g " * 50]
    for segment in (1, 5, 1 << 20):
        monkeypatch.setattr(simhash, "SEGMENT", segment)
        assert [simhash.fingerprint(t or "") for t in texts] == [brute_fingerprint(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1) | st.integers(0, 4095), max_size=60), st.integers(0, 2**64 - 1) | st.integers(0, 4095), st.integers(0, 6))
def test_tree_finds_all_within_the_radius(members, query, radius):
    found = simhash.BKTree(list(members)).within(query, radius)
    assert sorted(found) == sorted(m for m in members if (m ^ query).bit_count() <= radius)


@pytest.mark.parametrize("tree_size", [3, 2048])
@pytest.mark.parametrize("per_shard", [1 << 20, 1])
def test_links_connect_what_brute_force_connects(spark, tree_size, per_shard):
    import random

    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:30] for _ in range(2)]  # chains and hot shards
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.fingerprint_links(nodes, 4, per_shard=per_shard, tree_size=tree_size)
    labels = {r.node: r.label for r in connected_components(links).collect()}
    mask = (1 << 64) - 1
    expected = brute_groups(values, lambda a, b: ((a ^ b) & mask).bit_count() <= 4)
    assert [labels.get(v, v) for v in values] == [values[i] for i in expected]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id + 1 as a", "id as b")
    assert {r.label for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["shuffled", "folded"])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch, kind):
    import random

    from plumbline.llm import components

    n = 3000
    order = list(range(n))
    random.Random(4).shuffle(order)
    if kind == "folded":
        order = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    made, durable = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: made.append(1) or durable(df))
    assert {r.label for r in components.connected_components(edges).collect()} == {0}
    assert len(made) - 2 <= 14  # log2(3000) is 11.6


def test_near_groups_of_odd_texts(spark, odd, nothing):
    from tests.llm.conftest import ODD

    rows = sorted((r.doc_id if r.doc_id is not None else 99, r.fingerprint, r.component_id) for r in simhash.near_groups(odd).collect())
    expected = brute_groups([brute_fingerprint(t) for _, t in ODD], lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), g in zip(ODD, expected, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = sorted((i if i is not None else 99, format(brute_fingerprint(t), "016x"), least[g]) for (i, t), g in zip(ODD, expected, strict=True))
    assert rows == want
    assert simhash.near_groups(nothing).count() == 0
    assert sorted(x.doc_id for x in simhash.keep_one_of_each_group(odd).where("doc_id is not null").select("doc_id").distinct().collect()) == sorted({x for x in least.values() if x is not None})


def test_near_groups_of_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    held = {r.doc_id: brute_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(held)
    group = brute_groups([held[i] for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    assert all(rows[i].component_id == ids[g] and rows[i].fingerprint == format(held[i], "016x") for i, g in zip(ids, group, strict=True))


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    size = Counter(norm)
    keep = {}
    for (i, _), n in zip(rows, norm, strict=True):
        keep[n] = min([x for x in (keep.get(n), i) if x is not None], default=None)
    out, seen = [], set()
    for (i, _), n in zip(rows, norm, strict=True):
        kept = i == keep[n] and n not in seen
        if kept:
            seen.add(n)
        out.append((i if i is not None else 99, keep[n], size[n], kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bytes", [1 << 20, 1])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups_also_when_digests_clash_or_filters_do_not_fit(spark, odd, nothing, digest_bytes, filter_bytes):
    from tests.llm.conftest import ODD

    many = [(i, f"text {i % 190}") for i in range(400)]
    for frame, rows in ((odd, ODD), (spark.createDataFrame(many, "doc_id long, text string"), many)):
        found = exact_dedup.exact_groups(frame, memtable_rows=7, filter_bytes=filter_bytes, digest_bytes=digest_bytes).collect()
        got = sorted(((r.doc_id if r.doc_id is not None else 99, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found), key=repr)
        assert got == brute_exact(rows)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_filters_grow_with_what_they_hold_and_lose_nothing(spark):
    from pyspark.sql import functions as F

    def digests(low, high):
        return spark.range(low, high).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))

    sizes = []
    for n in (0, 300, 60_000):
        found = exact_dedup.digest_filter(digests(0, n), 1 << 20)
        sizes.append(found.bits.nbytes)
        passed = lambda low, high: digests(low, high).where(exact_dedup.may_hold(F.col("digest"), spark, found)).count()  # noqa: B023, E731
        assert passed(0, n) == n and passed(100_000, 120_000) <= 500
    assert sizes[0] < sizes[1] < sizes[2] < 200_000
    assert exact_dedup.digest_filter(digests(0, 60_000), 1 << 10) is None


def test_runs_are_sorted_and_merge_in_order(spark):
    import random

    rng = random.Random(1)
    entries = [(bytes([rng.randrange(256), rng.randrange(4)]), rng.choice([None, *range(50)]), rng.randint(1, 3)) for _ in range(3000)]
    frame = spark.createDataFrame(entries, "digest binary, doc_id long, m long").repartition(3)
    runs = exact_dedup.flush_runs(frame, memtable_rows=100)
    merged = exact_dedup.compact(runs)
    parts = merged.rdd.mapPartitions(lambda rows: [[bytes(r.digest) for r in rows]]).collect()
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == len({d for d, _, _ in entries}) < runs.count()
    want = {}
    for d, i, m in entries:
        least, n = want.get(d, (None, 0))
        want[d] = min((x for x in (least, i) if x is not None), default=None), n + m
    assert {bytes(r.digest): (r.keep_id, r.n) for r in merged.collect()} == want


def test_rows_of_one_id_and_several_texts_follow_their_own_groups(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (2, long), (2, other), (3, other), (None, long), (None, "alone but without id and quite different")]
    kept = simhash.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, long), (2, other), (0, rows[-1][1])])


def test_keep_first_copies_keeps_one_row_of_each_text(spark, odd):
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd.collect()})
