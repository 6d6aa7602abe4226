"""Matching, components, smoothing and traces against plain Python, with hot and null groups in blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import components, matching, sequences


def nearest_by_hand(queries, targets, most=64):
    found = {c: min(((c ^ t).bit_count(), t) for t in targets) for c in queries} if targets else {}
    return {c: (t, d) for c, (d, t) in found.items() if d <= most}


@pytest.mark.parametrize(("bits", "block_bits"), [(12, 5), (20, 8)])
def test_mutual_nearest_by_hand(spark, bits, block_bits):
    draw = random.Random(bits)
    left = [(i, 7 if i % 3 == 0 else draw.getrandbits(bits)) for i in range(90)] + [(999, None)]
    right = [(i, 9 if i % 4 == 0 else draw.getrandbits(bits)) for i in range(80)] + [(None, 5)]
    frames = [spark.createDataFrame(side, "id long, code long") for side in (left, right)]
    codes = [{c for _, c in side if c is not None} for side in (left, right)]
    for most in (None, 2):
        got = {r.code: (r.near, r.distance) for r in matching.nearest_codes(*frames, bits, block_bits, most).collect()}
        assert got == nearest_by_hand(*codes, 64 if most is None else most)
    first = [{c: min((i for i, x in side if x == c and i is not None), default=None) for c in known} for side, known in zip((left, right), codes, strict=True)]
    there, back = nearest_by_hand(*codes), nearest_by_hand(*codes[::-1])
    want = [(first[0][c], first[1][n], d) for c, (n, d) in there.items() if back[n][0] == c]
    assert sorted(map(tuple, matching.mutual_nearest(*frames, bits, block_bits).collect()), key=str) == sorted(want, key=str)


def test_nearest_of_nothing(spark):
    some = spark.createDataFrame([(1, 5), (2, None)], "id long, code long")
    assert matching.nearest_codes(some.limit(0), some, 8).count() == 0
    assert matching.nearest_codes(some, some.limit(0), 8).count() == 0
    assert matching.mutual_nearest(some, some, 8).collect() == [(1, 1, 0)]
    with pytest.raises(ValueError):
        matching.nearest_codes(some, some, 60)


def greedy(left, right, tolerance):
    """All pairs of places by distance and first ids; rows of a place in turn."""
    places = []
    for side in (left, right):
        at = {}
        for i, x, y in side:
            if None not in (i, x, y):
                at.setdefault((x, y), []).append(i)
        places.append({p: sorted(ids) for p, ids in at.items()})
    a, b = places
    far = lambda p, q: math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    pairs = sorted((far(p, q), a[p][0], b[q][0], p, q) for p in a for q in b if far(p, q) <= tolerance)
    out = []
    for d, _, _, p, q in pairs:
        while a[p] and b[q]:
            out.append((a[p].pop(0), b[q].pop(0), d))
    return sorted(out)


@pytest.mark.parametrize("steps", [None, 8])
def test_match_points_by_hand(spark, steps):
    """A third of the rows at one place; on a grid of eighths most distances are ties."""
    draw, spot = random.Random(5), (0.5, 0.5)
    place = lambda: (draw.random(), draw.random()) if steps is None else (draw.randint(0, steps) / steps, draw.randint(0, steps) / steps)
    left, right = ([(base + i, *(spot if i % 3 == 0 else place())) for i in range(120)] + [(None, 0.1, 0.1), (base + 999, None, 0.1)] for base in (0, 5_000))
    frames = [spark.createDataFrame(side, "id long, x double, y double") for side in (left, right)]
    assert sorted(map(tuple, matching.match_points(*frames, 0.13, most=20).collect())) == greedy(left, right, 0.13)


def test_match_points_in_a_chain_and_without_any(spark):
    """Each point has a nearer neighbour than the one before: one pair settles in each round."""
    at, chain = 0.0, []
    for i in range(10):
        chain.append((i, at, 0.0))
        at += 0.01 * 0.9**i
    frames = [spark.createDataFrame(chain[k::2], "id long, x double, y double") for k in (0, 1)]
    assert sorted(map(tuple, matching.match_points(*frames, 0.02).collect())) == greedy(chain[::2], chain[1::2], 0.02)
    assert matching.match_points(frames[0], frames[1].limit(0), 0.02).collect() == []


def test_blocks_of_hot_and_null_groups(spark):
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 1, "a").alias("g"), "id")
    cut = sequences.blocked(rows, "g", ["id"], most=100).withColumnRenamed("__sq_block", "b")
    sizes = cut.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("g", "b").collect()
    assert {g: sum(r.g == g for r in sizes) for g in (None, "a")} == {None: 20, "a": 20}
    assert max(r.n for r in sizes) < 200 and sum(r.n for r in sizes) == 4_000
    for one, other in zip(sizes, sizes[1:]):
        assert one.g != other.g or one.high < other.low
    assert {r.at for r in sequences.numbered(rows, "g", ["id"], "at", most=100).where("g is null").collect()} == set(range(1, 2_001))


def test_no_block_without_a_hot_group(spark):
    rows = spark.range(50).select((F.col("id") % 5).alias("g"), "id")
    plan = sequences.blocked(rows, "g", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize(("keep", "most"), [(0.7, 1_000_000), (0.7, 300), (0.999, 300), (1e-6, 300)])
def test_smoothing_by_hand(spark, keep, most):
    draw = random.Random(4)
    odd = [None, float("nan"), 1.0, 4.0, 60.0, 99.0]
    rows = [("h" if i % 2 else draw.choice([None, "a", "b"]), i, draw.choice(odd) if draw.random() < 0.3 else draw.uniform(5, 50)) for i in range(3_000)]
    rows += [("still", 3_000 + i, 1.0) for i in range(700)]  # a group in which nothing is let through
    states, want = {}, {}
    for g, k, v in rows:
        state = states.get(g, 20.0)
        if v is not None and 4 < v < 60:
            state = keep * state + (1 - keep) * v
        states[g] = want[k] = state
    frame = spark.createDataFrame(rows, "g string, k long, v double").repartition(5)
    got = {r.k: r.e for r in sequences.smoothed(frame, "g", ["k"], "v", "e", 4.0, 60.0, 20.0, keep, most).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("most", [10_000, 40])
def test_trace_by_hand(spark, most):
    draw = random.Random(6)
    profile = lambda: None if draw.random() < 0.03 else [draw.choice([None, 0.0, 1.0, 2.0, 5.0, 9.0]) for _ in range(12)]
    rows = [("h" if i % 2 else draw.choice([None, "a", "b"]), i, profile(), "x") for i in range(500)]

    def one_way(rows):
        at, out = 5, {}
        for _, k, p, _ in rows:
            near = [(-1.0 if v is None else v, -j) for j, v in enumerate(p or []) if abs(j - at) <= 2]
            if near and max(near)[0] > 1.0:
                at = -max(near)[1]
            out[k] = at
        return out

    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        ahead, back = one_way(own), one_way(own[::-1])
        want |= {k: (ahead[k] + back[k]) / 2 for k in ahead}
    frame = spark.createDataFrame(rows, "g string, k long, p array<double>, other string").repartition(5)
    found = sequences.traced(frame, "g", ["k"], "p", "at", start=5, window=2, least=1.0, most=most)
    assert found.columns == ["g", "k", "p", "other", "at"] and {r.k: r.at for r in found.collect()} == want


def test_components_by_hand(spark):
    draw = random.Random(8)
    points = [(draw.randint(0, 40) + 0.5, draw.randint(0, 40) + 0.25, draw.randint(0, 5)) for _ in range(350)]
    points += [(100.5 + i, 0.5 + abs(i % 14 - 7), 1) for i in range(150)]  # one long path, up and down
    points += [(200.5, 0.5, None)] * 40 + [(None, 1.0, 1), (math.nan, 1.0, 2)]
    cells = {}
    for x, y, w in points:
        if x is not None and x == x:
            entry = cells.setdefault((math.floor(x), math.floor(y)), [0, 0])
            entry[0] += 1
            entry[1] += w or 0
    want, seen = [], set()
    for cell in sorted(cells):
        stack, part = [cell] if cell not in seen else [], []
        seen.add(cell)
        while stack:
            cx, cy = stack.pop()
            part.append((cx, cy))
            near = {(cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)} & cells.keys() - seen
            seen |= near
            stack += near
        if part:
            xs, ys = zip(*part, strict=True)
            want.append((*min(part), len(part), sum(cells[c][0] for c in part), sum(cells[c][1] for c in part), min(xs), min(ys), max(xs), max(ys)))
    frame = spark.createDataFrame(points, "x double, y double, w long").repartition(4)
    assert sorted(map(tuple, components.cell_components(frame, 1.0, F.col("w")).collect())) == sorted(want)
    assert components.cell_components(frame.limit(0), 1.0, F.col("w")).collect() == []
