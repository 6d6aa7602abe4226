"""Percentiles, lines and shares against numpy and plain Python, with hot and null groups in blocks."""

import random

import numpy as np
import pytest

from plumbline.operators import fitting, sequences


@pytest.mark.parametrize("most", [sequences.MOST, 40])
def test_percentiles_are_those_of_numpy(spark, most):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None]), draw.choice([1.0, 1.0, 2.5, draw.gauss(0, 9)])) for _ in range(600)] + [("a", None), ("b", float("nan")), ("empty", None), ("one", 7.0)]
    got = {r.g: r.p for r in fitting.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.0, 0.25, 0.5, 0.8, 1.0], "p", most).collect()}
    for g in ("a", "b", None, "one"):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got.pop(g) == pytest.approx(np.percentile(values, [0, 25, 50, 80, 100]))
    assert got == {}


def test_percentiles_of_nothing_and_of_no_fraction(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert fitting.percentiles(none, "g", "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        fitting.percentiles(none, "g", "v", [1.5])


def line_by_hand(points, refits, share=0.8, near=4.0, least=4):
    x, y = np.array(points, float).T
    if len(points) < least or len(set(x)) < 2:
        return len(points), None
    used, (b, a) = len(points), np.polyfit(x, y, 1)
    for _ in range(refits):
        off = np.abs(a + b * x - y)
        kept = off < max(near, np.percentile(off, 100 * share))
        if kept.sum() >= least and len(set(x[kept])) > 1:
            used, (b, a) = int(kept.sum()), np.polyfit(x[kept], y[kept], 1)
    return used, (a, b)


@pytest.mark.parametrize(("refits", "most"), [(0, sequences.MOST), (1, 50), (6, sequences.MOST)])
def test_lines_with_planted_outliers(spark, refits, most):
    draw = random.Random(refits)
    rows = []
    for g, a, b, n in (("hot", 10, 3, 400), (None, -4, 0.5, 90), ("small", 0, 1, 4)):
        for k in range(n):
            x = draw.uniform(0, 100)
            rows.append((g, x, a + b * x + draw.gauss(0, 1) + (500 if g != "small" and k % 7 == 0 else 0)))
    rows += [("few", 1.0, 2.0), ("few", 2.0, 3.0), *[("upright", 5.0, float(k)) for k in range(9)], ("hot", None, 1.0), ("hot", 1.0, float("nan"))]
    got = {r.g: r for r in fitting.robust_lines(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y", refits, most=most).collect()}
    for g in ("hot", None, "small", "few", "upright"):
        points = [(x, y) for k, x, y in rows if k == g and x is not None and y == y]
        used, line = line_by_hand(points, refits)
        assert (got[g].n, got[g].used) == (len(points), used)
        assert (got[g].intercept, got[g].slope) == ((None, None) if line is None else pytest.approx(line, rel=1e-6, abs=1e-6))
    if refits == 6:
        assert abs(got["hot"].slope - 3) < 0.02 and abs(got["hot"].intercept - 10) < 1


def shares_by_hand(weights, total, floor):
    weights = [max(w, 0) if w is not None and w == w else 0 for w in weights]
    plain = [w / sum(weights) * total if sum(weights) else total / len(weights) for w in weights]
    if floor * len(plain) > total:
        return [None] * len(plain)
    fixed = [max(p, floor) for p in plain]
    over, above = sum(fixed) - total, sum(p - floor for p in fixed)
    return [p - over * (p - floor) / above if above else p for p in fixed]


def test_shares_keep_the_total_and_the_floor(spark):
    draw = random.Random(1)
    groups = {"a": [10.0, 1.0, 0.1, 5.0], None: [draw.random() ** 4 for _ in range(15)], "zero": [0.0, None, -3.0], "one": [2.0], "many": [1.0] * 17, "exact": [1.0] * 16, "nan": [float("nan"), 1.0]}
    rows = [(g, i, w) for g, ws in groups.items() for i, w in enumerate(ws)]
    got = fitting.shares_with_floor(spark.createDataFrame(rows, "g string, i int, w double"), "g", "w", 416.0, 26.0, "width").collect()
    assert len(got) == len(rows)
    for g, ws in groups.items():
        widths = [r.width for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)]
        assert widths == ([None] * 17 if g == "many" else pytest.approx(shares_by_hand(ws, 416.0, 26.0)))
        assert g == "many" or (sum(widths) == pytest.approx(416) and min(widths) >= 26 - 1e-9)
