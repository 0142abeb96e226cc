"""Matches on the sky are counted by tile, not paired out."""

import contextlib
import io
import math
import random

import numpy as np

from skylathe.operators import match, tiles

LEFT, RIGHT = "k long, ra double, dec double", "n string, ra double, dec double"


def sep(p, q):
    half = lambda a, b: math.sin(math.radians(b - a) / 2) ** 2
    return math.degrees(math.asin(math.sqrt(min(1.0, half(p[1], q[1]) + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * half(p[0], q[0]))))) * 7200


def matches(spark, left, right, radius, **more):
    ra_dec = ("ra", "dec")
    return match.sky_matches(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", ra_dec, ra_dec, "n", radius, **more)


def test_a_crowd_makes_no_pairs(spark):
    out = matches(spark, [(1, 10.0, 0.0)], [("a", 10.0, 0.0)], 300.0)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert "Join" not in plan.getvalue() and "SortAggregate" not in plan.getvalue().split("FlatMapCoGroups")[0]


def test_rows_in_overlapping_circles_come_once_without_pairs(spark):
    df = spark.createDataFrame([("in", 10.0, 0.0), ("in", 10.0, 0.0), ("out", 11.0, 0.0), ("none", None, 0.0)], "k string, ra double, dec double")
    out = match.in_circles(df, spark.createDataFrame([(10.0, i / 36000) for i in range(50)], "ra double, dec double"), ("ra", "dec"), 8.0)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert "Join" not in plan.getvalue() and [tuple(r) for r in out.collect()] == [("in", 10.0, 0.0)]


def test_counts_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    for height, spread, radius in ((0.0, 0.2, 300.0), (45.0, 0.02, 20.0), (-89.97, 0.05, 90.0), (89.5, 0.6, 4000.0), (10.0, 30.0, 200_000.0)):
        at = lambda k: [(i, rng.uniform(-spread, spread) / max(math.cos(math.radians(height)), 0.01) % 360, max(-90.0, min(90.0, height + rng.uniform(-spread, spread)))) for i in range(k)]
        u, v = at(90), [(f"{i:04}", a, d) for i, a, d in at(500)]
        v += [("0000b", *v[0][1:]), ("copy", *u[0][1:]), ("copy2", *u[0][1:])]
        want = {}
        for k, *p in u:
            d = sorted((sep(p, q), n) for n, *q in v)
            d = [x for x in d if x[0] <= radius]
            want[k] = (len(d), sum(x[0] <= radius / 3 for x in d), d[0][1] if d else None)
        got = {r.k: (r.matches, r.within_aperture, r.nearest) for r in matches(spark, u, v, radius, aperture=radius / 3).collect()}
        assert got == want and sum(w[0] for w in want.values()) > 90


def test_rims_ties_copies_and_unknown_places(spark):
    step = 7.2 / 3600
    left = [(1, 10.0, 0.0), (2, 10.0, 0.0), (3, None, 0.0), (4, 10.0, float("nan")), (5, 200.0, 0.0), (None, 10.0, 0.0), (7, 0.0, 0.0)]
    right = [("b", 10.0, step), ("a", 10.0, -step), ("c", 10.0, step), ("x", None, 0.0), ("y", float("inf"), 0.0), ("z", 360.0 - step / 4, 0.0)]
    got = {r.k: (r.matches, r.within_aperture, r.nearest, r.status) for r in matches(spark, left, right, sep((10.0, 0.0), (10.0, step)), close=5.0, aperture=1.0).collect()}
    here = (3, 0, "a", "distant")
    assert got == {1: here, 2: here, None: here, 3: (0, 0, None, "none"), 4: (0, 0, None, "none"), 5: (0, 0, None, "none"), 7: (1, 0, "z", "matched")}
    assert [tuple(r) for r in matches(spark, left[:1], [], 5.0).collect()] == [(1, 0, None, None, "none")]


def test_points_tried_grow_with_the_root_of_the_density(monkeypatch):
    tried, ranges = [], tiles._ranges
    monkeypatch.setattr(tiles, "_ranges", lambda low, high: tried.append(np.maximum(high - low, 0).sum()) or ranges(low, high))

    def per_row(n):
        rng = np.random.default_rng(n)
        points = np.stack([*rng.uniform(-1e-3, 1e-3, (2, n)), np.zeros(n)], axis=1)
        rows = points[:200][np.argsort(points[:200, 1])]
        tried.clear()
        sure, row, _ = tiles.Strips(points, np.ones(n, np.int64)).within(rows, 5e-4)
        assert len(row) == 0 and list(sure) == [(np.linalg.norm(points - p, axis=1) <= 5e-4).sum() for p in rows]
        return sum(tried)

    assert per_row(64_000) < 6 * per_row(4_000)
