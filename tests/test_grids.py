import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.operators import grids

KIND = "s string, t double, y double, e double"


def _series(rng, name, n, span, period, start=100.0):
    t = start + np.sort(rng.uniform(0, span, n))
    t[0], t[-1] = start, start + span
    y = 1 + 0.3 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.1, n)
    return [(name, float(a), float(b), float(c)) for a, b, c in zip(t, y, rng.uniform(0.05, 0.2, n), strict=True)]


def test_the_fast_sums_equal_direct_ones(spark):
    rng = np.random.default_rng(1)
    rows = _series(rng, "a", 400, 25.0, 2.3) + _series(rng, "b", 60, 7.5, 0.4, -3.0) + [("c", 5.0, 1.0, 0.1)] * 3 + [("a", None, 1.0, 0.1), ("a", 105.0, None, 0.1), ("b", 1.0, 9.0, 0.0), (None, 1.0, 1.0, 0.1), ("b", 1.0, 9.0, None)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    got = grids.full_periodogram(df, ["s"], "t", "y", "e", 1 / 13, 10.0).toPandas()
    assert set(got["s"]) == {"a", "b"}
    for name, span, n in (("a", 25.0, 400), ("b", 7.5, 60)):
        own = got[got["s"] == name].sort_values("frequency")
        assert len(own) == 1 + round((10 - 1 / 13) * span * 8) and set(own["points"]) == {n}
        t, y, e = (np.array([r[i] for r in rows if r[0] == name and None not in r and r[3] > 0]) for i in (1, 2, 3))
        w = 1 / e**2 / (1 / e**2).sum()
        y = y - (w * y).sum()
        angle = 2 * np.pi * own["frequency"].to_numpy()[:, None] * (t - t.min())
        c, s = np.cos(angle), np.sin(angle)
        C, S, YC, YS = (c * w).sum(1), (s * w).sum(1), (c * w * y).sum(1), (s * w * y).sum(1)
        CC, SS, CS = (c * c * w).sum(1) - C**2, (s * s * w).sum(1) - S**2, (c * s * w).sum(1) - C * S
        power = (SS * YC**2 + CC * YS**2 - 2 * CS * YC * YS) / ((w * y * y).sum() * (CC * SS - CS**2))
        assert np.abs(power - own["power"]).max() < 1e-8
    best = got.loc[got[got["s"] == "a"]["power"].idxmax()]
    assert abs(1 / best["frequency"] - 2.3) < 0.02


def test_the_cost_does_not_follow_the_frequencies(spark):
    df = spark.createDataFrame(_series(np.random.default_rng(3), "a", 300, 20.0, 3.0), KIND)
    plan = grids.full_periodogram(df, ["s"], "t", "y", "e", 0.1, 200.0)
    cells = 2 ** math.ceil(math.log2(8 * (1 + round(199.9 * 160))))
    assert plan.count() == 1 + round(199.9 * 160) and cells > 2**17


def _boxes(t, y, e, shortest, longest, durations):
    cell, span = min(durations) / 10, t.max() - t.min()
    step = 2 * min(durations) / span**2
    w, at = 1 / e**2, np.floor((t - t.min()) / cell)
    out = {}
    for k in range(1 + round((1 / shortest - 1 / longest) / step)):
        period = 1 / (1 / longest + k * step)
        bins = max(1, int(period / cell))
        phase = (((at + 0.5) * cell / period) % 1 * bins).astype(int)
        best = None
        for d in sorted(durations):
            wide = max(1, int(np.rint(d / period * bins)))
            for start in range(bins):
                inside = (phase - start) % bins < wide
                if wide < bins and inside.any() and not inside.all():
                    iw, ow = w[inside].sum(), w[~inside].sum()
                    depth, error = (w * y)[~inside].sum() / ow - (w * y)[inside].sum() / iw, math.sqrt(1 / iw + 1 / ow)
                    if best is None or round(depth / error, 9) > best[-1]:
                        best = (period, d, depth, error, round(depth / error, 9))
        out[k] = best
    return out


def test_boxes_by_prefix_sums_equal_all_boxes_tried(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 9.0, 160))
    t[0], t[-1] = 0.0, 9.0
    y = 1 - 0.5 * (np.abs((t - 0.7) % 2.1 - 0.2) < 0.15) + rng.normal(0, 0.02, 160)
    e = rng.uniform(0.02, 0.05, 160)
    rows = [("a", float(a) + 50, float(b), float(c)) for a, b, c in zip(t, y, e, strict=True)]
    df = spark.createDataFrame([*rows, ("b", 1.0, 1.0, 0.1), (None, 1.0, 1.0, 0.1), ("a", 51.0, None, 0.1)], KIND).repartition(3)
    got = grids.box_search(df, ["s"], "t", "y", "e", 1.0, 5.0, [0.3, 0.6]).orderBy(F.desc("period")).collect()
    want = _boxes(t, y, e, 1.0, 5.0, [0.3, 0.6])
    assert {r.s for r in got} == {"a"} and len(got) == len(want)
    for r, b in zip(got, want.values(), strict=True):
        assert (r.period, r.duration, r.depth, r.error, r.snr) == pytest.approx(b, rel=1e-6)
    best = max(got, key=lambda r: r.snr)
    assert abs(best.period - 2.1) < 0.05 and abs(best.depth - 0.5) < 0.03
    assert abs((best.middle - 50 - 0.9) % 2.1 - 0) < 0.15 or abs((best.middle - 50 - 0.9) % 2.1 - 2.1) < 0.15


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    assert grids.full_periodogram(df, ["s"], "t", "y", "e", 0.1, 1.0).count() == 0
    assert grids.box_search(df, ["s"], "t", "y", "e", 1.0, 5.0, [0.3]).count() == 0


def test_a_series_spread_in_parts_has_the_same_powers(spark, monkeypatch):
    df = spark.range(40_000).select((F.col("id") % 3 % 2).alias("s"), (F.col("id") * 7919 % 20_011 / 2000.0).alias("t"), F.sin(F.col("id") * 0.37).alias("y"), (F.lit(1.0) + F.col("id") % 3).alias("e"))
    whole = grids.full_periodogram(df, ["s"], "t", "y", "e", 0.1, 5.0).toPandas().sort_values(["s", "frequency"])
    monkeypatch.setattr(grids, "MANY", 1000)
    parts = grids.full_periodogram(df, ["s"], "t", "y", "e", 0.1, 5.0).toPandas().sort_values(["s", "frequency"])
    assert len(whole) == len(parts) > 100 and list(whole["points"]) == list(parts["points"])
    assert np.allclose(whole["power"], parts["power"], rtol=1e-6, atol=1e-10)


def test_points_are_shuffled_as_they_are_and_not_by_cell(spark):
    df = spark.range(10).select(F.lit(1).alias("s"), F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("e"))
    plan = grids.full_periodogram(df, ["s"], "t", "y", "e", 0.1, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
