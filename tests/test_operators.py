"""Hand-made inputs with known answers."""

import math
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import fits, grids, match, photometry, pixels, quality, regression, selection, stats, windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_phase_and_cycle_at_boundaries(spark):
    t = [96.0, 98.0, 99.9, 100.0, 100.9, 102.0, 104.0, float("nan"), None, 101.0, 103.0]
    out = spark.createDataFrame([(x,) for x in t], "t double").select(X.cycle(F.col("t"), 100.0, 2.0), X.phase(F.col("t"), 100.0, 2.0)).collect()
    assert [r[0] for r in out] == [-2, -1, 0, 0, 0, 1, 2, 0, 0, 0, 2]
    assert [round(r[1], 9) for r in out[:7]] == [0, 0, -0.1, 0, 0.9, 0, 0]
    assert out[9][1] == -1.0


@pytest.mark.parametrize(("duration", "cadence", "at", "want"), [(0.1, 0.04, [0, 0.05, 0.1], [1, 0.5, 0]), (1.0, 0.2, [-1, -0.5, 0, 0.5, 1], [0, 0.5, 1, 0.5, 0])])
def test_box_edges(spark, duration, cadence, at, want):
    df = spark.createDataFrame([(float(x),) for x in at], "x double").select(X.box_fraction(F.col("x"), duration, cadence).alias("b"))
    assert [round(r.b, 9) for r in df.collect()] == want
    assert df.select(X.box_fraction(F.col("b"), 0.0, 1.0)).first()[0] is None


def light_curve(depth=0.004, duration=0.09, offset=0.012, noise=5e-4):
    t = np.arange(-5, 5, 10 / 1440)
    phase = (t + 1) % 2 - 1
    cycle = np.rint(t / 2).astype(int)
    c = 10 / 1440
    box = np.clip((np.minimum(phase - offset + c / 2, duration / 2) - np.maximum(phase - offset - c / 2, -duration / 2)) / c, 0, 1)
    flux = 1 + 0.001 * cycle + 0.002 * cycle * phase - depth * box
    return [(1, int(k), float(p), float(f), noise) for k, p, f in zip(cycle, phase, flux, strict=True)]


def test_grid_fit_recovers_a_known_box(spark):
    df = spark.createDataFrame(light_curve(), "series int, cycle int, phase double, flux double, error double").filter("abs(phase) <= 0.22")
    cells = fits.grid(spark, [0.07, 0.08, 0.09, 0.1, 0.11], [-0.006, 0.0, 0.006, 0.012, 0.018])
    best = fits.best_boxes(fits.box_fits(df, ["series"], "cycle", "phase", "flux", "error", cells, 10 / 1440, least_group=4), ["series"]).first()
    assert (best.duration, best.offset) == (0.09, 0.012) and abs(best.depth - 0.004) < 1e-9
    assert best.duration_low <= 0.09 <= best.duration_high


def test_box_fit_is_the_dense_solution(spark):
    rng = np.random.default_rng(3)
    data = [(1, k, p, f + rng.normal(0, 1e-3), 1e-3 * (1 + 0.3 * rng.random())) for _, k, p, f, _ in light_curve() if abs(p) <= 0.22]
    df = spark.createDataFrame([(s, k, p, float(f), float(e)) for s, k, p, f, e in data], "series int, cycle int, phase double, flux double, error double")
    got = fits.box_fits(df, ["series"], "cycle", "phase", "flux", "error", fits.grid(spark, [0.09], [0.012]), 10 / 1440).first()
    k, p, y, e = (np.array([d[i] for d in data], float) for i in (1, 2, 3, 4))
    c = 10 / 1440
    box = np.clip((np.minimum(p - 0.012 + c / 2, 0.045) - np.maximum(p - 0.012 - c / 2, -0.045)) / c, 0, 1)
    cols = [(k == v).astype(float) for v in np.unique(k)] + [(k == v) * p for v in np.unique(k)] + [-box]
    a = np.stack(cols, 1) / e[:, None]
    beta = np.linalg.lstsq(a, y / e, rcond=None)[0]
    chi2 = float((((y / e) - a @ beta) ** 2).sum())
    scale = max(1, chi2 / (len(y) - a.shape[1]))
    assert math.isclose(got.depth, beta[-1], rel_tol=1e-9) and math.isclose(got.chi2, chi2, rel_tol=1e-9)
    assert math.isclose(got.depth_error, math.sqrt(np.linalg.inv(a.T @ a)[-1, -1] * scale), rel_tol=1e-9)


def test_ephemeris(spark):
    df = spark.createDataFrame([(1, e, 2459000.123 + 2.915 * e, 0.001) for e in (-10, -2, 0, 7, 15)], "series int, e int, t double, error double")
    line = fits.weighted_line(df, ["series"], "e", "t", "error")
    got = line.first()
    assert abs(got.period - 2.915) < 1e-8 and abs(got.t0 - (2459000.123 + 2.915 * got.reference)) < 1e-8
    e = np.array([-10, -2, 0, 7, 15], float)
    cov = np.linalg.inv(np.stack([np.ones(5), e - got.reference]) @ np.stack([np.ones(5), e - got.reference]).T / 1e-6)
    ahead = fits.predicted(line, F.lit(40)).first()
    u = np.array([1, 40 - got.reference])
    assert math.isclose(ahead.time_error, math.sqrt(u @ cov @ u), rel_tol=1e-9)


def test_quadratic_baseline(spark):
    df = spark.createDataFrame([(1, float(x), 3 - 2 * x + 0.5 * x * x) for x in range(30)] + [(2, 1.0, 1.0)], "series int, x double, y double")
    out = fits.quadratic_baseline(df, ["series"], "x", "y").collect()
    assert all(abs(r.baseline - r.y) < 1e-9 for r in out if r.series == 1) and [r.baseline for r in out if r.series == 2] == [None]


def test_noise_and_bins(spark):
    rng = np.random.default_rng(7919)
    df = spark.createDataFrame([(1, i / 1440, float(1 + rng.normal(0, 0.002))) for i in range(300)], "series int, t double, y double")
    out = grids.noise_by_bin(df, ["series"], "t", "y", [2 / 1440, 5 / 1440, 10 / 1440, 20 / 1440]).collect()
    assert len(out) == 4 and all(0 < r.beta < 2 for r in out)
    few = spark.createDataFrame([(1, x, 1.0) for x in (0.0, 0.05, 0.20, 0.22)], "series int, h double, v double")
    bins = grids.binned(few, ["series"], F.floor(F.col("h") * 6), F.col("h"), F.col("v")).collect()
    assert len(bins) == 2 and sum(r.n for r in bins) == 4


def test_periods(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 30, 1500))
    y = 1 - 0.02 * (np.abs((t + 1.45) % 2.9 - 1.45) < 0.1) + rng.normal(0, 0.002, 1500)
    df = spark.createDataFrame([(1, float(a), float(b), 0.002) for a, b in zip(t, y, strict=True)], "series int, t double, y double, e double")
    periods = [2.5 + 0.05 * i for i in range(17)]
    best = grids.box_periods(df, ["series"], "t", "y", "e", periods, [0.1, 0.2], bins=100).orderBy(F.desc("snr")).first()
    assert abs(best.period - 2.9) < 1e-9 and 0.01 < best.depth < 0.025
    y = 1 + 0.01 * np.sin(2 * np.pi * 0.7 * t)
    wave = spark.createDataFrame([(1, float(a), float(b), 0.002) for a, b in zip(t, y, strict=True)], "series int, t double, y double, e double")
    power = grids.periodogram(wave, ["series"], "t", "y", "e", [0.1 * i for i in range(1, 15)]).orderBy(F.desc("power")).first()
    assert abs(power.frequency - 0.7) < 1e-9 and power.power > 0.99


def test_robust_statistics(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(1, v) for v in x], "g int, x double")
    got = stats.mad_raw(df, ["g"], F.col("x")).first()
    assert (got.n, got.median) == (5, 3.0) and math.isclose(got.mad, 1.4826)
    assert math.isclose(stats.mad_normalized(df, ["g"], "x").first().mad, 1.4826 / 3)
    assert {r.z for r in stats.robust_z(df, ["g"], "x").collect()} == {0.0, None}
    flat = spark.createDataFrame([(1, 5.0)] * 4, "g int, x double")
    assert stats.centre_and_noise(flat, ["g"], "x").first().noise == 0.0
    pair = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.5), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 5.0), (3, 1.0, 6.0), (3, 1.0, 7.0)], "g int, a double, b double")
    c = dict(pair.groupBy("g").agg(stats.correlation(F.col("a"), F.col("b"))).collect())
    assert c[1] > 0.99 and c[2] is None and c[3] is None
    ok = stats.plateau(spark.createDataFrame([(1, 1.0, 2.0), (2, 1.09, 2.0), (3, 1.11, 2.0)], "r int, a double, b double"), "a", "b")
    assert [r.passes for r in ok.orderBy("r").collect()] == [True, True, False]


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, float(i if i < 5 else i + 9), float(i % 2)) for i in range(17)], "series int, n int, t double, v double")
    assert windows.sections(df, ["series"], "t", 3.0, "n").agg(F.max("section")).first()[0] == 1
    assert windows.strictly_rising(df, ["series"], "t", "n").first().rising
    assert not windows.strictly_rising(df, ["series"], "v", "n").first().rising
    assert sorted(r[1] for r in windows.folds(df, ["series"], ["n"]).groupBy("fold").count().collect()) == [2] * 7 + [3]
    spike = spark.createDataFrame([(1, i, 5.0 if i == 8 else 1.0) for i in range(17)], "series int, n int, v double")
    assert [r.n for r in windows.isolated_outliers(spike, ["series"], ["n"], "v").filter("outlier").collect()] == [8]
    assert rows(windows.gap_check(df, ["series"], "t", F.lit(4.5), F.lit(13.5))) == [(1, 4.0, 14.0, 0)]
    assert [r.meridian for r in windows.meridian_side(df, ["series"], "n", "v").orderBy("n").limit(3).collect()] == [0, 1, 1]


def test_selections(spark):
    p = spark.createDataFrame([(1, 1.0, 9.0), (1, 1.02, 8.0), (1, 2.0, 7.0), (1, 3.0, 9.0)], "series int, x double, p double")
    assert rows(selection.peaks(p, ["series"], "x", "p", 0.03, 5)) == [(1, 1, 1.0, 9.0), (1, 2, 3.0, 9.0), (1, 3, 2.0, 7.0)]
    assert selection.peaks(p, ["series"], "x", "p", 0.03, 2).count() == 2
    xy = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (1, 3.0, 4.0, 4.0), (1, 9.0, 0.0, 3.0)], "series int, x double, y double, f double")
    assert [r.f for r in selection.spaced_stars(xy, ["series"], "x", "y", "f", 6.0, 9).orderBy("rank").collect()] == [5.0, 3.0]
    m = spark.createDataFrame([(1, "a", 3, 1.0, True), (1, "b", 2, 1.005, True), (1, "c", 1, 0.5, False), (2, "a", 1, 1.0, False)], "g int, m string, k int, s double, ok boolean")
    assert rows(selection.parsimonious(m, ["g"], "s", "k", "m", "ok")) == [(1, "b"), (2, "none")]
    d = spark.createDataFrame([("f", 2, "x"), ("f", 1, "x"), ("g", 1, "x"), ("g", 2, "y")], "k string, o int, id string")
    assert [(r.k, r.copies, r.chosen.o, r.conflict) for r in selection.resolved_duplicates(d, ["k"], [F.col("o")], ["id"]).orderBy("k").collect()] == [("f", 2, 1, False), ("g", 2, 1, True)]


def test_backward_elimination_drops_the_noisy_star(spark):
    rng = np.random.default_rng(0)
    data = []
    for f in range(80):
        t = 100 + rng.normal(0, 0.05)
        data += [(f, f"C{s}", float(100 + rng.normal(0, 30 if s == 3 else 0.05)), float(t)) for s in range(1, 8)]
    df = spark.createDataFrame(data, "frame int, star string, counts double, t double")
    names, _ = selection.backward_elimination(df, "frame", "star", "counts", "t")
    assert "C3" not in names and len(names) >= 5


def test_stamps(spark):
    disc = spark.createDataFrame([(1, [1.0] * 49)], "i int, p array<double>")
    px = pixels.pixels(disc, ["i"], "p", 7).withColumn("error", F.lit(0.2))
    got = pixels.apertures(px, ["i"], 3.0, 3.0, [1.0], 2.0, 3.0).first()
    ring = sum(2 < math.hypot(y - 3, x - 3) <= 3 for y in range(7) for x in range(7))
    assert (got.n, got.flux, got.background) == (5, 0.0, 1.0) and math.isclose(got.background_error, 1.253 * 0.2 / math.sqrt(ring))
    delta = [0.0] * 121
    delta[6 * 11 + 4] = 1.0
    c = pixels.centroid(pixels.pixels(spark.createDataFrame([(1, delta)], "i int, p array<double>"), ["i"], "p", 11), ["i"]).first()
    assert (c.cx, c.cy) == (4.0, 6.0)
    far = pixels.centroid(pixels.pixels(spark.createDataFrame([(1, delta)], "i int, p array<double>"), ["i"], "p", 11), ["i"], (9.0, 2.0, 3.0)).first()
    assert (far.total, far.cx, far.cy) == (0.0, None, None)
    px = pixels.pixels(spark.createDataFrame([(1, [float(i) for i in range(30)])], "i int, p array<double>"), ["i"], "p", 6)
    moved = {(r.y, r.x): r.value for r in pixels.shifted(px, ["i"], -1, 2, 5, 6, -1.0).collect()}
    assert moved == {(y, x): float((y + 1) * 6 + x - 2) if y < 4 and x >= 2 else -1.0 for y in range(5) for x in range(6)}
    tilt = pixels.pixels(spark.createDataFrame([(1, [15000.0 + 12 * (i % 16) - 7 * (i // 16) + (9e4 if i == 40 else (i * 7919 % 13 - 6) / 6) for i in range(192)])], "i int, p array<double>"), ["i"], "p", 16)
    fit = pixels.plane(tilt, ["i"], 12, 16).first()
    assert abs(fit.slope_x - 12 * 7.5) < 0.5 and abs(fit.slope_y + 7 * 5.5) < 0.5 and fit.n == 191
    assert pixels.plane(tilt, ["i"], 12, 16, least=10_000).count() == 0


def test_difference_image_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[:9, :9]
    star = 100 * np.exp(-((yy - 4) ** 2 + (xx - 4) ** 2) / 3)
    source = 5 * np.exp(-((yy - 4) ** 2 + (xx - 5) ** 2) / 1.5)
    data = [(e * 10 + k, e, int(k < 3), (50 + k + star - source * (k < 3) + rng.normal(0, 0.01, (9, 9))).ravel().tolist()) for e in range(6) for k in range(9)]
    df = spark.createDataFrame(data, "stamp int, event int, inn int, p array<double>")
    px = pixels.pixels(df.withColumn("g", F.lit(1)), ["g", "stamp", "event", "inn"], "p", 9)
    diff = pixels.event_differences(px, ["g"], "event", "stamp", F.col("inn") == 1, F.col("inn") == 0, 4.0, 4.0, 2.0, (3.5, 4.5))
    image = {(r.y, r.x): r.value for r in pixels.difference_image(diff, ["g"]).collect()}
    assert max(image, key=image.get) == (4, 5)
    got = pixels.bootstrap_centroids(diff, ["g"], "event", (4.0, 4.0, 3.0), draws=50).first()
    assert abs(got.cx - 5) < 0.3 and abs(got.cy - 4) < 0.1 and 0 < got.radius < 0.1


def test_shifts(spark):
    rng = random.Random(4)
    base = np.zeros((32, 32))
    for _ in range(6):
        y0, x0 = rng.randint(8, 23), rng.randint(8, 23)
        yy, xx = np.mgrid[:32, :32]
        base += 500 * np.exp(-((yy - y0) ** 2 + (xx - x0) ** 2) / 8)
    moved = np.roll(base, (3, -5), (0, 1))
    df = spark.createDataFrame([(1, moved.ravel().tolist()), (2, base.ravel().tolist()), (3, None)], "k int, p array<double>")
    assert rows(pixels.fft_shifts(df, "k", "p", base.ravel().tolist(), 32, 32)) == [(1, 3, -5), (2, 0, 0), (3, None, None)]
    pairs = spark.createDataFrame([(1, 7.1, -5.0), (1, 6.9, -5.1), (1, 7.0, -4.9), (1, 7.0, -5.0), (1, 40.0, 9.0)], "f int, dx double, dy double")
    s = match.star_shift(pairs, ["f"], F.col("dx"), F.col("dy")).first()
    assert (s.dx, s.dy, s.stars) == (7.0, -5.0, 4) and s.rms < 0.6


def plain_huber(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(200):
        e = y - x @ b
        s = 1.4826 * np.median(abs(e - np.median(e)))
        w = np.minimum(1, 1.345 * s / np.maximum(abs(e - np.median(e)), 1e-300))
        b = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))
    return b


def test_huber(spark):
    rng = np.random.default_rng(3)
    data = []
    for g in range(3):
        for i in range(101):
            a, c = rng.normal(), rng.uniform(-2, 2)
            data.append((g, i, a, c, float(1 - 0.02 * a + 0.1 * g * c + rng.normal(0, 0.003) + (1 if i % 17 == 5 else 0))))
    df = spark.createDataFrame([*data, (0, 200, None, 1.0, 9.0), (1, 200, 1.0, 1.0, None)], "g int, i int, a double, c double, y double")
    got = {r.g: r["_beta"] for r in regression.huber(df, ["g"], F.col("y"), F.array(F.lit(1.0), "a", "c"), 3).collect()}
    for g in range(3):
        part = np.array([r[2:] for r in data if r[0] == g])
        assert np.allclose(got[g], plain_huber(part[:, :2], part[:, 2]), atol=1e-8)
    flat = regression.without_baseline(df, ["g"], "y", ["a", "c"])
    for g in range(3):
        part = np.array([r[2:] for r in data if r[0] == g])
        base = np.column_stack([np.ones(101), part[:, :2]]) @ plain_huber(part[:, :2], part[:, 2])
        want = part[:, 2] - (base - np.median(base))
        rows_ = {r.i: r.corrected for r in flat.filter((F.col("g") == g) & (F.col("i") < 200)).collect()}
        assert np.allclose([rows_[i] for i in range(101)], want / np.median(want), atol=1e-8)
    assert flat.count() == len(data) + 2 and flat.filter("corrected is null").count() == 2


def test_cross_validation_promotes_a_trend_and_rejects_noise(spark):
    data = [(1, i, math.sin(i / 9), math.sin(i / 9) * 0.5 + 0.001 * (-1) ** i) for i in range(240)]
    data += [(2, i, math.sin(i / 9), float((-1) ** i)) for i in range(240)]
    df = spark.createDataFrame(data, "series int, n int, airmass double, y double")
    cv = regression.cross_validated(df, ["series"], ["n"], "y", {"airmass": ["airmass"]})
    assert rows(selection.parsimonious(cv, ["series"], "mad", "parameters", "model", "passes")) == [(1, "airmass"), (2, "none")]


def test_photometry(spark):
    data = [(f, s, float(100 * s * (1 + 0.01 * (f % 3))), 1.0, float(f), float(f % 3)) for f in range(30) for s in range(1, 5)]
    df = spark.createDataFrame(data, "frame int, star int, counts double, error double, airmass double, fwhm double")
    curve = photometry.target_curve(df, 1).collect()
    assert all(abs(r.relative - 1) < 1e-12 for r in curve)
    assert all(abs(r.relative - 1) < 1e-12 for r in photometry.ensembles(df, 1).collect())
    assert all(abs(r.other - r.counts / sum(100 * s * (1 + 0.01 * (r.frame % 3)) for s in range(1, 5) if s != r.star)) < 1e-12 for r in photometry.leave_one_out(df).collect())


def test_matches(spark):
    a = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0)], "k int, ra double, dec double")
    b = spark.createDataFrame([(7, 10.0, 0.0005), (8, 10.0, 0.0002), (9, 10.0, 0.01)], "n int, ra double, dec double")
    got = rows(match.sky_matches(a, b, "k", ("ra", "dec"), ("ra", "dec"), "n", 3.0))
    assert got[0][:3] == (1, 2, 8) and abs(got[0][3] - 0.72) < 1e-6 and got[0][4] == "matched" and got[1] == (2, 0, None, None, "none")
    rng = random.Random(1)
    at = lambda k: [(i, rng.uniform(-0.01, 0.01) % 360, rng.choice([0.0, 45.0, -88.5, 89.9]) + rng.uniform(-0.01, 0.01)) for i in range(k)]
    u, v = at(120), at(300)
    def sep(p, q):
        (a, d), (b, e) = (map(math.radians, x[1:]) for x in (p, q))
        return math.degrees(2 * math.asin(math.sqrt(math.sin((d - e) / 2) ** 2 + math.cos(d) * math.cos(e) * math.sin((a - b) / 2) ** 2))) * 3600
    got = {r.k: r.matches for r in match.sky_matches(spark.createDataFrame(u, "k int, ra double, dec double"), spark.createDataFrame(v, "n int, ra double, dec double"), "k", ("ra", "dec"), ("ra", "dec"), "n", 12.0).collect()}
    assert got == {p[0]: sum(sep(p, q) <= 12 for q in v) for p in u} and sum(got.values()) > 50
    p = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(80)]
    near = match.within(spark.createDataFrame(p, "i int, x double, y double"), spark.createDataFrame(p, "j int, u double, v double"), ("x", "y"), ("u", "v"), 1.5)
    assert {(r.i, r.j) for r in near.collect()} == {(i, j) for i, x, y in p for j, u, v in p if math.hypot(x - u, y - v) <= 1.5}
    assert rows(match.missing_and_unexpected(a.select("k"), spark.createDataFrame([(2,), (3,)], "k int"), "k")) == [(1, "missing"), (3, "unexpected")]
    assert rows(match.one_to_one(a, b.select(F.lit(1).alias("k")), "k")) == [(1, "right", 3)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 5.0, "Light"), (2, None, "dark"), (2, 9.0, "light")], "k int, x double, kind string")
    got = rows(quality.violations(df, "k", {"x known": F.col("x").isNotNull(), "is light": F.lower("kind") == "light"}))
    assert got == [(2, "is light"), (2, "x known")]
    assert rows(quality.repeated(df, ["k"])) == [(2, 2)]
    left = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 3.0)], "k int, v double")
    assert rows(quality.differing(left, right, "k", {"v": 1e-6})) == [(2, "v", 2.0, 3.0)]
    with pytest.raises(ValueError):
        quality.only_row(df.filter("k = 2"))
    assert quality.at_least(df, 3).count() == 3
    for part in (df.limit(2), df.limit(0)):
        with pytest.raises(Exception, match="3 frames are needed"):
            quality.at_least(part, 3, "frames").collect()


def test_strings(spark):
    df = spark.createDataFrame([("0100", {"A": "1"}, {"B": "2"})], "v string, h map<string,string>, g map<string,string>")
    got = df.select(X.set_bits(F.col("v"), 10), X.header_value("B", F.col("h"), F.col("g")), X.header_value("C", F.col("h"), default="d")).first()
    assert tuple(got) == ("11", "2", "d")


def test_exact_overlap(spark):
    for r in (0.3, 1.0, 2.2, 3.4):
        w = pixels.overlap_weights(11, 11, 5.2, 4.7, r)
        assert math.isclose(sum(x[2] for x in w), math.pi * r * r, rel_tol=1e-9)
        fine = np.arange(-0.5, 0.5, 0.01) + 0.005
        for y, x, share in w[:: max(1, len(w) // 6)]:
            inside = (np.add.outer((y + fine - 4.7) ** 2, (x + fine - 5.2) ** 2) <= r * r).mean()
            assert abs(inside - share) < 0.01
    sky = [100.0] * 101 * 101
    sky[50 * 101 + 50] += 1000
    px = pixels.pixels(spark.createDataFrame([(1, sky)], "i int, p array<double>"), ["i"], "p", 101)
    got = pixels.exact_aperture(px, ["i"], 101, 101, 50.0, 50.0, 5.0, 10.0, 20.0).first()
    assert math.isclose(got.flux, 1000, rel_tol=1e-9) and got.background == 100


def test_representative_rows(spark):
    rng, data = random.Random(8), []
    for g, n in enumerate([4, 5, 6, 9, 13, 30, 60, 200]):
        data += [(g, 10 * i, rng.choice([1.0, 1.5, 2.0]) + i * 1e-3 * (g % 2)) for i in range(n)]
    got = {}
    for r in windows.representative_rows(spark.createDataFrame(data, "g int, frame int, airmass double"), ["g"], "frame", "airmass").collect():
        assert r.frame == 10 * r.row
        got.setdefault(r.g, {})[r.role] = r.row
    want = {}
    for g in range(1, 8):
        air = [a for h, _, a in data if h == g]
        n, m, used = len(air), air.index(min(air)), []
        for i in (0, n // 2, max(0, m - 12), min(n - 1, m + 12), n - 1):
            used.append(min((j for j in range(n) if j not in used), key=lambda j: (abs(j - i), j)))
        want[g] = dict(zip(windows.ROLES, used, strict=True))
    assert got == want


def test_zones_and_daylight_saving(spark):
    cases = [(1, "2022-07-22", 1200, 1410, 15), (2, "2022-01-10", 1200, 15, 90), (3, "2022-11-05", 1200, 30, 180), (4, "2022-07-22", 1200, 1300, 1250)]
    df = spark.createDataFrame(cases, "k int, d string, s int, i int, e int").withColumn("d", F.to_date("d"))
    got = {(r.k, r.zone): r for r in X.interpreted(df, "d", "s", "i", "e", ["America/New_York", "UTC"]).collect()}
    for k, day, start, i, e in cases:
        for zone in ("America/New_York", "UTC"):
            at = [(datetime.fromisoformat(day) + timedelta(days=int(m < start), minutes=m)).replace(tzinfo=ZoneInfo(zone)).timestamp() for m in (i, e)]
            r = got[k, zone]
            assert (r.ingress, r.egress, r.midpoint, r.duration, r.in_order) == (*at, sum(at) / 2, at[1] - at[0], at[0] < at[1])


def test_nearest_option_and_half_width(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 4.5), (3, None), (4, 99.0)], "k int, e double")
    options = spark.createDataFrame([(3.0,), (6.0,), (3.0,), (50.0,)], "t double")
    assert rows(match.nearest_option(df, F.col("e"), options, "t")) == [(1, 3.0, 3.0), (2, 4.5, 3.0), (3, None, None), (4, 99.0, 50.0)]
    profile = spark.createDataFrame([(1, 0, 0.2, 10.0), (1, 1, 0.7, 4.0), (1, 2, 1.2, 4.9), (1, 3, 1.7, 2.0), (2, 0, 0.2, 9.0), (2, 5, 2.6, 8.0)], "g int, bin long, radius double, value double")
    assert rows(pixels.half_width(profile, ["g"])) == [(1, 2.4), (2, None)]


def test_flat_field(spark):
    rng = np.random.default_rng(4)
    yy, xx = np.mgrid[:12, :16]
    true = 1 + 0.1 * rng.normal(size=(12, 16)).clip(-2, 2)
    dark = np.full((12, 16), 10.0)
    flats = [(k, (dark + (5000 + 300 * k) * (1 + 0.01 * k * (xx - 7.5)) * true).ravel().tolist()) for k in range(5)]
    raw = pixels.pixels(spark.createDataFrame(flats, "k int, p array<double>"), ["k"], "p", 16)
    base = pixels.pixels(spark.createDataFrame([(0, dark.ravel().tolist())], "k int, p array<double>"), ["k"], "p", 16).drop("k")
    got = np.zeros((12, 16))
    for r in pixels.flat_field(raw, base, "k", 12, 16).collect():
        got[r.y, r.x] = r.value
    assert abs(got.mean() - 1) < 1e-9 and np.abs(got - true / true.mean()).max() < 0.06
    plain = pixels.frame_summary(raw, ["k"], 4, 5000.0, 4000.0).filter("k = 0").first()
    first = np.array(flats[0][1])
    assert (plain.thumbnail, plain.saturated, plain.low) == (12, (first >= 5000).mean(), (first < 4000).mean())


def test_checks_see_a_changed_pixel(spark):
    px = pixels.pixels(spark.createDataFrame([(k, [float(i + k) for i in range(36)]) for k in range(3)], "k int, p array<double>"), ["k"], "p", 6)
    moved = pixels.shifted(px, ["k"], 1, -2, 6, 6, -5.0)
    assert rows(pixels.shift_check(moved, px, ["k"], 1, -2, 3, -5.0)) == [(k, 4, True, 2) for k in range(3)]
    spoilt = moved.withColumn("value", F.when((F.col("k") == 1) & (F.col("y") == 3) & (F.col("x") == 0), 7.7).otherwise(F.col("value")))
    assert [r[2] for r in rows(pixels.shift_check(spoilt, px, ["k"], 1, -2, 3, -5.0))] == [True, False, True]
    plain = px.filter("k = 0").select("y", "x", F.lit(2.0).alias("value"))
    good = pixels.calibrated(px, plain, plain, ["k"])
    assert all(r.exact and r.n > 0 for r in pixels.calibration_check(good, px, plain, plain, "k", 2).collect())
    bad = good.withColumn("value", (F.col("value") + F.when(F.col("k") == 2, 0.5).otherwise(0.0)).cast("float"))
    assert {r.k: (r.exact, r.largest) for r in pixels.calibration_check(bad, px, plain, plain, "k", 2).collect()} == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 0.5)}
