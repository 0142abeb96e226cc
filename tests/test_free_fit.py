import numpy as np
import pytest
from pyspark.sql import functions as F

from skylathe.operators import regression, windows


def _dense(x, y, e, floor=True):
    a, b = x / e[:, None], y / e
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    chi2 = float((((y - x @ beta) / e) ** 2).sum())
    reduced = chi2 / max(1, len(y) - x.shape[1])
    size = np.sqrt((a * a).sum(axis=0)) if np.linalg.matrix_rank(a / np.maximum(np.sqrt((a * a).sum(axis=0)), 1e-300)) == a.shape[1] else np.ones(a.shape[1])
    covariance = np.linalg.pinv(a.T @ a / np.outer(size, size)) / np.outer(size, size)  # of columns of equal length where they are independent
    return beta, covariance * (max(1.0, reduced) if floor else reduced), chi2, reduced


@pytest.mark.parametrize("kind", ["plain", "dependent", "sizes", "few", "zero"])
def test_any_design_equals_a_dense_solve(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 3 if kind == "few" else 200
    t = rng.uniform(0, 10, (2, n))
    make = {"plain": lambda t: [t**0, t, t**2, np.cos(t)], "dependent": lambda t: [t**0, t, 2 * t + 3, np.sin(t)], "sizes": lambda t: [t**0, 1e6 * t, 1e-5 * np.cos(t)], "few": lambda t: [t**0, t, t**2, t**3, np.cos(t)], "zero": lambda t: [t**0, 0 * t, t]}[kind]
    rows = []
    for g in range(2):
        x = np.stack(make(t[g]), axis=1)
        y = x @ rng.normal(0, 1, x.shape[1]) + rng.normal(0, 0.3, n)
        rows += [(g, [float(v) for v in row], float(b), float(e)) for row, b, e in zip(x, y, rng.uniform(0.1, 0.5, n), strict=True)]
    p = len(rows[0][1])
    df = spark.createDataFrame([*rows, (0, [1.0] * p, None, 0.1), (0, [None] * p, 1.0, 0.1), (1, [1.0] * p, 1.0, 0.0)], "g int, x array<double>, y double, e double").repartition(3)
    for floor in (True, False):
        got = {r.g: r for r in regression.free_fit(df, ["g"], F.col("y"), F.col("e"), [F.col("x")[j] for j in range(p)], floor).collect()}
        for g in range(2):
            own = [r for r in rows if r[0] == g]
            beta, covariance, chi2, reduced = _dense(*(np.array([r[i] for r in own]) for i in (1, 2, 3)), floor)
            scale = np.abs(np.array([r[1] for r in own])).max(axis=0)
            assert np.abs((got[g].beta - beta) * scale).max() < 1e-6
            assert got[g].n == n and got[g].rank == {"plain": 4, "dependent": 3, "sizes": 3, "few": 3, "zero": 2}[kind]
            assert got[g].chi2 == pytest.approx(chi2, rel=1e-7, abs=1e-9)
            if kind != "few":
                assert (np.abs(np.array(got[g].covariance).reshape(p, p) - covariance) * np.outer(scale, scale)).max() <= 1e-6 * (np.abs(covariance) * np.outer(scale, scale)).max()
                assert got[g].reduced == pytest.approx(reduced, rel=1e-7)


def test_moving_medians_over_chunks(spark):
    rng = np.random.default_rng(7)
    rows = [(s, int(t), None if rng.random() < 0.1 else float(v), f"r{i}") for s in ("a", None) for i, (t, v) in enumerate(zip(rng.integers(-5000, 5000, 300), rng.integers(0, 9, 300), strict=True))]
    rows += [("a", None, 1.0, "none"), ("b", 7, 2.0, "one"), ("a", 10, float("nan"), "nan")]
    df = spark.createDataFrame(rows, "s string, us long, v double, name string").repartition(4)
    for width, chunk in ((200, 2), (2001, 1), (20000, 16), (0, 16)):
        got = windows.moving_median(df, ["s"], "us", "v", width, 2, chunk=chunk)
        assert got.columns == [*df.columns, "moving"]
        want = {}
        for s, t, _, name in rows:
            near = [] if t is None else [v for q, u, v, _ in rows if q == s and u is not None and v is not None and v == v and abs(u - t) <= width // 2]
            want[s, name] = float(np.median(near)) if len(near) >= 2 else None
        assert {(r.s, r.name): r.moving for r in got.collect()} == want


def test_points_of_box_fits_are_not_shuffled_to_meet_their_means(spark):
    from skylathe.operators import fits

    df = spark.range(200).select((F.col("id") % 2).alias("s"), (F.col("id") / 10.0).alias("x"), (F.col("id") % 7 / 1.0).alias("y"), F.lit(1.0).alias("e"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where many copies of the points look large
    try:
        base, _ = fits.box_sums(df, ["s"], None, "x", "y", "e", fits.grid(spark, [1.0], [0.0]), 0.02)
        plan = base._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and base.count() == 2
