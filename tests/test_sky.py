import math
import random

import pytest
from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import selection

# The published solution of a field of 4096 pixels.
CRVAL, CRPIX = (297.080937129, 18.5863597645), (1485.25152505, 2858.06495437)
CD = (-0.000100592100943, -1.11552035049e-06, 1.14150205365e-06, -0.000100575042801)
A = {(0, 2): -1.42297262175e-07, (1, 1): 8.06329045363e-08, (2, 0): -2.55790424637e-07}
B = {(0, 2): 2.3632821324e-08, (1, 1): -6.91124785804e-08, (2, 0): 6.04097426465e-08}
AP = {(0, 0): -0.000339375017364, (0, 1): -2.10001250774e-08, (0, 2): 1.42398332027e-07, (1, 0): 2.43548977645e-07, (1, 1): -8.08918009012e-08, (2, 0): 2.56088278971e-07}
BP = {(0, 0): 0.000111328182124, (0, 1): 2.39931849277e-08, (0, 2): -2.36750296751e-08, (1, 0): -5.22886074306e-08, (1, 1): 6.91968149774e-08, (2, 0): -6.04974073615e-08}


def test_distorted_pixels_come_back(spark):
    grid = spark.range(0, 4097, 128).select(F.col("id").cast("double").alias("x")).crossJoin(spark.range(0, 4097, 128).select(F.col("id").cast("double").alias("y")))
    ra, dec = X.position_sip(F.col("x"), F.col("y"), CRVAL, CRPIX, CD, A, B)
    sky = grid.select("x", "y", ra.alias("ra"), dec.alias("dec"))
    px, py = X.pixel_sip(F.col("ra"), F.col("dec"), CRVAL, CRPIX, CD, A, B)
    worst = sky.agg(F.max(F.hypot(px - F.col("x"), py - F.col("y")))).first()[0]
    assert worst < 1e-6
    tx, ty = X.pixel_tan(F.col("ra"), F.col("dec"), CRVAL, CRPIX, CD)
    u, v = tx - CRPIX[0], ty - CRPIX[1]
    published = sky.agg(F.max(F.hypot(tx + X._polynomial(u, v, AP) - F.col("x"), ty + X._polynomial(u, v, BP) - F.col("y")))).first()[0]
    assert published < 0.01  # the field's own inverse polynomials agree to their accuracy
    far = spark.range(1).select(*[c.alias(n) for c, n in zip(X.pixel_sip(F.lit(CRVAL[0] + 180), F.lit(-CRVAL[1]), CRVAL, CRPIX, CD, A, B), "xy", strict=True)]).first()
    assert far.x is None and far.y is None


def _greedy(rows, apart, most):
    out = {}
    for g in {r[0] for r in rows}:
        kept = []
        for f, x, y in sorted({(-r[3], r[1], r[2]) for r in rows if r[0] == g}):
            if (most is None or len(kept) < most) and all(math.hypot(x - a, y - b) >= apart for _, a, b in kept):
                kept.append((f, x, y))
        out |= {(g, i): (x, y, -f) for i, (f, x, y) in enumerate(kept, 1)}
    return out


@pytest.mark.parametrize(("apart", "most", "view"), [(60.0, 25, 8), (25.0, None, 2), (300.0, 3, 1), (5000.0, 10, 8)])
def test_spaced_sources_are_the_greedy_ones(spark, apart, most, view):
    rng = random.Random(int(apart))
    rows = [(g, float(rng.randint(-300, 300)), float(rng.randint(-300, 300)), float(rng.randint(0, 40))) for g in ("a", "b", None) for _ in range(150)]
    rows += rows[:20] + [("c", float(10 * i), 0.0, float(100 - i)) for i in range(60)] + [("a", 0.0, 0.0, None), ("a", None, 0.0, 1000.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, f double").repartition(5)
    got = {(r.g, r["rank"]): (r.x, r.y, r.f) for r in selection.spaced_stars(df, ["g"], "x", "y", "f", apart, most, view).collect()}
    assert got == _greedy([r for r in rows if None not in r[1:]], apart, most)


def test_no_sources(spark):
    df = spark.createDataFrame([], "g string, x double, y double, f double")
    assert selection.spaced_stars(df, ["g"], "x", "y", "f", 5.0, 10).count() == 0
    with pytest.raises(ValueError, match="positive"):
        selection.spaced_stars(df, ["g"], "x", "y", "f", 0.0, 10)


def test_nearly_equal_separations_rank_as_in_sql(spark, tmp_path):
    import duckdb

    from skylathe.plans import further

    spark.createDataFrame([(1653,), (13809,), (1,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = [(r.c_custkey, r["rank"]) for r in further.cone_search(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == con.execute(f"select c_custkey, rank from ({further.ORACLES['cone_search']}) q order by rank").fetchall()
