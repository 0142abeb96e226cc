import statistics

import pytest
from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import match, photometry, regression


def test_the_nearest_other_source_is_not_the_target(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 0.0), ("a", 2, 6.0, 0.0), ("a", 3, 0.0, 6.0), ("a", 4, 9.0, 9.0), ("b", 5, 1.0, 1.0), ("c", 6, None, 9.0)], "field string, id int, x double, y double")
    got = match.nearest_other(df, ["field"], F.col("x"), F.col("y"), ["id"], 5.0).collect()
    assert [tuple(r) for r in got] == [("a", 6.0, 2)]


def test_the_level_falls_back_on_the_last_fifth(spark):
    rows = [("few", float(t), 1.0 + t) for t in range(20)] + [("many", float(t), 2.0 if t > 15 else 1.0 if 5 <= t <= 10 else 1.5) for t in range(40)]
    df = spark.createDataFrame(rows, "s string, t double, f double")
    got = {r.s: r for r in photometry.post_window_depth(df, ["s"], "t", "f", 5.0, 10.0, 0.5).collect()}
    assert got["few"].level == statistics.median([1.0 + t for t in range(16, 20)])
    assert got["many"].level == 2.0 and got["many"].depth == pytest.approx(0.5)


def test_frames_outside_or_unsteady_are_not_good(spark):
    rows = [(f, s, 100.0 + f % 3, 5.0, f != 4, 9.0 if f == 7 else 1.0) for f in range(12) for s in range(1, 9)]
    df = spark.createDataFrame(rows, "frame int, star int, counts double, sky double, inside boolean, rms double")
    plain = photometry.quality_frames(df, 1, "sky").filter("good").count()
    strict = photometry.quality_frames(df, 1, "sky", inside=F.col("inside"), rms="rms").filter("good")
    assert plain == 12 and sorted(r.frame for r in strict.collect()) == [f for f in range(12) if f not in (4, 7)]


def test_matches_within_an_aperture_are_counted(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 50.0, 0.0)], "k int, ra double, dec double")
    right = spark.createDataFrame([(7, 10.0, 1 / 3600), (8, 10.0, 5 / 3600), (9, 10.0, 9 / 3600)], "n int, ra double, dec double")
    got = match.sky_matches(left, right, "k", ("ra", "dec"), ("ra", "dec"), "n", 8.0, aperture=3.0).orderBy("k").collect()
    assert [(r.k, r.matches, r.within_aperture) for r in got] == [(1, 2, 1), (2, 0, 0)]


def test_four_clocks_of_a_night(spark):
    df = spark.createDataFrame([(1, "2022-07-21", 1270, 15, 114, 295), (2, "2022-07-21", 1270, 15, 10, 295)], "id int, day string, s int, i int, e int, n int").withColumn("day", F.to_date("day"))
    rows = X.interpreted(df, "day", "s", "i", "e", ["America/New_York", "UTC"], "n").collect()
    first = next(r for r in rows if r.id == 1 and r.zone == "America/New_York")
    told = spark.range(1).select(*[F.unix_seconds(F.lit(f"2022-07-22 {c}:00").cast("timestamp")) for c in ("01:10", "04:15", "05:54", "08:55")]).first()
    assert (first.night_start, first.ingress, first.egress, first.night_end) == tuple(told)
    assert first.in_order and first.duration == 99 * 60
    assert [r.in_order for r in rows if r.id == 2] == [False, False]


def test_too_few_rows_have_no_robust_fit(spark):
    rows = [("two", float(x), 2.0 * x) for x in range(2)] + [("ten", float(x), 2.0 * x + 1) for x in range(10)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = regression.huber(df, ["k"], F.col("y"), F.array(F.lit(1.0), F.col("x")), 2).collect()
    assert [r.k for r in got] == ["ten"] and got[0]._beta == pytest.approx([1.0, 2.0])
