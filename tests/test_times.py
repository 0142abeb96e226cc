import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylathe.functions import times

#: Published instants of a star at right ascension 19.802897222222224 h, declination 18.69891388888889 degrees.
PUBLISHED = {
    "2022-07-22 01:10:00": 2459782.5539275403, "2022-07-22 04:15:00": 2459782.6824005991, "2022-07-22 05:54:00": 2459782.7511509927, "2022-07-22 08:55:00": 2459782.8768460616,
    "2022-07-21 21:10:00": 2459782.3872596794, "2022-07-22 00:15:00": 2459782.5157328276, "2022-07-22 01:54:00": 2459782.5844833050, "2022-07-22 04:55:00": 2459782.7101785406,
}


def test_published_times_within_a_tenth_of_a_second(spark):
    rows = [(i, ts, 19.802897222222224 * 15, 18.69891388888889) for i, ts in enumerate(PUBLISHED)]
    df = spark.createDataFrame(rows, "i int, ts string, ra double, dec double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = times.barycentric(df, "ts", "ra", "dec", -77.3053299972, 38.82817).collect()
    for r in got:
        assert abs(r.bjd_tdb - PUBLISHED[str(r.ts)]) * 86400 < 0.1
        assert r.tai_utc == 37 and abs(r.tdb_utc_s - 69.184) < 0.002
    centre = times.barycentric(df, "ts", "ra", "dec").collect()
    assert all(0 < abs(a.light_s - b.light_s) < 0.022 for a, b in zip(got, centre, strict=True))


@pytest.mark.parametrize(("ts", "offset"), [("1971-12-31 23:59:59", None), ("1972-01-01 00:00:00", 10), ("1972-06-30 23:59:59", 10), ("1972-07-01 00:00:00", 11), ("1987-05-05 01:00:00", 23), ("2016-12-31 23:59:59", 36), ("2017-01-01 00:00:00", 37), ("2150-01-01 00:00:00", 37)])
def test_offsets_hold_until_the_next_is_told(spark, ts, offset):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(ts),)], "ts timestamp_ntz")
    assert times.with_leaps(df, "ts").first().tai_utc == offset


def test_light_turns_with_the_year_and_the_side(spark):
    days = spark.range(0, 4000, 5).select(F.col("id").cast("double").alias("d"), F.lit(0.0).alias("ra"), F.lit(0.0).alias("dec"))
    one = times.light_seconds(days, "d", "ra", "dec").agg(F.max("light_s"), F.min("light_s")).first()
    assert 495 < one[0] < 506 and -506 < one[1] < -495
    other = times.light_seconds(days.withColumn("ra", F.lit(180.0)), "d", "ra", "dec").agg(F.max("light_s")).first()
    assert abs(other[0] + one[1]) < 1e-9
    pole = times.light_seconds(days.withColumn("dec", F.lit(90.0)), "d", "ra", "dec").agg(F.max("light_s")).first()
    assert 190 < pole[0] < 202


def test_missing_values_give_null(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (dt.datetime(2020, 1, 1), None, 1.0), (dt.datetime(1960, 1, 1), 1.0, 1.0)], "ts timestamp_ntz, ra double, dec double")
    assert {r.bjd_tdb for r in times.barycentric(df, "ts", "ra", "dec").collect()} == {None}
    assert times.barycentric(df.limit(0), "ts", "ra", "dec").count() == 0
