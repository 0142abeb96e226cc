"""Barycentric dynamical time of UTC instants.

The Earth's place is that of the Earth-Moon barycentre on its mean ellipse, less the Moon's pull; the
Sun's place about the barycentre of the planets comes from the four giants. Against published values the
light travel time is right to a few hundredths of a second (at most about 0.1 s from 1972 to 2050).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# TAI less UTC in seconds from each date on (IERS Bulletin C).
LEAPS = {
    "1972-01-01": 10, "1972-07-01": 11, "1973-01-01": 12, "1974-01-01": 13, "1975-01-01": 14, "1976-01-01": 15, "1977-01-01": 16, "1978-01-01": 17, "1979-01-01": 18, "1980-01-01": 19,
    "1981-07-01": 20, "1982-07-01": 21, "1983-07-01": 22, "1985-07-01": 23, "1988-01-01": 24, "1990-01-01": 25, "1991-01-01": 26, "1992-07-01": 27, "1993-07-01": 28, "1994-07-01": 29,
    "1996-01-01": 30, "1997-07-01": 31, "1999-01-01": 32, "2006-01-01": 33, "2009-01-01": 34, "2012-07-01": 35, "2015-07-01": 36, "2017-01-01": 37,
}
#: Last half-year that the joined table tells; later instants have the last value.
UNTIL = 2100

# Mean orbits at J2000 and their change a century (E. M. Standish, Keplerian elements for approximate
# positions, 1800 to 2050): axis in au, eccentricity, inclination, mean longitude, longitude of perihelion, of node in degrees.
ORBITS = {
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}
# Mass of the Sun over that of each (IAU).
MASSES = {"jupiter": 1047.3486, "saturn": 3497.898, "uranus": 22902.98, "neptune": 19412.24, "earth": 328900.56}
#: Light time of an au in seconds; the Moon's mean distance over 82.3 (the Earth's share), in au; tilt of the ecliptic.
AU_S, MOON_AU, TILT = 499.004783836, 384400 / 82.30057 / 149597870.7, math.radians(23.43928)
EARTH_RADIUS_S = 6378.137 / 299792.458


def leap_table(spark: SparkSession) -> DataFrame:
    """half (2 x year + 0 or 1), tai_utc: the offset that holds in each half-year, as seconds are put in only
    between half-years. 258 rows at most."""
    steps = sorted((2 * int(d[:4]) + (d[5:7] == "07"), s) for d, s in LEAPS.items())
    halves = range(steps[0][0], 2 * UNTIL)
    return spark.createDataFrame([(h, max(s for at, s in steps if at <= h)) for h in halves], "half int, tai_utc int")


def with_leaps(df: DataFrame, ts: str) -> DataFrame:
    """df with tai_utc, the last offset told before each instant; null before 1972."""
    half = (F.year(ts) * 2 + (F.month(ts) > 6).cast("int")).alias("half")
    table = leap_table(df.sparkSession).withColumnRenamed("half", "_half")
    last = max(LEAPS.values())
    out = df.withColumn("_h", half).join(F.broadcast(table), F.col("_h") == F.col("_half"), "left")
    return out.withColumn("tai_utc", F.when(F.col("_h") >= 2 * UNTIL, last).otherwise(F.col("tai_utc"))).drop("_h", "_half")


def _place(name: str, t: Column) -> tuple[Column, Column, Column]:
    """Heliocentric ecliptic position in au at centuries since J2000."""
    a, e, i, mean, peri, node = (F.lit(x) + t * d for x, d in zip(*ORBITS[name], strict=True))
    m = F.radians(F.pmod(mean - peri, F.lit(360.0)))
    true = m + (e * 2 - e * e * e / 4) * F.sin(m) + e * e * 1.25 * F.sin(m * 2) + e * e * e * (13 / 12) * F.sin(m * 3)
    r = a * (F.lit(1.0) - e * e) / (F.lit(1.0) + e * F.cos(true))
    u, w, tilt = true + F.radians(peri - node), F.radians(node), F.radians(i)
    return r * (F.cos(w) * F.cos(u) - F.sin(w) * F.sin(u) * F.cos(tilt)), r * (F.sin(w) * F.cos(u) + F.cos(w) * F.sin(u) * F.cos(tilt)), r * F.sin(u) * F.sin(tilt)


def light_seconds(df: DataFrame, day: str, ra: str, dec: str, longitude: float | None = None, latitude: float | None = None) -> DataFrame:
    """df with light_s: seconds by which light from a position (degrees) reaches the barycentre later than the
    Earth, at days since J2000.0. With a place on Earth (longitude east), its distance from the Earth's
    centre counts too."""
    t = F.col(day) / 36525.0
    places = df
    for name in ORBITS:
        x, y, z = _place(name, t)
        places = places.withColumn(f"_{name}", F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    moon = F.radians(F.pmod(F.lit(134.963) + t * 477198.868, F.lit(360.0)))
    lon = F.radians(F.pmod(F.lit(218.316) + t * 481267.881, F.lit(360.0)) + F.sin(moon) * 6.289)
    lat = F.radians(F.sin(F.radians(F.pmod(F.lit(93.272) + t * 483202.018, F.lit(360.0)))) * 5.128)
    near = {"x": F.cos(lon) * F.cos(lat), "y": F.sin(lon) * F.cos(lat), "z": F.sin(lat)}
    # The Sun lies off the barycentre by what the planets weigh on the other side.
    at = {c: F.col("_earth")[c] - sum(F.col(f"_{p}")[c] / (m + 1) for p, m in MASSES.items()) - near[c] * MOON_AU for c in "xyz"}
    a, d = F.radians(ra), F.radians(dec)
    y, z = at["y"] * math.cos(TILT) - at["z"] * math.sin(TILT), at["y"] * math.sin(TILT) + at["z"] * math.cos(TILT)
    light = (at["x"] * F.cos(d) * F.cos(a) + y * F.cos(d) * F.sin(a) + z * F.sin(d)) * AU_S
    if longitude is not None:
        hour = F.radians(F.pmod(F.lit(280.46061837) + F.col(day) * 360.98564736629 + longitude - F.col(ra), F.lit(360.0)))
        up = F.sin(d) * math.sin(math.radians(latitude)) + F.cos(d) * math.cos(math.radians(latitude)) * F.cos(hour)
        light = light + up * EARTH_RADIUS_S
    return places.withColumn("light_s", light).drop(*(f"_{p}" for p in ORBITS))


def barycentric(df: DataFrame, ts: str, ra: str, dec: str, longitude: float | None = None, latitude: float | None = None) -> DataFrame:
    """df with tai_utc, tdb_utc_s (TDB less UTC in seconds), light_s and bjd_tdb, the barycentric Julian day of UTC
    instants (timestamps) for positions in degrees; null before 1972 and where a value is missing."""
    out = with_leaps(df, ts)
    utc = (F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0) - 946728000.0) / 86400.0  # since J2000.0 in UTC
    out = out.withColumn("_utc", utc).withColumn("_tt", F.col("_utc") + (F.col("tai_utc") + 32.184) / 86400.0)
    g = F.radians(F.lit(357.53) + F.col("_tt") * 0.98560028)
    out = out.withColumn("tdb_utc_s", F.col("tai_utc") + 32.184 + F.sin(g) * 0.001657 + F.sin(g * 2) * 0.000014)
    out = light_seconds(out, "_tt", ra, dec, longitude, latitude)
    return out.withColumn("bjd_tdb", F.lit(2451545.0) + F.col("_utc") + (F.col("tdb_utc_s") + F.col("light_s")) / 86400.0).drop("_utc", "_tt")


def sql(source: str, ts: str, ra: str, dec: str) -> str:
    """CTEs of the same for DuckDB, from a table expression, ending in bary; without a place on Earth."""
    leaps = ", ".join(f"(date '{d}', {s})" for d, s in LEAPS.items())
    steps = [
        f"leaps(since, s) as (values {leaps})",
        f"utc as (select q.*, leaps.s as tai_utc, (epoch_us({ts}) / 1e6::double - 946728000) / 86400 as u from ({source}) q asof left join leaps on q.{ts} >= leaps.since)",
        "tt as (select *, u + (tai_utc + 32.184::double) / 86400 as d, (u + (tai_utc + 32.184::double) / 86400) / 36525 as t from utc)",
    ]
    names = []
    for name, (base, change) in ORBITS.items():
        a, e, i, mean, peri, node = (f"({x!r}::double + t * {d!r}::double)" for x, d in zip(base, change, strict=True))
        steps += [
            f"{name}0 as (select *, radians((({mean} - {peri}) % 360 + 360) % 360) as m_, {e} as e_ from {names[-1] if names else 'tt'})",
            f"{name}1 as (select *, m_ + (2 * e_ - e_ ** 3 / 4) * sin(m_) + 1.25 * e_ ** 2 * sin(2 * m_) + 13 / 12.0::double * e_ ** 3 * sin(3 * m_) as v_ from {name}0)",
            f"{name}2 as (select *, {a} * (1 - e_ * e_) / (1 + e_ * cos(v_)) as r_, v_ + radians({peri} - {node}) as u_, radians({node}) as w_, radians({i}) as i_ from {name}1)",
            f"{name} as (select * exclude (m_, e_, v_, r_, u_, w_, i_), r_ * (cos(w_) * cos(u_) - sin(w_) * sin(u_) * cos(i_)) as {name}x, r_ * (sin(w_) * cos(u_) + cos(w_) * sin(u_) * cos(i_)) as {name}y, r_ * sin(u_) * sin(i_) as {name}z from {name}2)",
        ]
        names.append(name)
    deg = lambda base, rate: f"(({base}::double + t * {rate}::double) % 360)"
    off = lambda c: f"earth{c} - (" + " + ".join(f"{p}{c} / {m + 1!r}::double" for p, m in MASSES.items()) + f") - n{c} * {MOON_AU!r}::double"
    steps += [
        f"moon0 as (select *, radians({deg(218.316, 481267.881)} + 6.289 * sin(radians({deg(134.963, 477198.868)}))) as l_, radians(5.128 * sin(radians({deg(93.272, 483202.018)}))) as b_ from {names[-1]})",
        "moon as (select *, cos(l_) * cos(b_) as nx, sin(l_) * cos(b_) as ny, sin(b_) as nz from moon0)",
        f"ecl as (select *, {off('x')} as x, {off('y')} as y_, {off('z')} as z_ from moon)",
        f"equ as (select *, y_ * {math.cos(TILT)!r}::double - z_ * {math.sin(TILT)!r}::double as y, y_ * {math.sin(TILT)!r}::double + z_ * {math.cos(TILT)!r}::double as z, radians(357.53::double + d * 0.98560028::double) as g from ecl)",
        f"bary as (select *, tai_utc + 32.184::double + 0.001657::double * sin(g) + 0.000014::double * sin(2 * g) as tdb_utc_s, {AU_S!r}::double * (x * cos(radians({dec})) * cos(radians({ra})) + y * cos(radians({dec})) * sin(radians({ra})) + z * sin(radians({dec}))) as light_s from equ)",
    ]
    return ", ".join(steps)
