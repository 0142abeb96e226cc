"""Queries of times and places on the sky."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.functions import times

from .driver_tables import table
from .registered import register

QUERIES, ORACLES, query = register()

_INSTANTS = "select o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) as ts, o_custkey % 360::double as ra, o_custkey * 7 % 179 - 89.0::double as dec from orders"


@query(f"""with {times.sql(_INSTANTS, "ts", "ra", "dec")} select o_orderkey, tai_utc, round(tdb_utc_s, 6) as tdb_utc_s, round(light_s, 4) as light_s, round(2451545 + u + (tdb_utc_s + light_s) / 86400, 5) as bjd_tdb from bary""")
def barycentric_times(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))).alias("ts"), (F.col("o_custkey") % 360).cast("double").alias("ra"), (F.col("o_custkey") * 7 % 179 - 89).cast("double").alias("dec"))
    out = times.barycentric(rows, "ts", "ra", "dec")
    return out.select("o_orderkey", "tai_utc", F.round("tdb_utc_s", 6).alias("tdb_utc_s"), F.round("light_s", 4).alias("light_s"), F.round("bjd_tdb", 5).alias("bjd_tdb"))


#: A field with distortions of a pixel or two at its edges.
CENTRE, PIXEL, MATRIX = (150.0, 20.0), (2048.5, 2048.5), (-1.1e-4, 2e-6, 1.9e-6, 1.1e-4)
A, B = {(2, 0): 2.5e-7, (1, 1): -8e-8, (0, 2): 1.4e-7, (3, 0): 2e-11}, {(2, 0): -6e-8, (1, 1): 7e-8, (0, 2): -2.4e-7, (0, 3): -3e-11}


def _sip_sql(rounds: int = 10) -> str:
    poly = lambda u, v, terms: " + ".join(f"{c!r}::double" + f" * {u}" * p + f" * {v}" * q for (p, q), c in sorted(terms.items()))
    n = lambda x: f"{x!r}::double"
    a, b, c, e = MATRIX
    det = a * e - b * c
    steps = [
        "s as (select c_custkey, (c_custkey * 53 % 4096)::double as x, (c_custkey * 71 % 4093)::double as y, 150 + (c_custkey * 29 % 401 - 200) * 0.001::double as ra0, 20 + (c_custkey * 31 % 397 - 198) * 0.001::double as dec0 from customer)",
        f"f as (select *, x - {PIXEL[0]} as u, y - {PIXEL[1]} as v from s)",
        f"g as (select *, u + {poly('u', 'v', A)} as u2, v + {poly('u', 'v', B)} as v2 from f)",
        f"h as (select *, radians(u2 * {n(a)} + v2 * {n(b)}) as xi, radians(u2 * {n(c)} + v2 * {n(e)}) as eta from g)",
        f"k as (select *, cos(radians({CENTRE[1]})) - eta * sin(radians({CENTRE[1]})) as below from h)",
        f"w as (select *, (degrees(atan2(xi, below)) + {CENTRE[0]} + 360) % 360 as ra, degrees(atan2(sin(radians({CENTRE[1]})) + eta * cos(radians({CENTRE[1]})), sqrt(xi * xi + below * below))) as dec, radians(ra0 - {CENTRE[0]}) as da, radians(dec0) as dd from k)",
        f"t as (select *, sin(dd) * sin(radians({CENTRE[1]})) + cos(dd) * cos(radians({CENTRE[1]})) * cos(da) as towards from w)",
        f"q as (select *, degrees(cos(dd) * sin(da) / towards) as xp, degrees((sin(dd) * cos(radians({CENTRE[1]})) - cos(dd) * sin(radians({CENTRE[1]})) * cos(da)) / towards) as yp from t)",
        f"r0 as (select c_custkey, ra, dec, (xp * {n(e)} - yp * {n(b)}) / {n(det)} as iu, (yp * {n(a)} - xp * {n(c)}) / {n(det)} as iv, (xp * {n(e)} - yp * {n(b)}) / {n(det)} as u, (yp * {n(a)} - xp * {n(c)}) / {n(det)} as v from q)",
    ]
    steps += [f"r{i + 1} as (select c_custkey, ra, dec, iu, iv, iu - ({poly('u', 'v', A)}) as u, iv - ({poly('u', 'v', B)}) as v from r{i})" for i in range(rounds)]
    return f"with {', '.join(steps)} select c_custkey, round(ra, 8) as ra, round(dec, 8) as dec, round(u + {PIXEL[0]}, 5) as px, round(v + {PIXEL[1]}, 5) as py from r{rounds}"


@query(_sip_sql())
def distorted_sky(spark, d):
    """The sky of pixels and the pixels of sky positions in a field with distortions."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (k * 53 % 4096).cast("double").alias("x"), (k * 71 % 4093).cast("double").alias("y"), (F.lit(150) + (k * 29 % 401 - 200) * 0.001).alias("ra0"), (F.lit(20) + (k * 31 % 397 - 198) * 0.001).alias("dec0"))
    ra, dec = X.position_sip(F.col("x"), F.col("y"), CENTRE, PIXEL, MATRIX, A, B)
    px, py = X.pixel_sip(F.col("ra0"), F.col("dec0"), CENTRE, PIXEL, MATRIX, A, B)
    return rows.select("c_custkey", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"), F.round(px, 5).alias("px"), F.round(py, 5).alias("py"))
