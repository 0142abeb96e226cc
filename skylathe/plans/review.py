"""Queries of selection, review and registration by the published rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import fits, match, photometry, pixels

from .driver_tables import CADENCE, DURATION, PHASED, PHOTOMETRY, phased, table
from .driver_tables import photometry as phot
from .fitting import WINDOW, _cells, _fit_sql
from .registered import register
from .tables import _SEP, PX, _plane_sql, _px

QUERIES, ORACLES, query = register()

r = lambda c, n=6: F.round(F.col(c), n).alias(c)


@query("""with s as (select c_nationkey, c_custkey, sqrt(((c_custkey * 53 % 997)::double - 500) * ((c_custkey * 53 % 997)::double - 500) + ((c_custkey * 71 % 991)::double - 480) * ((c_custkey * 71 % 991)::double - 480)) as d from customer)
select c_nationkey, c_custkey, round(d, 6) as distance from (select *, row_number() over (partition by c_nationkey order by d, c_custkey) as k from s where d > 5) q where k = 1""")
def nearest_other_source(spark, d):
    x, y = ((F.col("c_custkey") * a % m).cast("double") - c for a, m, c in ((53, 997, 500.0), (71, 991, 480.0)))
    out = match.nearest_other(table(spark, d, "customer"), ["c_nationkey"], x, y, ["c_custkey"], 5.0)
    return out.select("c_nationkey", "c_custkey", r("distance"))


@query(f"""with c as (select c_custkey, 150 + (c_custkey * 37 % 1009)::double / 500 as ra, 10 + (c_custkey * 91 % 1013)::double / 500 as dec from customer),
s as (select s_suppkey, 150 + (s_suppkey * 53 % 1009)::double / 500 as ra, 10 + (s_suppkey * 71 % 1013)::double / 500 as dec from supplier), p as (select c_custkey, {_SEP} as sep from c, s),
n as (select c_custkey, count(*) as matches, count(case when sep <= 120 then 1 end) as w, min(sep) as sep from p where sep <= 300 group by c_custkey)
select c.c_custkey as c_custkey, coalesce(matches, 0) as matches, coalesce(w, 0) as within_aperture, round(sep, 5) as separation from c left join n on c.c_custkey = n.c_custkey""")
def sky_neighbourhood(spark, d):
    """Matches in a cone, and how many of them an aperture holds."""
    at = lambda df, k, a, b: df.select(k, (F.lit(150) + (F.col(k) * a % 1009).cast("double") / 500).alias("ra"), (F.lit(10) + (F.col(k) * b % 1013).cast("double") / 500).alias("dec"))
    out = match.sky_matches(at(table(spark, d, "customer"), "c_custkey", 37, 91), at(table(spark, d, "supplier"), "s_suppkey", 53, 71), "c_custkey", ("ra", "dec"), ("ra", "dec"), "s_suppkey", 300.0, aperture=120.0)
    return out.select("c_custkey", "matches", "within_aperture", r("separation", 5))


@query(f"""with {PHOTOMETRY}, l as (select *, median(case when counts > 0 then counts end) over (partition by star) as l from phot),
f as (select frame, median(case when star <> 1 and counts > 0 then counts / l end) as tr, count(case when star <> 1 and counts > 0 then 1 end) as n, coalesce(bool_or(star = 1 and counts > 0), false) as t, max(case when star = 1 then airmass end) as b,
  coalesce(bool_or(star = 1 and frame % 11 > 0), false) as inside, max(case when star = 1 then fwhm end) * 100 as rms from l group by frame),
k as (select *, t and n >= 5 and tr is not null as ok from f), m as (select median(b) as m from k where ok), d as (select any_value(m) + 3 * greatest(1.4826::double * median(abs(b - m)), 0.0001::double) as lim from k, m where ok)
select frame, coalesce(ok and inside and rms < 4.2::double and tr > 0.8 and tr < 1.2 and b < lim, false) as good from k left join d on true""")
def steady_frames(spark, d):
    """The quality mask with its terms of place and of centroid scatter."""
    rows = phot(spark, d).withColumn("rms", F.col("fwhm") * 100)
    out = photometry.quality_frames(rows, 1, "airmass", least=5, low=0.8, high=1.2, sigmas=3.0, floor=0.0001, inside=F.col("frame") % 11 > 0, rms="rms", most_rms=4.2)
    return out.select("frame", "good")


@query(f"""with {PHOTOMETRY}, o as (select *, counts / nullif(sum(counts) over (partition by frame) - counts, 0) as o from phot), q as (select *, o / median(o) over (partition by star) as q0 from o), q2 as (select *, q0 / median(q0) over (partition by star) as q from q),
m as (select *, median(q) over (partition by star) as m from q2), s as (select *, 1.4826::double * median(abs(q - m)) over (partition by star) as s from m)
select star, round(stddev_pop(case when abs(q - m) <= 5 * s then q end), 8) as clipped_std, round(median(counts / nullif(error, 0)), 4) as snr from s group by star""")
def ensemble_deviation(spark, d):
    """Clipped deviation and signal over noise of each comparison star against the rest."""
    out = photometry.ensemble_review(phot(spark, d), {"by_airmass": "airmass"})
    return out.select("star", r("clipped_std", 8), r("snr", 4))


_ODD = f"select sector, abs(cycle) % 2 as odd, cycle, phase, flux, error from ph where abs(phase) <= {WINDOW}"


@query(f"""with {PHASED}, {_fit_sql("cycle", "sector, odd", _ODD, _cells([DURATION], [0.0]), least_group=4)}
select o.sector as sector, round(o.depth - e.depth, 6) as difference, round(sqrt(o.depth_error * o.depth_error + e.depth_error * e.depth_error), 6) as error from (select * from fit where odd = 1) o join (select * from fit where odd = 0) e on o.sector = e.sector""")
def odd_even_fits(spark, d):
    """Depths fitted to odd and even events apart, and their difference."""
    rows = phased(spark, d).filter(F.abs("phase") <= WINDOW).withColumn("odd", F.abs("cycle") % 2)
    each = fits.box_fits(rows, ["sector", "odd"], "cycle", "phase", "flux", "error", fits.grid(spark, [DURATION], [0.0]), CADENCE, least_group=4)
    pick = lambda c, n: F.max(F.when(F.col("odd") == n, F.col(c)))
    out = each.groupBy("sector").agg((pick("depth", 1) - pick("depth", 0)).alias("difference"), F.hypot(pick("depth_error", 1), pick("depth_error", 0)).alias("error"))
    return out.filter("difference is not null").select("sector", r("difference"), r("error"))


@query(f"""with raw as {PX.partition(" as ")[2]}, dk as (select y, x, median(value) as dark from raw where label = 0 group by y, x),
px as (select vec_id as label, raw.y as y, raw.x as x, value + 5 - dark as value from raw join dk on raw.y = dk.y and raw.x = dk.x where label = 1), {_plane_sql()},
pl as (select label, mz - sx * mu - sy * mv as level, sx, sy from l2), dv as (select px.*, level + sx * (2.0::double * x / 7 - 1) + sy * (2.0::double * y / 7 - 1) as p from px join pl on px.label = pl.label),
dw as (select *, min(p) over (partition by label) as least, avg(p) over (partition by label) as lv from dv), dx as (select label, y, x, value * lv / p as value from dw where least > 0),
dn as (select label, y, x, value, avg(value) over (partition by label) as m from dx), st as (select y, x, median(value / m) as value from dn where m > 0 group by y, x), me as (select avg(value) as m from st)
select y, x, round(case when value / m > 0 then value / m end, 6) as value from st, me""")
def flat_build(spark, d):
    """A flat field from the stamps of one label, dark taken from those of another."""
    px = _px(spark, d)
    dark = pixels.median_stack(px.filter("label = 0"), []).select("y", "x", "value")
    flats = px.filter("label = 1").select("vec_id", "y", "x", (F.col("value") + 5).alias("value"))
    return pixels.flat_field(flats, dark, "vec_id", 8, 8).select("y", "x", r("value"))


@query("""with p as (select n_nationkey as frame, c_custkey, (c_custkey * 37 % 1000) / 400.0::double + n_nationkey * 3 + case when c_custkey % 17 = 0 then 40 else 0 end as dx, (c_custkey * 91 % 1000) / 500.0::double - n_nationkey * 2 as dy from customer join nation on c_nationkey = n_nationkey),
m as (select *, median(dx) over w as mx, median(dy) over w as my from p window w as (partition by frame)), q as (select *, sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) as r from m), s as (select *, median(r) over (partition by frame) as mr from q),
t as (select *, 1.4826::double * median(abs(r - mr)) over (partition by frame) as s from s), k as (select * from t where r <= greatest(1.5, mr + 4 * s)), f as (select *, round_even(median(dx) over w, 0) as fx, round_even(median(dy) over w, 0) as fy from k window w as (partition by frame))
select frame, any_value(fx) as dx, any_value(fy) as dy, count(*) as stars, round(sqrt(avg((dx - fx) * (dx - fx) + (dy - fy) * (dy - fy))), 6) as rms from f group by frame""")
def shift_from_stars(spark, d):
    """Whole-pixel shifts of frames from their matched stars, outliers left out."""
    k, n = F.col("c_custkey"), F.col("frame")
    pairs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    dx, dy = (k * 37 % 1000) / F.lit(400.0) + n * 3 + F.when(k % 17 == 0, 40).otherwise(0), (k * 91 % 1000) / F.lit(500.0) - n * 2
    return match.star_shift(pairs.withColumnRenamed("c_nationkey", "frame"), ["frame"], dx, dy).select("frame", "dx", "dy", "stars", r("rms"))


@query()
def subpixel_shifts(spark, d):
    """How far each stamp lies off the first one, to half a pixel."""
    px = _px(spark, d).select("vec_id", "y", "x", "value")
    first = table(spark, d, "embeddings").agg(F.min("vec_id")).first()[0]
    return pixels.registered(px, "vec_id", first, 8, 8, bin_=1, smooth=2.0, upsample=2)


@query("""with c as (select o_orderkey, cast(o_orderdate as date) as day, 20 * 60 + o_orderkey % 60 as start, (24 * 60 + 200 + o_orderkey % 60) % 1440 as ingress, (24 * 60 + 300 + o_orderkey % 60) % 1440 as egress, 8 * 60 + o_orderkey % 50 as stop from orders),
z as (select o_orderkey, unnest(['America/New_York', 'UTC']) as zone, day, start, ingress, egress, stop from c),
t as (select o_orderkey, zone, epoch(timezone(zone, day + to_minutes(start)))::bigint as night_start, epoch(timezone(zone, day + to_minutes(ingress + case when ingress < start then 1440 else 0 end)))::bigint as ingress,
  epoch(timezone(zone, day + to_minutes(egress + case when egress < start then 1440 else 0 end)))::bigint as egress, epoch(timezone(zone, day + to_minutes(stop + case when stop < start then 1440 else 0 end)))::bigint as night_end from z)
select *, (ingress + egress) / 2.0::double as midpoint, egress - ingress as duration, night_start < ingress and ingress < egress and egress < night_end as in_order from t""")
def night_in_zones(spark, d):
    """A night's four clocks under two zones."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (20 * 60 + k % 60).alias("start"), ((24 * 60 + 200 + k % 60) % 1440).alias("ingress"), ((24 * 60 + 300 + k % 60) % 1440).alias("egress"), (8 * 60 + k % 50).alias("stop"))
    return X.interpreted(rows, "day", "start", "ingress", "egress", ["America/New_York", "UTC"], "stop")
