"""Queries over light curves: masks, phases, bins, robust statistics and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import grids, stats, windows

from .driver_tables import CURVES, PERIOD, PHASED, T0, curves, phased
from .registered import register

QUERIES, ORACLES, query = register()


r = lambda c, n=6: F.round(F.col(c), n).alias(c)
MAD = "1.4826::double * median(d)"


@query(f"with {CURVES} select event_id, good from lcg")
def good_mask(spark, d):
    return curves(spark, d).select("event_id", "good")


@query(f"""with {PHASED} select event_id, round(phase, 6) as phase, cycle, round((((t - {T0}::double) / {PERIOD}::double) % 1 + 1) % 1, 6) as orbital from ph""")
def phase_cycle(spark, d):
    return phased(spark, d).select("event_id", r("phase"), "cycle", F.round(X.orbital_phase(F.col("t"), T0, PERIOD), 6).alias("orbital"))


@query(f"with {PHASED} select event_id, round(box, 6) as box from ph")
def box_fraction(spark, d):
    return phased(spark, d).select("event_id", r("box"))


@query(f"with {CURVES} select event_id, round(flux / median(flux) over (partition by series), 8) as normalized, round(error / median(flux) over (partition by series), 8) as error from lcg where good")
def normalized_curve(spark, d):
    rows = stats.normalized(curves(spark, d).filter("good"), ["series"], "flux")
    middle = stats.median(F.col("flux")).over(Window.partitionBy("series"))
    return rows.select("event_id", r("normalized", 8), F.round(F.try_divide(F.col("error"), middle), 8).alias("error"))


@query(f"""with {CURVES}, m as (select series, flux, abs(flux - median(flux) over (partition by series)) as d, median(flux) over (partition by series) as m from lcg where good)
select series, count(*) as n, round(any_value(m), 8) as median, round({MAD}, 8) as mad from m group by series""")
def mad_raw(spark, d):
    return stats.mad_raw(curves(spark, d).filter("good"), ["series"], F.col("flux")).select("series", "n", r("median", 8), r("mad", 8))


@query(f"""with {CURVES}, q as (select series, flux / median(flux) over (partition by series) as x from lcg where good),
m as (select series, abs(x - median(x) over (partition by series)) as d from q) select series, round({MAD}, 8) as mad from m group by series""")
def mad_normalized(spark, d):
    return stats.mad_normalized(curves(spark, d).filter("good"), ["series"], "flux").select("series", r("mad", 8))


@query(f"""with {CURVES}, q as (select series, flux / median(flux) over (partition by series) as x from lcg where good),
m as (select series, x, abs(x - median(x) over (partition by series)) as d from q), s as (select *, 1.4826::double * median(d) over (partition by series) as s from m)
select series, count(*) filter (where d <= 5 * s) as kept, round(stddev_pop(x) filter (where d <= 5 * s), 6) as std, round(stddev_pop(x), 6) as full_std from s group by series""")
def clipped_std(spark, d):
    return stats.clipped_std(curves(spark, d).filter("good"), ["series"], "flux").select("series", "kept", r("std"), r("full_std"))


_Z = f"""with {CURVES}, m as (select *, flux - median(flux) over (partition by series) as e, count(*) over (partition by series) as c from lcg where good),
s as (select *, 1.4826::double * median(abs(e)) over (partition by series) as s from m), z as (select event_id, k, error, case when c < 20 or s <= 0 then 0::double else e / s end as z from s)"""


@query(_Z + """ select event_id, round(z, 8) as z, concat_ws('; ', case when abs(z) > 6 then 'outlier' end, case when error > 1.7 then 'noisy' end, case when k < 5 then 'early' end) as reasons from z""")
def robust_z_flags(spark, d):
    rows = stats.robust_z(curves(spark, d).filter("good"), ["series"], "flux")
    why = X.joined_reasons(outlier=F.abs("z") > 6, noisy=F.col("error") > 1.7, early=F.col("k") < 5)
    return rows.select("event_id", r("z", 8), why.alias("reasons"))


@query(f"with {CURVES} select series, round(quantile_cont(flux, 0.16), 6) as low, round(quantile_cont(flux, 0.84), 6) as high, round(median(flux), 6) as middle, round(stddev_samp(flux), 6) as spread, round(avg(case when good then 1 else 0 end), 6) as share from lcg group by series")
def group_quantiles(spark, d):
    f = F.col("flux")
    out = curves(spark, d).groupBy("series").agg(F.percentile(f, 0.16).alias("low"), F.percentile(f, 0.84).alias("high"), stats.median(f).alias("middle"), F.stddev_samp(f).alias("spread"), F.avg(F.col("good").cast("int")).alias("share"))
    return out.select("series", r("low"), r("high"), r("middle"), r("spread"), r("share"))


@query(f"with {CURVES} select sector, quality, count(*) as n from lcg group by sector, quality")
def value_counts(spark, d):
    return curves(spark, d).groupBy("sector", "quality").agg(F.count("*").alias("n"))


@query(f"""with {PHASED}, m as (select series, flux, box > 0.5 as i, median(flux) over (partition by series, box > 0.5) as m from ph), v as (select series, i, count(*) as n, any_value(m) as m, 1.4826::double * median(abs(flux - m)) as s from m group by series, i),
p as (select series, coalesce(max(case when i then n end), 0) as n_in, coalesce(max(case when not i then n end), 0) as n_out, max(case when i then m end) as mi, max(case when not i then m end) as mo, max(case when i then s end) as si, max(case when not i then s end) as so from v group by series)
select series, n_in, n_out, case when n_in >= 5 and n_out >= 20 then round(mo - mi, 8) end as depth, case when n_in >= 5 and n_out >= 20 then round(sqrt(si * si / nullif(n_in, 0) + so * so / nullif(n_out, 0)), 8) end as error from p""")
def conditional_depth(spark, d):
    return stats.conditional_depth(phased(spark, d), ["series"], "flux", F.col("box") > 0.5, least_in=5).select("series", "n_in", "n_out", r("depth", 8), r("error", 8))


_BIN = f"""b0 as (select series, cast(floor((t - 19723::double) / 0.5::double) as bigint) as bin, t, flux from ph),
b1 as (select *, median(flux) over (partition by series, bin) as m from b0)"""


@query(f"with {PHASED}, {_BIN} select series, bin, round(median(t), 8) as x, round(any_value(m), 8) as y, round(1.4826::double * median(abs(flux - m)) / sqrt(count(*)), 8) as error, count(*) as n from b1 group by series, bin")
def time_bins(spark, d):
    out = grids.binned(phased(spark, d), ["series"], F.floor((F.col("t") - 19723.0) / 0.5), F.col("t"), F.col("flux"))
    return out.select("series", "bin", r("x", 8), r("y", 8), r("error", 8), "n")


@query(f"""with {PHASED}, b0 as (select sector, cast(floor((phase + 0.8::double) / 0.1::double) as bigint) as bin, phase, flux, error from ph where abs(phase) <= 0.8::double), b1 as (select *, median(flux) over (partition by sector, bin) as m from b0)
select sector, bin, round(median(phase), 8) as x, round(any_value(m), 8) as y, round(case when count(*) = 1 then median(error) else 1.4826::double * median(abs(flux - m)) / sqrt(count(*)) end, 8) as error, count(*) as n from b1 group by sector, bin""")
def phase_bins(spark, d):
    rows = phased(spark, d).filter(F.abs("phase") <= 0.8).withColumn("b", F.floor((F.col("phase") + 0.8) / 0.1))
    out = grids.binned(rows, ["sector"], F.col("b"), F.col("phase"), F.col("flux"))
    single = rows.groupBy("sector", F.col("b").alias("bin")).agg(stats.median(F.col("error")).alias("e"))
    return out.join(single, ["sector", "bin"]).select("sector", "bin", r("x", 8), r("y", 8), F.round(F.when(F.col("n") == 1, F.col("e")).otherwise(F.col("error")), 8).alias("error"), "n")


@query(f"""with {PHASED}, single as (select series, 1.4826::double * median(abs(flux - m)) as s from (select series, flux, median(flux) over (partition by series) as m from ph) group by series),
b as (select series, width, cast(floor((t - f) / width) as bigint) as bin, avg(flux) as m, count(*) as p from (select *, min(t) over (partition by series) as f from ph), (select unnest([1.0::double, 2.0, 3.0, 5.0]) as width) group by all having count(*) >= 2),
q as (select *, median(m) over (partition by series, width) as mm from b)
select q.series as series, width, count(*) as bins, round(median(p), 6) as points, round(1.4826::double * median(abs(m - mm)), 10) as measured, round(any_value(s) / sqrt(median(p)), 10) as white, round(1.4826::double * median(abs(m - mm)) / (any_value(s) / sqrt(median(p))), 8) as beta
from q join single on q.series = single.series group by q.series, width having count(*) >= 3""")
def noise_vs_bin(spark, d):
    out = grids.noise_by_bin(phased(spark, d), ["series"], "t", "flux", [1.0, 2.0, 3.0, 5.0])
    return out.select("series", "width", "bins", r("points"), r("measured", 10), r("white", 10), r("beta", 8))


@query(f"with {CURVES} select event_id, case when count(flux) over w >= 5 then round(quantile_cont(flux, 0.5) over w, 6) end as moving from lcg where good window w as (partition by series order by us range between 86400000000 preceding and 86400000000 following)")
def moving_median_range(spark, d):
    return windows.moving_median(curves(spark, d).filter("good"), ["series"], "us", "flux", 172_800_000_000).select("event_id", r("moving"))


@query(f"""with {CURVES}, m as (select *, case when count(flux) over w >= 4 then quantile_cont(flux, 0.5) over w end as rolling from lcg where good window w as (partition by series order by us, event_id rows between 4 preceding and 4 following)),
q as (select *, flux - rolling as r from m), s as (select *, median(r) over (partition by series) as mr from q), v as (select *, 1.4826::double * median(abs(r - mr)) over (partition by series) as s from s)
select event_id, round(rolling, 6) as rolling, coalesce(abs(r) > greatest(6 * s, 0.025::double), false) as outlier from v""")
def rolling9_median(spark, d):
    return windows.isolated_outliers(curves(spark, d).filter("good"), ["series"], ["us", "event_id"], "flux").select("event_id", r("rolling"), "outlier")


@query(f"""with {CURVES}, g as (select *, case when t - lag(t) over (partition by series order by t, event_id) > 0.5 then 1 else 0 end as g from lcg where good)
select event_id, cast(sum(g) over (partition by series order by t, event_id rows unbounded preceding) as bigint) as section from g""")
def gap_sections(spark, d):
    return windows.sections(curves(spark, d).filter("good"), ["series"], "t", 0.5, "event_id").select("event_id", "section")


@query(f"""with {CURVES}, s as (select series, us - lag(us) over (partition by series order by event_id) as s, flux - lag(flux) over (partition by series order by event_id) as f from lcg)
select series, count(*) as n, coalesce(bool_and(s > 0), true) as times_rise, coalesce(bool_and(f > 0), true) as flux_rises from s group by series""")
def monotonic_check(spark, d):
    a = windows.strictly_rising(curves(spark, d), ["series"], "us", "event_id").withColumnRenamed("rising", "times_rise")
    b = windows.strictly_rising(curves(spark, d), ["series"], "flux", "event_id").select("series", F.col("rising").alias("flux_rises"))
    return a.join(b, "series")


@query(f"with {CURVES} select event_id, cast(ntile(8) over (partition by series order by us, event_id) as int) as fold from lcg where good")
def fold_ids(spark, d):
    return windows.folds(curves(spark, d).filter("good"), ["series"], ["us", "event_id"]).select("event_id", "fold")


@query(f"""with {CURVES}, c as (select series, flux, cast(floor((row_number() over (partition by series order by us, event_id) - 1) / 5) as bigint) as chunk from lcg where good)
select series, chunk, count(flux) as n, round(median(flux), 6) as value from c group by series, chunk having count(flux) >= 3""")
def chunk_medians(spark, d):
    return windows.chunks(curves(spark, d).filter("good"), ["series"], ["us", "event_id"], "flux").select("series", "chunk", "n", r("value"))


@query(f"""with {CURVES} select series, round(max(case when t < 19733 then t end), 8) as before, round(min(case when t > 19734 then t end), 8) as after, count(*) filter (where t between 19733 and 19734) as inside from lcg where good group by series""")
def asof_gap(spark, d):
    return windows.gap_check(curves(spark, d).filter("good"), ["series"], "t", F.lit(19733.0), F.lit(19734.0)).select("series", r("before", 8), r("after", 8), "inside")


@query(f"""with {CURVES}, m as (select *, min(error) over (partition by series) as e from lcg), f as (select *, min(case when error = e then event_id end) over (partition by series) as least_at from m)
select event_id, case when event_id > least_at then 1 else 0 end as meridian from f""")
def meridian_step(spark, d):
    return windows.meridian_side(curves(spark, d), ["series"], "event_id", "error").select("event_id", "meridian")


@query(f"""with {CURVES} select event_id, case when k = 53 then 'reviewed' when error > 1.7 and abs(flux - 50) >= 30 then 'elongated' when error > 1.7 then 'broad' when flux < 10 then 'faint' else 'kept' end as decision from lcg""")
def decision_table(spark, d):
    f, e = F.col("flux"), F.col("error")
    rule = F.when(F.col("k") == 53, "reviewed").when((e > 1.7) & (F.abs(f - 50) >= 30), "elongated").when(e > 1.7, "broad").when(f < 10, "faint").otherwise("kept")
    return curves(spark, d).select("event_id", rule.alias("decision"))


@query(f"""with {PHASED}, cyc as (select sector, min(cycle) as a, max(cycle) as b from ph group by sector), e as (select sector, unnest(range(a - 1, b + 2)) as cycle from cyc),
p as (select *, {T0}::double + cycle * {PERIOD}::double as predicted from e)
select p.sector as sector, p.cycle as cycle, round(predicted, 6) as predicted, count(ph.t) as points from p left join ph on ph.sector = p.sector and abs(ph.t - predicted) <= 0.2 group by p.sector, p.cycle, predicted""")
def event_windows(spark, d):
    ph = phased(spark, d)
    every = ph.groupBy("sector").agg(F.min("cycle").alias("a"), F.max("cycle").alias("b")).select("sector", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("cycle"))
    # a point lies in the window of its nearest event only, so the interval join is an equi-join on cycle
    near = ph.filter(F.abs(F.col("t") - (F.col("cycle") * PERIOD + T0)) <= 0.2).groupBy("sector", "cycle").agg(F.count("*").alias("p"))
    return every.join(near, ["sector", "cycle"], "left").select("sector", "cycle", F.round(F.col("cycle") * PERIOD + T0, 6).alias("predicted"), F.coalesce("p", F.lit(0)).alias("points"))


@query(f"""with {PHASED}, s as (select series, cast(floor(((cycle % 2) + 2) % 2) as bigint) as odd, count(*) as n, sum(case when box > 0.5 then flux end) / count(case when box > 0.5 then 1 end) as i, count(case when box > 0.5 then 1 end) as ni, avg(case when box <= 0.5 then flux end) as o, stddev_pop(flux) as s from ph group by series, odd),
p as (select series, max(case when odd = 1 then o - i end) as d1, max(case when odd = 0 then o - i end) as d0, max(case when odd = 1 and ni > 0 then s / sqrt(ni) end) as e1, max(case when odd = 0 and ni > 0 then s / sqrt(ni) end) as e0 from s group by series)
select series, round(d1 - d0, 6) as difference, round(sqrt(e1 * e1 + e0 * e0), 6) as error from p where d1 is not null and d0 is not null""")
def odd_even(spark, d):
    i, o = F.when(F.col("box") > 0.5, F.col("flux")), F.when(F.col("box") <= 0.5, F.col("flux"))
    side = phased(spark, d).groupBy("series", F.pmod("cycle", F.lit(2)).alias("odd")).agg((F.avg(o) - F.avg(i)).alias("d"), F.try_divide(F.stddev_pop("flux"), F.nullif(F.sqrt(F.count(i)), F.lit(0.0))).alias("e"))
    pick = lambda c, n: F.max(F.when(F.col("odd") == n, F.col(c)))
    out = side.groupBy("series").agg((pick("d", 1) - pick("d", 0)).alias("difference"), F.sqrt(pick("e", 1) * pick("e", 1) + pick("e", 0) * pick("e", 0)).alias("error"))
    return out.filter("difference is not null").select("series", r("difference"), r("error"))

