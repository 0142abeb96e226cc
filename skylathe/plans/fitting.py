"""Queries of fits and trial grids over light curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import fits, grids, selection

from .driver_tables import CADENCE, CURVES, DURATION, PERIOD, PHASED, T0, curves, phased
from .registered import register

QUERIES, ORACLES, query = register()
#: Trial boxes: durations and offsets of a grid, and finer offsets of a single event.
DURATIONS = [0.3 + 0.5 * i / 30 for i in range(31)]
OFFSETS = [-0.4 + 0.8 * i / 70 for i in range(71)]
FINE = [-0.4 + 0.8 * i / 280 for i in range(281)]
WINDOW = 1.2


r = lambda c, n=6: F.round(F.col(c), n).alias(c)


def _fit_sql(group: str, by: str, source: str, cells: str, least: int = 10, least_group: int = 1, least_in: int = 1, floor: bool = True, x: str = "phase") -> str:
    """CTEs ending in fit: box fits by sums within groups, every point against every cell that it overlaps."""
    own = f"{by}, {group}" if group else by
    scale = "greatest(1, chi2 / greatest(1, n - 2 * g - 1))" if floor else "chi2 / greatest(1, n - 2 * g - 1)"
    return f"""
pts as (select *, 1 / (error * error) as w, count(*) over (partition by {own}) as m from ({source}) q),
cells as ({cells}),
uv as (select *, {x} - sum(w * {x}) over o / sum(w) over o as u, flux - sum(w * flux) over o / sum(w) over o as v from pts where m >= {least_group} window o as (partition by {own})),
ln as (select {own}, count(*) as n, sum(w) as sw, sum(w * u * u) as xx, sum(w * u * v) as xy, sum(w * v * v) as yy from uv group by {own}),
pc as (select uv.*, cell, duration, off, greatest(0, least(1, (least({x} - off + {CADENCE / 2}::double, duration / 2) - greatest({x} - off - {CADENCE / 2}::double, -duration / 2)) / {CADENCE}::double)) as b
  from uv join cells on {x} < off + (duration + {CADENCE}::double) / 2 and {x} > off - (duration + {CADENCE}::double) / 2),
hb as (select {own}, cell, duration, off, count(*) as ni, sum(w * b) as sb, sum(w * b * b) as sbb, sum(w * u * b) as xb, sum(w * v * b) as yb from pc where b > 0 group by {own}, cell, duration, off),
bs as (select {by}, cell, duration, off, sum(ni)::bigint as n_in, sum(yb - coalesce(xy / nullif(xx, 0), 0) * xb) as a, sum(sbb - sb * sb / sw - coalesce(xb * xb / nullif(xx, 0), 0)) as bb from hb join ln using ({own}) group by {by}, cell, duration, off),
al as (select {by}, sum(n)::bigint as n, count(*) as g, sum(yy - coalesce(xy * xy / nullif(xx, 0), 0)) as c from ln group by {by}),
f0 as (select *, -a / bb as depth, a * a / bb as gain, c - a * a / bb as chi2 from bs join al using ({by}) where n >= {least} and n_in >= {least_in} and bb > 1e-9),
fit as (select *, chi2 / greatest(1, n - 2 * g - 1) as reduced, sqrt({scale} / bb) as depth_error from f0)"""


def _cells(durations, offsets) -> str:
    rows = ", ".join(f"({i}, {d}::double, {o}::double)" for i, (d, o) in enumerate((d, o) for d in durations for o in offsets))
    return f"select * from (values {rows}) as t(cell, duration, off)"


_NEAR = f"select series, sector, cycle, phase, t, flux, error from ph where abs(phase) <= {WINDOW}"


@query(f"with {PHASED}, {_fit_sql('cycle', 'sector', _NEAR, _cells([DURATION], [0.0]), least_group=4)} select sector, round(depth, 6) as depth, round(depth_error, 6) as depth_error, round(chi2, 4) as chi2, n, n_in from fit")
def repeating_box_fit(spark, d):
    rows = phased(spark, d).filter(F.abs("phase") <= WINDOW)
    out = fits.box_fits(rows, ["sector"], "cycle", "phase", "flux", "error", fits.grid(spark, [DURATION], [0.0]), CADENCE, least_group=4)
    return out.select("sector", r("depth"), r("depth_error"), r("chi2", 4), "n", "n_in")


@query(f"""with {PHASED}, {_fit_sql('cycle', 'sector', _NEAR, _cells(DURATIONS, OFFSETS), least_group=4)},
best as (select * from (select *, row_number() over (partition by sector order by round(gain, 6) desc, cell) as k from fit) q where k = 1),
near as (select fit.sector as sector, min(fit.duration) as duration_low, max(fit.duration) as duration_high, min(fit.off) as offset_low, max(fit.off) as offset_high from fit join best on fit.sector = best.sector where (best.gain - fit.gain) / greatest(1, best.reduced) <= 2.3 group by fit.sector)
select best.sector as sector, duration, off as offset_days, round(depth, 6) as depth, round(depth_error, 6) as depth_error, duration_low, duration_high, offset_low, offset_high from best join near on best.sector = near.sector""")
def grid_box_fit(spark, d):
    rows = phased(spark, d).filter(F.abs("phase") <= WINDOW)
    out = fits.best_boxes(fits.box_fits(rows, ["sector"], "cycle", "phase", "flux", "error", fits.grid(spark, DURATIONS, OFFSETS), CADENCE, least_group=4), ["sector"])
    return out.select("sector", "duration", F.col("offset").alias("offset_days"), r("depth"), r("depth_error"), "duration_low", "duration_high", "offset_low", "offset_high")


@query(f"""with {PHASED}, {_fit_sql('', 'sector, cycle', _NEAR, _cells([DURATION], FINE), least=6, least_in=3)},
best as (select * from (select *, row_number() over (partition by sector, cycle order by round(gain, 6) desc, cell) as k from fit) q where k = 1),
near as (select fit.sector as sector, fit.cycle as cycle, min(fit.off) as lo, max(fit.off) as hi from fit join best on fit.sector = best.sector and fit.cycle = best.cycle where (best.gain - fit.gain) / greatest(1, best.reduced) <= 1 group by fit.sector, fit.cycle)
select best.sector as sector, best.cycle as cycle, round({T0}::double + best.cycle * {PERIOD}::double + off, 6) as time, case when hi > lo then round((hi - lo) / 2, 6) else 0.2 end as time_error, round(depth, 6) as depth, round(depth_error, 6) as depth_error,
  full_window and abs(depth) / depth_error >= 2.5 and case when hi > lo then (hi - lo) / 2 else 0.2 end <= 0.25 as used, full_window from best join near on best.sector = near.sector and best.cycle = near.cycle
  join (select sector, cycle, min(phase) <= {-0.75 * WINDOW}::double and max(phase) >= {0.75 * WINDOW}::double as full_window from ({_NEAR}) z group by sector, cycle) w on best.sector = w.sector and best.cycle = w.cycle""")
def event_times(spark, d):
    rows = phased(spark, d).filter(F.abs("phase") <= WINDOW)
    all_ = fits.box_fits(rows, ["sector", "cycle"], None, "phase", "flux", "error", fits.grid(spark, [DURATION], FINE), CADENCE, least=6, least_in=3)
    out = fits.best_boxes(all_, ["sector", "cycle"], region=1.0)
    half = F.when(F.col("offset_high") > F.col("offset_low"), (F.col("offset_high") - F.col("offset_low")) / 2).otherwise(0.2)
    reach = rows.groupBy("sector", "cycle").agg(((F.min("phase") <= -0.75 * WINDOW) & (F.max("phase") >= 0.75 * WINDOW)).alias("full_window"))
    out = out.join(reach, ["sector", "cycle"])
    used = F.col("full_window") & (F.abs("depth") / F.col("depth_error") >= 2.5) & (half <= 0.25)
    return out.select("sector", "cycle", F.round(F.col("cycle") * PERIOD + T0 + F.col("offset"), 6).alias("time"), F.round(half, 6).alias("time_error"), r("depth"), r("depth_error"), used.alias("used"), "full_window")


@query(f"""with {PHASED}, {_fit_sql('', 'series', 'select series, t - 19738.0::double as x, flux, error from ph', _cells([4.0], [0.0]), least_in=3, floor=False, x='x')} select series, round(depth, 6) as depth, round(depth_error, 6) as depth_error, round(reduced, 6) as reduced, n, n_in from fit""")
def linear_box_fit(spark, d):
    rows = phased(spark, d).withColumn("x", F.col("t") - 19738.0)
    out = fits.box_fits(rows, ["series"], None, "x", "flux", "error", fits.grid(spark, [4.0], [0.0]), CADENCE, least_in=3, floor=False)
    return out.select("series", r("depth"), r("depth_error"), r("reduced"), "n", "n_in")


_TRIALS = [(i, m, q) for i, (m, q) in enumerate((m, q) for m in [19731.5 + i for i in range(13)] for q in [0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6])]
_TRIAL_SQL = "select * from (values " + ", ".join(f"({i}, {m}::double, {q}::double)" for i, m, q in _TRIALS) + ") as t(trial, middle, q)"
_IN = f"greatest(0, least(1, (least(t - middle + {CADENCE / 2}::double, 2.0::double) - greatest(t - middle - {CADENCE / 2}::double, -2.0::double)) / {CADENCE}::double))"


@query(f"""with {PHASED}, tr as ({_TRIAL_SQL}), {_fit_sql('', 'sector, trial, q', f'select sector, trial, q, t - middle as x, flux / 50 * (1 - q * {_IN}) as flux, error / 50 as error from ph, tr', _cells([4.0], [0.0]), least_in=3, floor=False, x='x')}
select q, count(*) as trials, round(median(depth), 6) as median_depth, round(stddev_samp(depth), 6) as spread, round(avg(case when depth > 3 * depth_error then 1.0::double else 0 end), 6) as recovered from fit group by q""")
def injection_recovery(spark, d):
    trials = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(m).alias("middle"), F.lit(q).alias("q")) for i, m, q in _TRIALS])
    rows = phased(spark, d).select("*", F.inline(trials)).withColumn("x", F.col("t") - F.col("middle"))
    rows = rows.withColumn("flux", F.col("flux") / 50 * (1 - F.col("q") * X.box_fraction(F.col("x"), 4.0, CADENCE))).withColumn("error", F.col("error") / 50)
    out = fits.box_fits(rows, ["sector", "trial", "q"], None, "x", "flux", "error", fits.grid(spark, [4.0], [0.0]), CADENCE, least_in=3, floor=False)
    out = out.groupBy("q").agg(F.count("*").alias("trials"), F.median("depth").alias("median_depth"), F.stddev_samp("depth").alias("spread"), F.avg((F.col("depth") > 3 * F.col("depth_error")).cast("double")).alias("recovered"))
    return out.select("q", "trials", r("median_depth"), r("spread"), r("recovered"))


_LINE = f"""ev as (select sector, cycle as e, avg(t) as t, 0.01::double + 0.001::double * count(*) as s from ph group by sector, cycle),
m as (select sector, 1 / (s * s) as w, e::double as e, t, sum(e / (s * s)) over v / sum(1 / (s * s)) over v as em, sum(t / (s * s)) over v / sum(1 / (s * s)) over v as tm from ev window v as (partition by sector)),
s as (select sector, count(*) as n, sum(w) as sw, any_value(em) as em, any_value(tm) as tm, sum(w * (e - em) * (e - em)) as uu, sum(w * (e - em) * (t - tm)) as uv, sum(w * (t - tm) * (t - tm)) as vv from m group by sector having count(*) >= 3),
l as (select *, round_even(em, 0) as reference, uv / uu as period, vv - uv * uv / uu as chi2, greatest(1, (vv - uv * uv / uu) / greatest(1, n - 2)) as sc from s),
line as (select sector, reference, tm + period * (reference - em) as t0, period, sc / sw + (reference - em) * (reference - em) * sc / uu as var_t0, sc / uu as var_period, (reference - em) * sc / uu as cov, chi2, n from l)"""


def _lines(spark, d):
    ev = phased(spark, d).groupBy("sector", F.col("cycle").alias("e")).agg(F.avg("t").alias("t"), (F.lit(0.01) + F.lit(0.001) * F.count("*")).alias("s"))
    return fits.weighted_line(ev, ["sector"], "e", "t", "s")


@query(f"with {PHASED}, {_LINE} select sector, reference, round(t0, 6) as t0, round(period, 6) as period, round(sqrt(var_t0), 6) as t0_error, round(sqrt(var_period), 6) as period_error, n from line")
def weighted_line(spark, d):
    return _lines(spark, d).select("sector", "reference", r("t0"), r("period"), F.round(F.sqrt("var_t0"), 6).alias("t0_error"), F.round(F.sqrt("var_period"), 6).alias("period_error"), "n")


@query(f"with {PHASED}, {_LINE} select sector, round(t0 + (20 - reference) * period, 6) as time, round(sqrt(var_t0 + (20 - reference) * (20 - reference) * var_period + 2 * (20 - reference) * cov), 6) as time_error from line")
def prediction_error(spark, d):
    return fits.predicted(_lines(spark, d), F.lit(20)).select("sector", r("time"), r("time_error"))


_QUAD = """v as (partition by {k}), u as (select *, t - avg(t) over v as u from src window {v}), q as (select *, u * u as q from u), o as (select *, q - avg(q) over v - u * (sum(q * u) over v / nullif(sum(q) over v, 0)) as o from q window {v}),
b as (select *, case when count(*) over v >= 20 then avg(flux) over v + u * (sum(u * flux) over v / nullif(sum(u * u) over v, 0)) + o * (sum(o * flux) over v / nullif(sum(o * o) over v, 0)) end as baseline from o window {v})"""


def _quad(key: str) -> str:
    v = f"v as (partition by {key})"
    return _QUAD.replace("v as (partition by {k}), ", "").replace("{v}", v)


@query(f"""with {PHASED}, g as (select *, case when t - lag(t) over (partition by series order by t, event_id) > 1.5 then 1 else 0 end as g from ph where abs(phase) > {1.5 * DURATION / 2}::double),
src as (select *, cast(sum(g) over (partition by series order by t, event_id rows unbounded preceding) as bigint) as section from g), {_quad('series, section')} select event_id, section, round(flux / baseline, 6) as flat from b where baseline is not null""")
def segment_detrend(spark, d):
    from skylathe.operators.windows import sections

    rows = sections(phased(spark, d).filter(F.abs("phase") > 1.5 * DURATION / 2), ["series"], "t", 1.5, "event_id")
    out = fits.quadratic_baseline(rows, ["series", "section"], "t", "flux").filter("baseline is not null")
    return out.select("event_id", "section", F.round(F.try_divide("flux", "baseline"), 6).alias("flat"))


_USED = "abs(phase) >= 0.35"


@query(f"""with {PHASED}, src as (select *, {_USED} as used from ph where abs(phase) <= 1.3), u as (select *, t - avg(t) filter (where used) over v as u from src window v as (partition by sector, cycle)), q as (select *, u * u as q from u),
o as (select *, q - avg(q) filter (where used) over v - u * (sum(q * u) filter (where used) over v / nullif(sum(q) filter (where used) over v, 0)) as o from q window v as (partition by sector, cycle)),
b as (select *, flux / (avg(flux) filter (where used) over v + u * (sum(u * flux) filter (where used) over v / nullif(sum(u * u) filter (where used) over v, 0)) + o * (sum(o * flux) filter (where used) over v / nullif(sum(o * o) filter (where used) over v, 0))) as flat, count(*) filter (where used) over v as m from o window v as (partition by sector, cycle))
select sector, cycle, count(case when used then 1 end) as n, round((1 - median(case when abs(phase) <= {DURATION / 2}::double then flat end)) * 1e6::double, 4) as depth_ppm, round(stddev_pop(case when used then flat end) * 1e6::double, 4) as scatter_ppm from b where m >= 20 group by sector, cycle""")
def local_quadratic(spark, d):
    used = F.abs("phase") >= 0.35
    rows = phased(spark, d).filter(F.abs("phase") <= 1.3)
    out = fits.local_depth(rows, ["sector", "cycle"], "t", "flux", used, F.abs("phase") <= DURATION / 2)
    return out.select("sector", "cycle", "n", r("depth_ppm", 4), r("scatter_ppm", 4))


_PERIODS = [1.5 + 0.15 * i for i in range(20)]
_WIDE = [0.15, 0.3, 0.6]
_LIST = lambda xs: "[" + ", ".join(f"{x!r}::double" for x in xs) + "]"
_BLS = f"""src as (select sector, t - 19723::double as x, flux, 1 / (error * error) as w from lcg where good), pr as (select unnest({_LIST(_PERIODS)}) as period),
bn as (select sector, period, cast(floor((((x / period) % 1 + 1) % 1) * 60) as int) as bin, sum(w) as w, sum(w * flux) as wy from src, pr group by all), al as (select sector, period, sum(w) as sw, sum(wy) as swy from bn group by sector, period),
sp as (select bn.*, duration, unnest(range(0, greatest(1, cast(round_even(duration / period * 60, 0) as int)))) as j from bn, (select unnest({_LIST(_WIDE)}) as duration)),
bx as (select sector, period, duration, cast(((bin - j) % 60 + 60) % 60 as int) as start, sum(w) as w, sum(wy) as wy from sp group by all),
dp as (select bx.sector as sector, bx.period as period, duration, start, (swy - wy) / (sw - w) - wy / w as depth, ((swy - wy) / (sw - w) - wy / w) / sqrt(1 / w + 1 / (sw - w)) as snr from bx join al on bx.sector = al.sector and bx.period = al.period where sw - w > 1e-9),
bls as (select * from (select *, row_number() over (partition by sector, period order by round(snr, 9) desc, duration, start) as k from dp) q where k = 1)"""


def _bls(spark, d):
    rows = curves(spark, d).filter("good").withColumn("x", F.col("t") - 19723.0)
    return grids.box_periods(rows, ["sector"], "x", "flux", "error", _PERIODS, _WIDE)




@query(f"with {CURVES}, {_BLS} select sector, round(period, 6) as period, duration, start, round(depth, 6) as depth, round(snr, 6) as snr from bls")
def bls_grid(spark, d):
    return _bls(spark, d).select("sector", r("period"), "duration", "start", r("depth"), r("snr"))


@query(f"""with recursive {CURVES}, {_BLS}, b as (select sector, period, snr, row_number() over (partition by sector order by round(snr, 9) desc, period) as k from bls),
pk as (select sector, k, period, snr, [period] as kept, true as taken from b where k = 1 union all
  select b.sector, b.k, b.period, b.snr, case when len(pk.kept) < 5 and len(list_filter(pk.kept, lambda x: abs(x - b.period) < 0.35)) = 0 then list_append(pk.kept, b.period) else pk.kept end,
  len(pk.kept) < 5 and len(list_filter(pk.kept, lambda x: abs(x - b.period) < 0.35)) = 0 from pk join b on b.sector = pk.sector and b.k = pk.k + 1)
select sector, cast(row_number() over (partition by sector order by k) as int) as rank, round(period, 6) as period, round(snr, 6) as snr from pk where taken""")
def peak_nms(spark, d):
    return selection.peaks(_bls(spark, d), ["sector"], "period", "snr", 0.35, 5).select("sector", "rank", r("period"), r("snr"))


_FREQ = [0.1 + 0.07 * i for i in range(25)]
_LS = f"""src as (select sector, t - 19723::double as x, flux as y, 1 / (error * error) as w from lcg where good), f as (select unnest({_LIST(_FREQ)}) as frequency),
an as (select *, cos((((x * frequency) % 1 + 1) % 1) * 6.283185307179586::double) as c, sin((((x * frequency) % 1 + 1) % 1) * 6.283185307179586::double) as s from src, f),
sm as (select sector, frequency, sum(w) as sw, sum(w * y) as y1, sum(w * c) as c1, sum(w * s) as s1, sum(w * y * y) as yy, sum(w * y * c) as yc, sum(w * y * s) as ys, sum(w * c * c) as cc, sum(w * c * s) as cs, sum(w * s * s) as ss from an group by sector, frequency),
ab as (select sector, frequency, yy / sw - y1 / sw * (y1 / sw) as yy, yc / sw - y1 / sw * (c1 / sw) as yc, ys / sw - y1 / sw * (s1 / sw) as ys, cc / sw - c1 / sw * (c1 / sw) as cc, cs / sw - c1 / sw * (s1 / sw) as cs, ss / sw - s1 / sw * (s1 / sw) as ss from sm),
ls as (select sector, frequency, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) as power from ab)"""


@query(f"with {CURVES}, {_LS} select sector, round(frequency, 6) as frequency, round(power, 6) as power, round(least(1, 1 - (1 - pow(1 - power, 498.5::double)) * exp(-(2 * 30 * pow(1 - power, 498::double) * sqrt(499.5::double * power)))), 6) as chance from ls")
def lomb_scargle_grid(spark, d):
    rows = curves(spark, d).filter("good").withColumn("x", F.col("t") - 19723.0)
    out = grids.periodogram(rows, ["sector"], "x", "flux", "error", _FREQ)
    return out.select("sector", r("frequency"), r("power"), F.round(grids.false_alarm(F.col("power"), 1000, 2.0, 30.0), 6).alias("chance"))


@query(f"with {CURVES}, {_BLS} select sector, round(any_value(p), 6) as nearest, round(100 * (any_value(bp) - {PERIOD}::double) / {PERIOD}::double, 6) as percent from (select sector, first_value(period) over (partition by sector order by abs(period - {PERIOD}::double), period) as p, first_value(period) over (partition by sector order by round(snr, 9) desc, period) as bp from bls) q group by sector")
def period_diagnostics(spark, d):
    out = _bls(spark, d).groupBy("sector").agg(F.min(F.struct(F.abs(F.col("period") - PERIOD).alias("d"), "period"))["period"].alias("nearest"), F.min(F.struct((-F.col("snr")).alias("s"), "period"))["period"].alias("best"))
    return out.select("sector", r("nearest"), F.round(100 * (F.col("best") - PERIOD) / PERIOD, 6).alias("percent"))


#: The search over all periods from 1 to 5 days: trial durations, and the cells that follow from the shortest.
_LONG = [0.15, 0.3, 0.6]
_SEARCH = f"""src as (select sector, t - 19723::double as x, flux, 1 / (error * error) as w from lcg where good), wh as (select sector, min(x) as t0, max(x) - min(x) as span from src group by sector),
ce as (select sector, t0, any_value(span) as span, (floor((x - t0) / 0.015::double) + 0.5) * 0.015::double as m, count(*) as n, sum(w) as w, sum(w * flux) as wy from src join wh using (sector) group by sector, t0, floor((x - t0) / 0.015::double)),
al as (select sector, sum(n) as sn, sum(w) as sw, sum(wy) as swy from ce group by sector),
pr as (select sector, t0, 1 / (0.2::double + k * (0.3::double / (span * span))) as period from wh, range(0, 4000) as r(k) where k <= round_even(0.8::double / (0.3::double / (span * span)), 0)),
pb as (select *, greatest(1, floor(period / 0.015::double))::int as bins from pr),
fo as (select pb.sector as sector, period, cast(floor((m / period - floor(m / period)) * bins) as int) as bin, sum(n) as n, sum(w) as w, sum(wy) as wy from ce join pb on ce.sector = pb.sector group by all),
al2 as (select pb.sector as sector, period, bins, b % bins as bin, b as pos from pb, range(0, 800) as r(b) where b < 2 * bins),
cu as (select al2.sector as sector, al2.period as period, bins, pos, sum(coalesce(n, 0)) over q as n, sum(coalesce(w, 0)) over q as w, sum(coalesce(wy, 0)) over q as wy
  from al2 left join fo on al2.sector = fo.sector and al2.period = fo.period and al2.bin = fo.bin window q as (partition by al2.sector, al2.period order by pos)),
wd as (select sector, period, t0, bins, duration, greatest(1, cast(round_even(duration / period * bins, 0) as int)) as wide from pb, (select unnest([0.15::double, 0.3::double, 0.6::double]) as duration)),
bx as (select wd.sector as sector, wd.period as period, t0, wd.bins as bins, duration, wide, hi.pos - wide + 1 as start, hi.n - coalesce(lo.n, 0) as n, hi.w - coalesce(lo.w, 0) as w, hi.wy - coalesce(lo.wy, 0) as wy
  from wd join cu hi on hi.sector = wd.sector and hi.period = wd.period and hi.pos >= wide - 1 and hi.pos < wd.bins + wide - 1 left join cu lo on lo.sector = wd.sector and lo.period = wd.period and lo.pos = hi.pos - wide where wide < wd.bins),
sc as (select bx.*, (swy - wy) / (sw - w) - wy / w as depth, sqrt(1 / w + 1 / (sw - w)) as error from bx join al on bx.sector = al.sector where n > 0 and n < sn),
be as (select * from (select *, depth / error as snr, row_number() over (partition by sector order by round(depth / error, 9) desc, period, duration, start) as k from sc) q where k = 1)"""


@query(f"""with {CURVES}, {_SEARCH} select sector, round(period, 6) as period, duration, round(19723 + t0 + ((start + wide / 2.0::double) / bins % 1) * period, 6) as middle, round(depth, 6) as depth, round(error, 6) as error, round(snr, 6) as snr from be""")
def box_search(spark, d):
    """The best box of each sector over every period from 1 to 5 days."""
    rows = curves(spark, d).filter("good").withColumn("x", F.col("t") - 19723.0)
    found = grids.box_search(rows, ["sector"], "x", "flux", "error", 1.0, 5.0, _LONG)
    best = F.max(F.struct("snr", (-F.col("period")).alias("p"), "duration", "middle", "depth", "error")).alias("b")
    out = found.groupBy("sector").agg(best)
    return out.select("sector", F.round(-F.col("b.p"), 6).alias("period"), F.col("b.duration").alias("duration"), F.round(F.col("b.middle") + 19723.0, 6).alias("middle"), *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("depth", "error", "snr")])


@query(f"""with {CURVES}, src as (select series, t - 19723::double as x, flux as y, 1 / (error * error) as w from lcg where good and flux is not null), wh as (select series, min(x) as t0, max(x) - min(x) as span, count(*) as n from src group by series having max(x) > min(x)),
f as (select series, t0, span, n, 1 / 13.0::double + k * (1 / (span * 8)) as frequency from wh, range(0, 4000) as r(k) where k <= round_even((10 - 1 / 13.0::double) / (1 / (span * 8)), 0)),
me as (select series, sum(w * y) / sum(w) as mean from src group by series),
an as (select src.series as series, frequency, span, n, w, y - mean as y, cos(2 * pi() * frequency * (x - t0)) as c, sin(2 * pi() * frequency * (x - t0)) as s from src join f on src.series = f.series join me on src.series = me.series),
sm as (select series, frequency, any_value(span) as span, any_value(n) as n, sum(w) as sw, sum(w * y) as y1, sum(w * c) as c1, sum(w * s) as s1, sum(w * y * y) as yy, sum(w * y * c) as yc, sum(w * y * s) as ys, sum(w * c * c) as cc, sum(w * c * s) as cs, sum(w * s * s) as ss from an group by series, frequency),
ab as (select series, frequency, span, n, yy / sw - y1 / sw * (y1 / sw) as yy, yc / sw - y1 / sw * (c1 / sw) as yc, ys / sw - y1 / sw * (s1 / sw) as ys, cc / sw - c1 / sw * (c1 / sw) as cc, cs / sw - c1 / sw * (s1 / sw) as cs, ss / sw - s1 / sw * (s1 / sw) as ss from sm),
ls as (select series, frequency, span, n, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) as power from ab where cc * ss - cs * cs > 1e-12 and yy > 0 and n > 4),
be as (select * from (select *, row_number() over (partition by series order by round(power, 8) desc, frequency) as k from ls) q where k = 1)
select series, n as points, round(1 / frequency, 6) as period, round(power, 6) as power from be""")
def full_periodogram(spark, d):
    """The strongest period of each series over its whole grid of frequencies from 1/13 to 10 a day."""
    rows = curves(spark, d).filter("good").withColumn("x", F.col("t") - 19723.0)
    found = grids.full_periodogram(rows, ["series"], "x", "flux", "error", 1 / 13, 10.0).filter("power is not null and points > 4")
    best = F.max(F.struct(F.round("power", 8).alias("r"), (-F.col("frequency")).alias("f"), "power", "points")).alias("b")
    return found.groupBy("series").agg(best).select("series", "b.points", F.round(-1 / F.col("b.f"), 6).alias("period"), F.round("b.power", 6).alias("power"))


def _eliminated(p: int, steps: int) -> str:
    """CTEs g1, g2, ... that bring g0's matrix a_ij with right sides i_ij and b_i to the unit matrix."""
    out = []
    for k in range(steps):
        row = lambda c: f"{c} / a{k}{k}"  # noqa: B023, E731
        cells = []
        for i in range(p):
            f = f"a{i}{k}"
            for c, names in (("a", range(p)), ("i", range(p)), ("b", [""])):
                for j in names:
                    own, lead = f"{c}{i}{j}", f"{c}{k}{j}"
                    cells.append(f"{row(lead)} as {own}" if i == k else f"{own} - {f} * ({row(lead)}) as {own}")
        out.append(f"g{k + 1} as (select sector, n, {', '.join(cells)} from g{k})")
    return ", ".join(out)


_DESIGN = ["1.0::double", "x / 10", "cos(x * 2)", "sin(x * 2)"]
_GRAM = ", ".join(f"sum(w * d{i} * d{j}) as a{i}{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(f"{float(i == j)}::double as i{i}{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(f"sum(w * d{i} * flux) as b{i}" for i in range(4))


@query(f"""with {CURVES}, src as (select sector, t - 19738::double as x, flux, error, 1 / (error * error) as w from lcg where good and flux is not null), de as (select *, {', '.join(f'{d} as d{i}' for i, d in enumerate(_DESIGN))} from src),
g0 as (select sector, count(*) as n, {_GRAM} from de group by sector), {_eliminated(4, 4)},
ch as (select de.sector as sector, sum(w * (flux - b0 * d0 - b1 * d1 - b2 * d2 - b3 * d3) * (flux - b0 * d0 - b1 * d1 - b2 * d2 - b3 * d3)) as chi2 from de join g4 on de.sector = g4.sector group by de.sector),
al as (select g4.*, chi2, chi2 / greatest(1, n - 4) as reduced from g4 join ch on g4.sector = ch.sector)
select sector, n, {', '.join(f'round(b{i}, 6) as b{i}, round(sqrt(i{i}{i} * greatest(1, reduced)), 6) as e{i}' for i in range(4))}, round(i12 * greatest(1, reduced), 8) as cov12, round(reduced, 6) as reduced from al""")
def free_design_fit(spark, d):
    """Level, trend and one wave of each sector, fitted together with the full covariance."""
    from skylathe.operators import regression

    x = F.col("x")
    rows = curves(spark, d).filter("good").withColumn("x", F.col("t") - 19738.0)
    out = regression.free_fit(rows, ["sector"], F.col("flux"), F.col("error"), [F.lit(1.0), x / 10, F.cos(x * 2), F.sin(x * 2)])
    each = [c for i in range(4) for c in (F.round(F.col("beta")[i], 6).alias(f"b{i}"), F.round(F.sqrt(F.col("covariance")[5 * i]), 6).alias(f"e{i}"))]
    return out.select("sector", "n", *each, F.round(F.col("covariance")[6], 8).alias("cov12"), r("reduced"))
