"""Queries of classification, coverage, review and injection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import fits, match, photometry, pixels, windows

from .driver_tables import CADENCE, CURVES, DURATION, PERIOD, PHASED, PHOTOMETRY, T0, curves, phased, table
from .driver_tables import photometry as phot
from .fitting import WINDOW, _cells, _fit_sql
from .registered import register
from .tables import PX, _px

QUERIES, ORACLES, query = register()


r = lambda c, n=6: F.round(F.col(c), n).alias(c)

_NAMES = "select p_partkey, p_size, 'hlsp_' || (['qlp', 'TESS-SPOC', 'spoc', 'other'])[p_partkey % 4 + 1] || '_s' || lpad(cast(p_size as varchar), 4, '0') || (['_lc', '_Light_R', '_dark_50s', '_Flat_R'])[p_partkey % 3 + 1] || '.fits' as name from part"


@query(f"""with n as ({_NAMES}), p as (select *, case when contains(lower(name), 'qlp') then 'QLP' when contains(lower(name), 'tess-spoc') then 'TESS-SPOC' when contains(lower(name), 'spoc') then 'SPOC' end as pipeline from n)
select p_partkey, name, pipeline, case when pipeline = 'QLP' and p_size > 25 then 'DET_FLUX' when pipeline = 'QLP' then 'KSPSAP_FLUX' when pipeline is not null then 'PDCSAP_FLUX' end as flux_column,
  case when regexp_matches(name, '(?i)_light_') then 'science' when regexp_matches(name, '(?i)_dark_') then 'dark' when regexp_matches(name, '(?i)_flat_') then 'flat' end as kind, regexp_replace(name, '\\.fits$', '_reduced.fits') as reduced from p""")
def file_classes(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    name = F.concat(F.lit("hlsp_"), pick(["qlp", "TESS-SPOC", "spoc", "other"], 4), F.lit("_s"), F.lpad(F.col("p_size").cast("string"), 4, "0"), pick(["_lc", "_Light_R", "_dark_50s", "_Flat_R"], 3), F.lit(".fits"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", name.alias("name")).withColumn("pipeline", X.pipeline_of(F.col("name")))
    return rows.select("p_partkey", "name", "pipeline", X.flux_column(F.col("pipeline"), F.col("p_size") > 25).alias("flux_column"), X.frame_kind(F.col("name")).alias("kind"), F.regexp_replace("name", r"\.fits$", "_reduced.fits").alias("reduced"))


@query("""select p_partkey, round(p_retailprice / 1000 * 1000, 6) as ppt, round(p_size / 24.0::double * 1440, 6) as minutes, round(case when p_size / 20.0::double > 0 and p_size / 20.0::double < 2 then p_size / 20.0::double * 86400 else p_size / 20.0::double end, 6) as cadence_s, round(p_size * 15.0::double, 6) as ra_deg, cast(5 * floor((p_retailprice - 900) / 5) as bigint) as annulus from part""")
def unit_scaling(spark, d):
    c = F.col("p_size") / F.lit(20.0)
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 1000 * 1000, 6).alias("ppt"), F.round(F.col("p_size") / F.lit(24.0) * 1440, 6).alias("minutes"), F.round(X.cadence_seconds(c), 6).alias("cadence_s"), F.round(X.hours_to_degrees(F.col("p_size")), 6).alias("ra_deg"), X.clean_annulus(F.col("p_retailprice"), 900.0).alias("annulus"))


@query(f"""with {CURVES}, s as (select series, min(t) as a, max(t) as b, round_even(((min(t) + max(t)) / 2 - {T0}::double) / {PERIOD}::double, 0) as e from lcg where good group by series),
w as (select series, a, b, {T0}::double + e * {PERIOD}::double as mid, e from s) select series, cast(e as bigint) as cycle, round(mid, 6) as midpoint, mid - 10 <= a and mid + 10 >= b as brackets, a <= mid - {DURATION / 2}::double and mid + {DURATION / 2}::double <= b as covered, a <= mid + 11.9 and mid + 12.1 <= b as later_covered from w""")
def coverage_flags(spark, d):
    s = curves(spark, d).filter("good").groupBy("series").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    s = s.withColumn("cycle", X.cycle((F.col("a") + F.col("b")) / 2, T0, PERIOD)).withColumn("mid", F.lit(T0) + F.col("cycle") * PERIOD)
    a, b, mid = F.col("a"), F.col("b"), F.col("mid")
    return s.select("series", "cycle", F.round("mid", 6).alias("midpoint"), X.covers(mid - 10, mid + 10, a, b).alias("brackets"), X.covers(a, b, mid - DURATION / 2, mid + DURATION / 2).alias("covered"), X.covers(a, b, mid + 11.9, mid + 12.1).alias("later_covered"))


@query("""select p_partkey, p_size / 50.0::double >= 0.8 and p_partkey % 100 >= 60 and p_partkey % 200 >= 120 and p_partkey % 7 > 0 as measured, not (p_retailprice < 950) as apart,
  p_size / 50.0::double >= 0.8 and p_partkey % 100 >= 60 and p_partkey % 200 >= 120 and p_partkey % 7 > 0 and not (p_retailprice < 950) and p_partkey % 11 * 0.1::double + 3 * (p_partkey % 7 * 0.05::double) < 1.0 as cleared from part""")
def clearance_screen(spark, d):
    k = F.col("p_partkey")
    depth, error = k % 11 * F.lit(0.1), k % 7 * F.lit(0.05)
    measured, cleared = X.cleared(F.col("p_size") / F.lit(50.0), k % 100, k % 200, F.col("p_retailprice") < 950, depth, error, F.lit(1.0))
    return table(spark, d, "part").select("p_partkey", measured.alias("measured"), (~(F.col("p_retailprice") < 950)).alias("apart"), cleared.alias("cleared"))


@query("""select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing' when d.doc_id is null then 'unexpected' else 'different' end as problem from (select * from documents where doc_id % 2 = 0 or doc_id < 100) d full join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null or (d.doc_id % 3 = 0) <> (l.quality = 1)""")
def integrity_join(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0 or doc_id < 100").select("doc_id", (F.col("doc_id") % 3 == 0).alias("ok"))
    return match.broken_join(docs, table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("ok")), "doc_id", "ok")


_LOO = f"""{PHOTOMETRY}, o as (select *, counts / nullif(sum(counts) over (partition by frame) - counts, 0) as o from phot), q as (select *, o / median(o) over (partition by star) as q from o),
qm as (select *, median(q) over (partition by star) as m from q), sc as (select star, 1.4826::double * median(abs(q - m)) as scatter, median(counts) as counts, corr(q, airmass) as by_airmass, corr(q, fwhm) as by_width from qm group by star),
cm as (select *, median(scatter) over () as c from sc), cs as (select 1.4826::double * median(abs(scatter - c)) as s from cm)"""


@query(f"with {_LOO} select star, round(scatter, 8) as scatter, round(counts, 4) as counts, round(by_airmass, 6) as by_airmass, round(by_width, 6) as by_width, round((scatter - c) / nullif(s, 0), 6) as z, coalesce((scatter - c) / nullif(s, 0) > 3, false) as outlier from cm, cs")
def ensemble_review(spark, d):
    out = photometry.ensemble_review(phot(spark, d), {"by_airmass": "airmass", "by_width": "fwhm"})
    return out.select("star", r("scatter", 8), r("counts", 4), r("by_airmass"), r("by_width"), r("z"), "outlier")


@query(f"""with {PHOTOMETRY}, q as (select *, counts / median(counts) over (partition by star) as q from phot), m as (select *, median(q) over (partition by star) as m from q)
select star, case when star = 1 then 'target' else 'comparison' end as role, round(median(counts), 4) as counts, round(median(counts / nullif(error, 0)), 4) as snr, round(max(counts), 4) as peak, round(1000 * 1.4826::double * median(abs(q - m)), 6) as scatter_ppt, count(case when fwhm > 0.042 then 1 end) as saturated from m group by star""")
def star_summary(spark, d):
    out = photometry.star_summary(phot(spark, d), 1, F.col("fwhm") > 0.042)
    return out.select("star", "role", r("counts", 4), r("snr", 4), r("peak", 4), r("scatter_ppt"), "saturated")


def _picked_sql() -> str:
    """CTEs k0 to k5: each role takes its row, or the nearest free one, the lower of two."""
    near = "list_filter(flatten(list_transform(range(0, 6), lambda k: [{w} - k, {w} + k])), lambda j: j >= 0 and j < n and not list_contains(taken, j))[1]"
    wanted = ["0", "n // 2", "greatest(0, m - 12)", "least(n - 1, m + 12)", "n - 1"]
    return ", ".join(f"k{i + 1} as (select star, n, m, list_append(taken, {near.format(w=f'({w})')}) as taken from k{i})" for i, w in enumerate(wanted))


@query(f"""with {PHOTOMETRY}, rw as (select star, frame, airmass, row_number() over (partition by star order by frame) - 1 as i from phot),
lo as (select * from (select star, i as m, row_number() over (partition by star order by airmass, i) as q, count(*) over (partition by star) as n from rw) z where q = 1 and n >= 5),
k0 as (select star, n, m, []::bigint[] as taken from lo), {_picked_sql()}, un as (select star, unnest(taken) as i, unnest({list(windows.ROLES)!r}) as role from k5)
select un.star as star, role, un.i::int as row, frame from un join rw on un.star = rw.star and un.i = rw.i""")
def representative_frames(spark, d):
    return windows.representative_rows(phot(spark, d), ["star"], "frame", "airmass")


@query("""select a.vec_id // 2 as pair, a.embedding = b.embedding as same from embeddings a join embeddings b on a.vec_id // 2 = b.vec_id // 2 and a.vec_id < b.vec_id""")
def equal_stamps(spark, d):
    rows = table(spark, d, "embeddings").select((F.expr("vec_id div 2")).alias("pair"), "embedding")
    return rows.groupBy("pair").agg(F.count("*").alias("n"), (F.min("embedding") == F.max("embedding")).alias("same")).filter("n = 2").select("pair", "same")


@query("""select c_nationkey, c_custkey, stars, rms from (select *, row_number() over (partition by c_nationkey order by stars desc, rms, c_custkey) as k from (select c_nationkey, c_custkey, c_custkey % 7 as stars, c_acctbal as rms from customer) q) w where k = 1""")
def best_shift_choice(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 7).alias("stars"), F.col("c_acctbal").alias("rms"))
    best = F.min_by(F.struct("c_custkey", "stars", "rms"), F.struct((-F.col("stars")).alias("s"), "rms", "c_custkey"))
    return c.groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", "b.*")


_HALF = PHASED.replace(f"{T0}::double", f"{T0 + PERIOD / 2}::double")
_FROM = f"select series, sector, k, cycle, phase, t, flux, error from ph where abs(phase) <= {WINDOW}"


@query(f"with {_HALF}, {_fit_sql('cycle', 'sector', _FROM, _cells([DURATION], [0.0]), least_group=4)} select sector, round(depth, 6) as depth, round(depth_error, 6) as depth_error, n, n_in from fit")
def secondary_fit(spark, d):
    t = F.col("t")
    rows = curves(spark, d).filter("good").withColumn("phase", X.phase(t, T0 + PERIOD / 2, PERIOD)).withColumn("cycle", X.cycle(t, T0 + PERIOD / 2, PERIOD)).filter(F.abs("phase") <= WINDOW)
    out = fits.box_fits(rows, ["sector"], "cycle", "phase", "flux", "error", fits.grid(spark, [DURATION], [0.0]), CADENCE, least_group=4)
    return out.select("sector", r("depth"), r("depth_error"), "n", "n_in")


_STEPS = [-0.35 + 0.7 * i / 70 for i in range(71)]


@query(f"""with {PHASED}, {_fit_sql('cycle', 'sector, pipeline', f"select *, case when k % 2 = 0 then 'QLP' else 'SPOC' end as pipeline from ({_FROM}) z", _cells([DURATION], _STEPS), least_group=4)},
best as (select * from (select *, row_number() over (partition by sector, pipeline order by round(gain, 6) desc, cell) as kk from fit) q where kk = 1) select sector, pipeline, off as offset_days, round(depth, 6) as depth, round(depth_error, 6) as depth_error from best""")
def series_comparison(spark, d):
    rows = phased(spark, d).filter(F.abs("phase") <= WINDOW).withColumn("pipeline", F.when(F.col("k") % 2 == 0, "QLP").otherwise("SPOC"))
    by = ["sector", "pipeline"]
    out = fits.best_boxes(fits.box_fits(rows, by, "cycle", "phase", "flux", "error", fits.grid(spark, [DURATION], _STEPS), CADENCE, least_group=4), by)
    return out.select(*by, F.col("offset").alias("offset_days"), r("depth"), r("depth_error"))


_SPACE = [(i, s, q) for i, (s, q) in enumerate((s, q) for s in (-0.6, 0.0, 0.6) for q in (0.0, 0.1, 0.3))]
_SPACE_SQL = "select * from (values " + ", ".join(f"({i}, {s}::double, {q}::double)" for i, s, q in _SPACE) + ") as t(trial, shift, q)"
_AT = "(phase - shift)"
_IN = f"greatest(0, least(1, (least({_AT} + {CADENCE / 2}::double, {DURATION / 2}::double) - greatest({_AT} - {CADENCE / 2}::double, {-DURATION / 2}::double)) / {CADENCE}::double))"


@query(f"""with {PHASED}, tr as ({_SPACE_SQL}), {_fit_sql('cycle', 'sector, trial, q', f'select sector, trial, q, cycle, {_AT} as x, flux / 50 * (1 - q * {_IN}) as flux, error / 50 as error from ph, tr where abs({_AT}) <= {WINDOW}', _cells([DURATION], [0.0]), least_group=4, x='x')}
select sector, q, round(avg(depth), 6) as mean, round(stddev_samp(depth), 6) as spread, count(*) as n from fit group by sector, q""")
def space_injection(spark, d):
    trials = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(s).alias("shift"), F.lit(q).alias("q")) for i, s, q in _SPACE])
    rows = phased(spark, d).select("*", F.inline(trials)).withColumn("x", F.col("phase") - F.col("shift")).filter(F.abs("x") <= WINDOW)
    rows = rows.withColumn("flux", F.col("flux") / 50 * (1 - F.col("q") * X.box_fraction(F.col("x"), DURATION, CADENCE))).withColumn("error", F.col("error") / 50)
    out = fits.box_fits(rows, ["sector", "trial", "q"], "cycle", "x", "flux", "error", fits.grid(spark, [DURATION], [0.0]), CADENCE, least_group=4)
    return out.groupBy("sector", "q").agg(F.round(F.avg("depth"), 6).alias("mean"), F.round(F.stddev_samp("depth"), 6).alias("spread"), F.count("*").alias("n"))


_WIN = (19736.0, 19741.0)
_MID, _LEN = sum(_WIN) / 2, _WIN[1] - _WIN[0]
_WB = f"greatest(0, least(1, (least(t + {CADENCE / 2}::double, {_WIN[1]}::double) - greatest(t - {CADENCE / 2}::double, {_WIN[0]}::double)) / {CADENCE}::double))"


@query(f"""with {PHASED}, {_fit_sql('', 'series, kind', f"select series, 'observed' as kind, t - {_MID}::double as x, flux / 50 as flux, error / 50 as error from ph union all select series, 'injected', t - {_MID}::double, flux / 50 * (1 - 0.00291::double * {_WB}), error / 50 from ph", _cells([_LEN], [0.0]), least_in=3, floor=False, x='x')}
select series, kind, round(depth, 6) as depth, round(depth_error, 6) as depth_error, n, n_in from fit""")
def schedule_window(spark, d):
    rows = phased(spark, d).withColumn("x", F.col("t") - _MID).withColumn("f", F.col("flux") / 50).withColumn("error", F.col("error") / 50)
    given = F.col("f") * (1 - 0.00291 * X.window_fraction(F.col("t"), *_WIN, CADENCE))
    both = F.explode(F.array(F.struct(F.lit("observed").alias("kind"), F.col("f").alias("flux")), F.struct(F.lit("injected").alias("kind"), given.alias("flux"))))
    rows = rows.select("series", "x", "error", both.alias("b")).select("series", "x", "error", "b.*")
    out = fits.box_fits(rows, ["series", "kind"], None, "x", "flux", "error", fits.grid(spark, [_LEN], [0.0]), CADENCE, least_in=3, floor=False)
    return out.select("series", "kind", r("depth"), r("depth_error"), "n", "n_in")


def _ring_sql(name: str, counts: str) -> str:
    return f"""select '{name}' as ring, 100 * 1.4826::double * median(abs(q - m)) as scatter, 100 * any_value(sd) as full_std, any_value(sky) as sky from (select *, median(q) over () as m, stddev_pop(q) over () as sd from (select r / median(r) over () as q, median(airmass) over () as sky from (select max(case when star = 1 then {counts} end) / sum(case when star <> 1 then {counts} end) as r, max(case when star = 1 then airmass end) as airmass from phot group by frame having count(case when star = 1 then 1 end) > 0) a where r is not null) b) c"""


@query(f"""with {PHOTOMETRY}, g as ({_ring_sql('narrow', 'counts')} union all {_ring_sql('wide', 'counts * (1 + airmass)')}) select ring, round(scatter, 6) as scatter, round(full_std, 6) as full_std, round(sky, 6) as sky, ring = case when max(case when ring = 'wide' then scatter end) over () <= max(case when ring = 'narrow' then scatter end) over () then 'wide' else 'narrow' end as chosen from g""")
def sky_ring_choice(spark, d):
    rows = phot(spark, d)
    rings = rows.withColumn("ring", F.lit("narrow")).unionByName(rows.withColumn("counts", F.col("counts") * (1 + F.col("airmass"))).withColumn("ring", F.lit("wide")))
    return photometry.sky_ring_choice(rings, 1, "airmass", "narrow", "wide").select("ring", r("scatter"), r("full_std"), r("sky"), "chosen")


@query(f"""with {PHOTOMETRY}, a as (select frame, max(case when star = 1 then counts end) as t, sum(case when star <> 1 then counts end) as c from phot group by frame), q as (select frame, c, t / c as r, round(c, 1) as nc, round(t / c, 9) as nr from a where t is not null and c > 0),
n as (select c, nc, r / median(r) over () as e, nr / median(nr) over () as v from q) select count(*) as rows, max(abs(e - v)) <= 1e-6 as curve_agrees, max(abs(c - nc)) <= 1e-5 as counts_agree from n""")
def table_validation(spark, d):
    mine = F.max(F.when(F.col("star") == 1, F.col("counts")))
    native = phot(spark, d).groupBy("frame").agg(mine.alias("t"), F.sum(F.when(F.col("star") != 1, F.col("counts"))).alias("c"))
    native = native.select("frame", F.round(F.try_divide("t", "c"), 9).alias("relative"), F.round("c", 1).alias("total"))
    return photometry.table_validation(phot(spark, d), native, 1, curve_limit=1e-6).select("rows", "curve_agrees", "counts_agree")


@query(f"""with {CURVES}, g as (select series, t, flux from lcg where good), i as (select *, row_number() over (partition by series order by t) - 1 as i, floor(count(*) over (partition by series) * 0.8::double) as from_i from g),
n as (select series, case when count(case when t > 19741.1 then 1 end) >= 12 then median(case when t > 19741.1 then flux end) else median(case when i >= from_i then flux end) end as level from i group by series)
select g.series as series, round(median(case when t > 19741.1 then flux / level end) - median(case when t between 19736 and 19741 then flux / level end), 8) as depth, round(any_value(level), 8) as level from g join n on g.series = n.series group by g.series""")
def post_window_depth(spark, d):
    out = photometry.post_window_depth(curves(spark, d).filter("good"), ["series"], "t", "flux", 19736.0, 19741.0, 0.1)
    return out.select("series", r("depth", 8), r("level", 8))


@query(f"with {PX} select label, count(case when y % 4 = 0 and x % 4 = 0 then 1 end) as thumbnail, round(avg(case when value >= 1.25 then 1.0::double else 0 end), 8) as saturated, round(avg(case when value < 0.8 then 1.0::double else 0 end), 8) as low from px group by label")
def saturation_summary(spark, d):
    return pixels.frame_summary(_px(spark, d), ["label"], 4, 1.25, 0.8).select("label", "thumbnail", r("saturated", 8), r("low", 8))


@query(f"with {PX} select vec_id, y - 2 as y, x - 1 as x, round(value, 6) as value from px where y between 2 and 5 and x between 1 and 6")
def crop_stamps(spark, d):
    return pixels.crop(_px(spark, d), 2, 1, 4, 6).select("vec_id", "y", "x", r("value"))


_RA0, _DEC0, _SCALE, _FACTOR = 150.0, 10.0, 0.35, (0.9, -0.2)


@query(f"""with c as (select c_custkey, (c_custkey * 37 % 3600)::double / 10 as ra, (c_custkey * 91 % 1800)::double / 10 - 90 as dec from customer), u as (select c_custkey, -((((ra - {_RA0}::double + 180) % 360 + 360) % 360) - 180) * cos(radians({_DEC0}::double)) * 3600 / {_SCALE}::double as u, -(dec - {_DEC0}::double) * 3600 / {_SCALE}::double as v from c)
select c_custkey, round(u * {_FACTOR[0]}::double - v * ({_FACTOR[1]})::double, 4) as dx, round(u * ({_FACTOR[1]})::double + v * {_FACTOR[0]}::double, 4) as dy from u""")
def pointing_shift(spark, d):
    k = F.col("c_custkey")
    dx, dy = X.pointing_shift((k * 37 % 3600).cast("double") / 10, (k * 91 % 1800).cast("double") / 10 - 90, (_RA0, _DEC0), _SCALE, _FACTOR)
    return table(spark, d, "customer").select("c_custkey", F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"))


@query("select p_partkey, round((p_partkey * 37 % 4096)::double, 5) as x, round((p_partkey * 91 % 4096)::double, 5) as y from part")
def sky_to_pixel(spark, d):
    wcs = ((300.0, 35.0), (2048.0, 2048.0), (-0.0001, 0.00001, 0.00001, 0.0001))
    ra, dec = X.position_tan((F.col("p_partkey") * 37 % 4096).cast("double"), (F.col("p_partkey") * 91 % 4096).cast("double"), *wcs)
    x, y = X.pixel_tan(F.col("ra"), F.col("dec"), *wcs)
    return table(spark, d, "part").select("p_partkey", ra.alias("ra"), dec.alias("dec")).select("p_partkey", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("""select p_partkey, round(sqrt(greatest(p_size - 10, 0)), 6) as odd_even_sigma, round(case when p_size % 5 > 0 then abs(p_retailprice - 1000) / (p_size % 5) end, 6) as centroid_sigma, round(case when p_size % 3 <> 0 then (p_retailprice - 1000) / (p_size % 3) end, 6) as ratio from part""")
def odd_even_sigma(spark, d):
    s, q = F.col("p_size"), F.col("p_retailprice") - 1000
    return table(spark, d, "part").select("p_partkey", F.round(F.sqrt(F.greatest(s - 10, F.lit(0))), 6).alias("odd_even_sigma"), F.round(F.when(s % 5 > 0, F.abs(q) / F.nullif(s % 5, F.lit(0))), 6).alias("centroid_sigma"), F.round(F.try_divide(q, F.nullif(s % 3, F.lit(0))), 6).alias("ratio"))


_SKY = """c as (select c_custkey, 150 + (c_custkey * 37 % 1009)::double / 500 as ra, 10 + (c_custkey * 91 % 1013)::double / 500 as dec from customer)"""
_SEP = "degrees(asin(sqrt(greatest(0, least(1, pow(sin(radians(dec - ({d})) / 2), 2) + cos(radians(dec)) * cos(radians({d})) * pow(sin(radians(ra - ({r})) / 2), 2)))))) * 2 * 3600"


def _sky(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (F.lit(150) + (k * 37 % 1009).cast("double") / 500).alias("ra"), (F.lit(10) + (k * 91 % 1013).cast("double") / 500).alias("dec"))


@query(f"with {_SKY}, s as (select c_custkey, {_SEP.format(r='151.0::double', d='11.0::double')} as sep from c) select c_custkey, round(sep, 5) as separation, row_number() over (order by sep, c_custkey) as rank from s where sep <= 900")
def cone_search(spark, d):
    near = match.cone(_sky(spark, d), ("ra", "dec"), (151.0, 11.0), 900.0)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("separation", "c_custkey"))).select("c_custkey", r("separation", 5), "rank")


@query(f"with {_SKY}, k as (select 150 + (s_suppkey * 53 % 1009)::double / 500 as r, 10 + (s_suppkey * 71 % 1013)::double / 500 as d from supplier) select distinct c_custkey from c, k where {_SEP.format(r='r', d='d')} <= 60")
def circles_search(spark, d):
    k = F.col("s_suppkey")
    circles = table(spark, d, "supplier").select((F.lit(150) + (k * 53 % 1009).cast("double") / 500).alias("ra"), (F.lit(10) + (k * 71 % 1013).cast("double") / 500).alias("dec"), "s_suppkey")
    return match.in_circles(_sky(spark, d), circles, ("ra", "dec"), 60.0).select("c_custkey")


@query("""with c as (select o_orderkey, cast(o_orderdate as date) as day, 20 * 60 + o_orderkey % 60 as start, (24 * 60 + 30 + o_orderkey % 200) % 1440 as i, (24 * 60 + 150 + o_orderkey % 200) % 1440 as e from orders), z as (select *, unnest(['America/New_York', 'UTC']) as zone from c),
l as (select o_orderkey, zone, day + to_minutes(i + case when i < start then 1440 else 0 end) as li, day + to_minutes(e + case when e < start then 1440 else 0 end) as le from z),
u as (select *, epoch(timezone(zone, li))::bigint as ui, epoch(timezone(zone, le))::bigint as ue from l),
t as (select o_orderkey, zone, case when timezone(zone, to_timestamp(ui - 3600)) = li then ui - 3600 else ui end as ingress, case when timezone(zone, to_timestamp(ue - 3600)) = le then ue - 3600 else ue end as egress from u)
select *, (ingress + egress) / 2.0::double as midpoint, egress - ingress as duration, ingress < egress as in_order from t""")
def zone_interpretation(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (20 * 60 + k % 60).alias("start"), ((24 * 60 + 30 + k % 200) % 1440).alias("ingress"), ((24 * 60 + 150 + k % 200) % 1440).alias("egress"))
    return X.interpreted(rows, "day", "start", "ingress", "egress", ["America/New_York", "UTC"])


@query("""with o as (select distinct s_nationkey * 2.5::double as e from supplier), d as (select p_partkey, p_size, e, abs(e - p_size) as d from part, o)
select p_partkey, e as exposure from (select *, row_number() over (partition by p_partkey order by d, e) as k from d) q where k = 1""")
def closest_exposure(spark, d):
    darks = table(spark, d, "supplier").select((F.col("s_nationkey") * F.lit(2.5)).alias("e"))
    return match.nearest_option(table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size").cast("double"), darks, "e", "exposure").select("p_partkey", "exposure")


_RINGS = "sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))"


@query(f"""with {PX}, pr as (select label, cast(floor({_RINGS} / 0.5) as bigint) as bin, median({_RINGS}) as radius, median(greatest(value - 1.05, 0)) as value from px group by label, bin), top as (select label, arg_min(value, bin) as top from pr group by label),
low as (select pr.label as label, arg_min(radius, bin) * 2 as fwhm from pr join top on pr.label = top.label where radius > 1 and value <= top / 2 group by pr.label) select top.label as label, round(fwhm, 6) as fwhm from top left join low on top.label = low.label""")
def profile_width(spark, d):
    px = _px(spark, d).withColumn("value", F.greatest(F.col("value") - 1.05, F.lit(0.0)))
    return pixels.half_width(pixels.radial_profile(px, ["label"], 3.5, 3.5), ["label"]).select("label", r("fwhm"))


@query(f"""with {PHOTOMETRY}, l as (select *, median(case when counts > 0 then counts end) over (partition by star) as l from phot), f as (select frame, median(case when star <> 1 and counts > 0 then counts / l end) as tr, count(case when star <> 1 and counts > 0 then 1 end) as n, coalesce(bool_or(star = 1 and counts > 0), false) as t, max(case when star = 1 then airmass end) as b from l group by frame),
k as (select *, t and n >= 5 and tr is not null as ok from f), m as (select median(b) as m from k where ok), d as (select any_value(m) + 2 * greatest(1.4826::double * median(abs(b - m)), 0.0001::double) as lim from k, m where ok)
select frame, round(tr, 6) as transparency, n as comparisons, coalesce(ok and tr > 0.8 and tr < 1.2 and b < lim, false) as good from k left join d on true""")
def quality_frames(spark, d):
    out = photometry.quality_frames(phot(spark, d), 1, "airmass", least=5, low=0.8, high=1.2, sigmas=2.0, floor=0.0001)
    return out.select("frame", r("transparency"), "comparisons", "good")


@query(f"""with {PX}, m as (select *, median(value) over (partition by vec_id) as m from px), s as (select vec_id, any_value(m) as c, coalesce(nullif(1.4826::double * median(abs(value - m)), 0), stddev_pop(value)) as s from m group by vec_id),
g as (select px.vec_id as vec_id, y, x, greatest(value - c - 0.5::double * s, 0) as v from px join s on px.vec_id = s.vec_id), t as (select vec_id, quantile_cont(v, 0.9) as cap from g where v > 0 group by vec_id having count(*) >= 15)
select g.vec_id as vec_id, y, x, round(case when y between 1 and 6 and x between 1 and 6 then least(v, cap) else 0 end, 6) as value from g join t on g.vec_id = t.vec_id""")
def field_signatures(spark, d):
    out = pixels.field_signature(_px(spark, d), ["vec_id"], 8, 8, stride=1, sigmas=0.5, cap=0.9, border=1, least=15)
    return out.select("vec_id", "y", "x", r("value"))


@query(f"with {PX} select vec_id, count(*) as n, true as exact, 0.0::double as largest from px where label > 1 and (vec_id * 7 + y * 31 + x * 17) % 4 = 0 group by vec_id")
def calibration_check(spark, d):
    px = _px(spark, d)
    dark, flat = (pixels.median_stack(px.filter(F.col("label") == k), []).select("y", "x", "value") for k in (0, 1))
    raw = px.filter("label > 1")
    return pixels.calibration_check(pixels.calibrated(raw, dark, flat, ["vec_id"]), raw, dark, flat, "vec_id", 4)


@query(f"with {PX} select vec_id, count(*) as n, true as exact, count(case when y + 1 > 7 or x - 2 < 0 then 1 end) as filled from px where y % 2 = 0 and x % 2 = 0 group by vec_id")
def shift_check(spark, d):
    px = _px(spark, d).drop("label")
    return pixels.shift_check(pixels.shifted(px, ["vec_id"], -1, 2, 8, 8, -1.0), px, ["vec_id"], -1, 2, 2, -1.0)
