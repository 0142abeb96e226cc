"""Differential photometry over long tables (frame, star, counts, error, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylathe.operators.quality import at_least
from skylathe.operators.stats import clipped_std, correlation, mad_raw, median


def target_curve(df: DataFrame, target: int, frame: str = "frame", star: str = "star") -> DataFrame:
    """frame, relative, error: target over the sum of the other stars, and its error, both over the
    median; null where the sum isn't positive."""
    mine, others = F.col(star) == target, F.col(star) != target
    sums = df.groupBy(frame).agg(
        F.sum(F.when(mine, F.col("counts"))).alias("t"), F.sum(F.when(mine, F.col("error"))).alias("et"), F.sum(F.when(others, F.col("counts"))).alias("c"), F.sqrt(F.sum(F.when(others, F.col("error") * F.col("error")))).alias("ec")
    )
    sums = sums.withColumn("r", F.when((F.col("c") > 0) & F.col("t").isNotNull(), F.col("t") / F.col("c")))
    level = sums.agg(median(F.col("r")).alias("level"))
    error = F.abs("r") * F.sqrt(F.pow(F.try_divide("et", "t"), F.lit(2.0)) + F.pow(F.try_divide("ec", "c"), F.lit(2.0)))
    return sums.join(F.broadcast(level), F.lit(True)).select(frame, F.try_divide("r", "level").alias("relative"), F.try_divide(error, F.col("level")).alias("error"))


def ensembles(df: DataFrame, target: int, frame: str = "frame", star: str = "star") -> DataFrame:
    """frame, kind, relative: target against the other stars by summed flux, by the mean of their
    normalised fluxes and by their mean weighted with inverse squared relative errors; each over its median."""
    rows = df.withColumn("level", median(F.col("counts")).over(Window.partitionBy(star)))
    rows = rows.withColumn("q", F.try_divide("counts", "level")).withColumn("w", F.pow(F.try_divide("level", "error"), F.lit(2.0)))
    mine, others = F.col(star) == target, F.col(star) != target
    of = lambda c: F.when(others, F.col(c))
    wq = F.try_divide(F.sum(F.when(others, F.col("w") * F.col("q"))), F.sum(of("w")))
    sums = rows.groupBy(frame).agg(F.sum(F.when(mine, F.col("counts"))).alias("t"), F.sum(of("counts")).alias("flux_sum"), F.avg(of("q")).alias("equal_star"), wq.alias("inverse_error"))
    kinds = ["flux_sum", "equal_star", "inverse_error"]
    long = sums.select(frame, "t", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("c")) for k in kinds])).alias("e")).select(frame, F.col("e.kind").alias("kind"), F.try_divide(F.col("t"), F.col("e.c")).alias("r"))
    level = long.groupBy("kind").agg(median(F.col("r")).alias("level"))
    return long.join(F.broadcast(level), "kind").select(frame, "kind", F.try_divide("r", "level").alias("relative"))


def scatter_by_kind(df: DataFrame, kind: str = "kind", x: str = "relative") -> DataFrame:
    """kind, n, robust, sample: robust scatter and sample deviation on the same rows."""
    sample = df.groupBy(kind).agg(F.stddev_samp(x).alias("sample"))
    return mad_raw(df, [kind], F.col(x)).join(sample, kind).select(kind, "n", F.col("mad").alias("robust"), "sample")


def leave_one_out(df: DataFrame, frame: str = "frame", star: str = "star") -> DataFrame:
    """df with other, each star over the sum of the rest of its frame (sum less own)."""
    rest = F.sum("counts").over(Window.partitionBy(frame)) - F.col("counts")
    return df.withColumn("other", F.when(rest > 0, F.col("counts") / rest))


def comparison_review(df: DataFrame, covariates: list[str], frame: str = "frame", star: str = "star") -> DataFrame:
    """star, scatter of its leave-one-out curve over the median, its correlations with the covariates
    and the largest of these by size."""
    rows = leave_one_out(df, frame, star)
    rows = rows.withColumn("q", F.try_divide("other", median(F.col("other")).over(Window.partitionBy(star))))
    links = rows.groupBy(star).agg(*[correlation(F.col("q"), F.col(c)).alias(f"corr_{c}") for c in covariates])
    most = F.greatest(*[F.abs(f"corr_{c}") for c in covariates])
    return mad_raw(rows, [star], F.col("q")).select(star, "n", F.col("mad").alias("scatter")).join(links, star).withColumn("largest", most)


def frame_transparency(df: DataFrame, frame: str = "frame", star: str = "star") -> DataFrame:
    """frame, transparency: median over stars of counts over the star's median."""
    rows = df.withColumn("q", F.try_divide("counts", median(F.col("counts")).over(Window.partitionBy(star))))
    return rows.groupBy(frame).agg(median(F.col("q")).alias("transparency"))


def comparison_stars(df: DataFrame, x: Column, y: Column, flux: Column, width: Column, size: tuple[float, float], centre: tuple[float, float, float, float], most: int = 10, tie: Column | None = None, least: int = 0) -> DataFrame:
    """The stars most like the target (x, y, flux, width): 300 away at least, 500 from the edge, of
    half to one and a half its flux and within 1 of its width, by the size of the log of the ratio, then width, then
    distance, then tie. Reading fails where there are fewer than `least`."""
    ratio = flux / centre[2]
    edge = F.least(x, y, size[0] - x, size[1] - y)
    rows = df.withColumn("distance", F.hypot(x - centre[0], y - centre[1])).withColumn("edge", edge).withColumn("ratio", ratio)
    rows = rows.filter((F.col("distance") >= 300) & (F.col("edge") >= 500) & F.col("ratio").between(0.5, 1.5) & (F.abs(width - centre[3]) <= 1))
    best = rows.orderBy(F.abs(F.log("ratio")), F.abs(width - centre[3]), F.desc("distance"), *([tie] if tie is not None else [])).limit(most)
    return at_least(best, least, "comparison stars") if least else best


def stable_stars(df: DataFrame, frames: int, frame: str = "frame", star: str = "star", coverage: float = 0.9, floor: float = 0.006, fallback: int = 10) -> DataFrame:
    """star, covered, scatter, chosen: stars seen in enough of the frames whose curves, over a quadratic
    in time, scatter no more than max(median + 2.5 robust deviations, floor); the best `fallback`
    if none does."""
    from skylathe.operators.fits import quadratic_baseline

    rows = quadratic_baseline(df, [star], frame, "counts", least=3).withColumn("flat", F.try_divide("counts", "baseline"))
    each = mad_raw(rows, [star], F.col("flat")).select(star, (F.col("n") / frames).alias("covered"), F.col("mad").alias("scatter"))
    ok = each.filter(F.col("covered") >= coverage)
    limit = mad_raw(ok.withColumn("all", F.lit(1)), ["all"], F.col("scatter")).select(F.greatest(F.col("median") + 2.5 * F.col("mad"), F.lit(floor)).alias("limit"))
    best = ok.orderBy("scatter", star).limit(fallback).select(star, F.lit(True).alias("best"))
    out = each.join(F.broadcast(limit), F.lit(True), "left").join(F.broadcast(best), star, "left")
    passes = F.coalesce((F.col("covered") >= coverage) & (F.col("scatter") <= F.col("limit")), F.lit(False))
    none = out.agg(F.bool_or(passes).alias("any"))
    return out.join(F.broadcast(none), F.lit(True)).select(star, "covered", "scatter", (passes | (~F.col("any") & F.coalesce("best", F.lit(False)))).alias("chosen"))


def ensemble_review(df: DataFrame, covariates: dict[str, str], frame: str = "frame", star: str = "star") -> DataFrame:
    """star, scatter (robust, of its leave-one-out curve over the median), clipped_std (of that curve), counts and snr
    (medians), correlations with the covariates by name, z (of the scatter among the stars' scatters), outlier (z over 3)."""
    rows = leave_one_out(df, frame, star)
    rows = rows.withColumn("q", F.try_divide("other", median(F.col("other")).over(Window.partitionBy(star))))
    each = rows.groupBy(star).agg(median(F.col("counts")).alias("counts"), median(F.try_divide("counts", "error")).alias("snr"), *[correlation(F.col("q"), F.col(c)).alias(n) for n, c in covariates.items()])
    each = mad_raw(rows, [star], F.col("q")).select(star, F.col("mad").alias("scatter")).join(each, star).join(clipped_std(rows, [star], "q").select(star, F.col("std").alias("clipped_std")), star)
    level = mad_raw(each.withColumn("_all", F.lit(1)), ["_all"], F.col("scatter")).select(F.col("median").alias("_c"), F.nullif(F.col("mad"), F.lit(0.0)).alias("_s"))
    z = (F.col("scatter") - F.col("_c")) / F.col("_s")
    return each.join(F.broadcast(level), F.lit(True)).withColumn("z", z).withColumn("outlier", F.coalesce(F.col("z") > 3, F.lit(False))).drop("_c", "_s")


def star_summary(df: DataFrame, target: int, saturated: Column, star: str = "star") -> DataFrame:
    """star, role, counts and snr (medians), peak, scatter_ppt (robust, over the median), saturated frames."""
    rows = df.withColumn("_q", F.try_divide("counts", median(F.col("counts")).over(Window.partitionBy(star))))
    role = F.when(F.col(star) == target, "target").otherwise("comparison")
    each = rows.groupBy(star).agg(median(F.col("counts")).alias("counts"), median(F.try_divide("counts", "error")).alias("snr"), F.max("counts").alias("peak"), F.count_if(saturated).alias("saturated"))
    return each.join(mad_raw(rows, [star], F.col("_q")).select(star, (F.col("mad") * 1000).alias("scatter_ppt")), star).withColumn("role", role)


def sky_ring_choice(df: DataFrame, target: int, sky: str, narrow: str, wide: str, ring: str = "ring", frame: str = "frame", star: str = "star") -> DataFrame:
    """ring, scatter, clipped_std, full_std (percent, of the target's curve over its median), sky (median of the
    target's), chosen: the wide ring unless its curve scatters more than the narrow one's."""
    mine = F.col(star) == target
    curve = df.groupBy(ring, frame).agg(F.max(F.when(mine, F.col("counts"))).alias("_t"), F.sum(F.when(~mine, F.col("counts"))).alias("_c"), F.max(F.when(mine, F.col(sky))).alias("_sky"))
    curve = curve.withColumn("_r", F.try_divide("_t", "_c")).filter("_r is not null").withColumn("_q", F.col("_r") / median(F.col("_r")).over(Window.partitionBy(ring)))
    each = mad_raw(curve, [ring], F.col("_q")).select(ring, (100 * F.col("mad")).alias("scatter"))
    each = each.join(curve.groupBy(ring).agg((100 * F.stddev_pop("_q")).alias("full_std"), median(F.col("_sky")).alias("sky")), ring).join(clipped_std(curve, [ring], "_q").select(ring, (100 * F.col("std")).alias("clipped_std")), ring)
    of = lambda k: F.max(F.when(F.col(ring) == k, F.col("scatter")))
    best = each.agg(F.when(of(wide) <= of(narrow), wide).otherwise(narrow).alias("_best"))
    return each.join(F.broadcast(best), F.lit(True)).withColumn("chosen", F.col(ring) == F.col("_best")).drop("_best")


def table_validation(df: DataFrame, native: DataFrame, target: int, curve_limit: float = 1e-10, count_limit: float = 1e-5, frame: str = "frame", star: str = "star") -> DataFrame:
    """One row: rows, curve_difference, count_difference, curve_agrees, counts_agree, of a table that
    another program wrote (frame, relative, total) against the curve and total made here."""
    mine = F.col(star) == target
    own = df.groupBy(frame).agg(F.max(F.when(mine, F.col("counts"))).alias("_t"), F.sum(F.when(~mine, F.col("counts"))).alias("_c"))
    both = own.join(native, frame).withColumn("_r", F.try_divide("_t", "_c")).filter("_r is not null and relative is not null")
    level = both.agg(median(F.col("_r")).alias("_mr"), median(F.col("relative")).alias("_mn"))
    both = both.join(F.broadcast(level), F.lit(True))
    out = both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("_r") / F.col("_mr") - F.col("relative") / F.col("_mn"))).alias("curve_difference"), F.max(F.abs(F.col("_c") - F.col("total"))).alias("count_difference"))
    return out.withColumn("curve_agrees", F.col("curve_difference") <= curve_limit).withColumn("counts_agree", F.col("count_difference") <= count_limit)


def post_window_depth(df: DataFrame, by: list[str], t: str, flux: str, start: float, end: float, margin: float, least: int = 12, tail: float = 0.8) -> DataFrame:
    """by, level, depth, scatter: fluxes over the median of those later than the window and a margin (where these are
    fewer than `least`, of those that come after a share `tail` of the series' rows in order of time); the median after the
    window less that inside, and the robust scatter after it."""
    after, inside = F.col(t) > end + margin, F.col(t).between(start, end)
    kin = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(kin.orderBy(t)) - 1).withColumn("_last", F.col("_i") >= F.floor(F.count("*").over(kin) * tail))
    level = rows.groupBy(*by).agg(F.when(F.count_if(after) >= least, median(F.when(after, F.col(flux)))).otherwise(median(F.when(F.col("_last"), F.col(flux)))).alias("level"))
    rows = df.join(level, by).withColumn("_q", F.try_divide(flux, "level"))
    late = mad_raw(rows, by, F.when(after, F.col("_q"))).select(*by, F.col("mad").alias("scatter"))
    depth = median(F.when(after, F.col("_q"))) - median(F.when(inside, F.col("_q")))
    return rows.groupBy(*by).agg(F.first("level").alias("level"), depth.alias("depth")).join(late, by)


def quality_frames(df: DataFrame, target: int, background: str, least: int = 6, low: float = 0.45, high: float = 1.7, sigmas: float = 7.0, floor: float = 1.0, frame: str = "frame", star: str = "star", inside: Column | None = None, rms: str | None = None, most_rms: float = 4.0) -> DataFrame:
    """frame, transparency (median over comparison stars of counts over the star's median), comparisons
    (those with counts), good: enough of them and the target counted, transparency between the limits,
    and the target's background no more than so many robust deviations (of the floor at least) over
    the median of the counted frames. With `inside`, whether the target's row lies inside the frame, and `rms`, its
    centroids' scatter, these count too: outside, and a scatter of most_rms or more, is not good."""
    mine, seen = F.col(star) == target, F.col("counts") > 0
    rows = df.withColumn("_l", median(F.when(seen, F.col("counts"))).over(Window.partitionBy(star)))
    each = rows.groupBy(frame).agg(
        median(F.when(~mine & seen, F.try_divide("counts", "_l"))).alias("transparency"), F.count_if(~mine & seen).alias("comparisons"), F.coalesce(F.bool_or(mine & seen), F.lit(False)).alias("_t"), F.max(F.when(mine, F.col(background))).alias("_b"),
        (F.coalesce(F.bool_or(mine & inside), F.lit(False)) if inside is not None else F.lit(True)).alias("_in"), (F.max(F.when(mine, F.col(rms))) < most_rms if rms else F.lit(True)).alias("_steady"),
    )
    each = each.withColumn("_ok", F.col("_t") & (F.col("comparisons") >= least) & F.col("transparency").isNotNull())
    level = mad_raw(each.filter("_ok").withColumn("_all", F.lit(1)), ["_all"], F.col("_b")).select((F.col("median") + sigmas * F.greatest(F.col("mad"), F.lit(floor))).alias("_limit"))
    good = F.col("_ok") & F.col("_in") & F.col("_steady") & (F.col("transparency") > low) & (F.col("transparency") < high) & (F.col("_b") < F.col("_limit"))
    return each.join(F.broadcast(level), F.lit(True), "left").select(frame, "transparency", "comparisons", F.coalesce(good, F.lit(False)).alias("good"))
