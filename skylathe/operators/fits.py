"""Weighted least squares as grouped aggregates.

Box fits have an intercept and a slope for each group of points and one box column in common. By the
theorem of Frisch, Waugh and Lovell, flux and box are each freed of intercept and slope within the
group, and what is left of them gives depth, variance and chi-square as sums. Sums are taken about
the group's means. The flux side doesn't depend on the trial box, so it is summed once; trial boxes
multiply only the points that they overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylathe.functions.expr import box_fraction
from skylathe.operators.cuts import cut

#: Groups whose means are sent to every task rather than joined by a shuffle of the points.
FEW = 100_000


def alongside(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of told, a row a group; null keys are a group."""
    told = told.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(told, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_{k}`")) for k in keys]).drop(*(f"_{k}" for k in keys))


def _by_bucket(cells: DataFrame, cadence: float) -> tuple[DataFrame, float]:
    """cells with the buckets of x that they overlap, and a bucket's width, half the widest box."""
    width = float((cells.agg(F.max("duration")).first()[0] or 0.0) + cadence) / 2
    reach = (F.col("duration") + cadence) / 2
    at = lambda e: F.floor(e / width).cast("long")
    return cells.withColumn("bucket", F.explode(F.sequence(at(F.col("offset") - reach), at(F.col("offset") + reach)))), width


def box_sums(df: DataFrame, by: list[str], group: str | None, x: str, flux: str, error: str, cells: DataFrame, cadence: float, least_group: int = 1) -> tuple[DataFrame, DataFrame]:
    """Flux sums (by, n, groups, c) and box sums (by, cell, duration, offset, a, b, n_in).

    cells (cell, duration, offset) is a grid of trial boxes, small by its nature; points meet the boxes that
    overlap them by bucket of x. All sums are grouped ones that add up ahead of the shuffle.
    """
    own = [*by, *([group] if group else [])]
    rows = df.select(*own, F.col(x).alias("x"), F.col(flux).alias("y"), (1 / (F.col(error) * F.col(error))).alias("w"))
    w, u, v, b = F.col("w"), F.col("u"), F.col("v"), F.col("box")
    # The rows may be many copies of a table, one a trial: they stay where they are unless the groups are too many to send.
    means = rows.groupBy(*own).agg(F.count("*").alias("m"), F.sum("w").alias("sw"), (F.sum(w * F.col("x")) / F.sum("w")).alias("xm"), (F.sum(w * F.col("y")) / F.sum("w")).alias("ym"))
    means = cut(means.filter(F.col("m") >= least_group).drop("m", "sw"))
    rows = alongside(rows, F.broadcast(means) if means.count() <= FEW else means, own).withColumn("u", F.col("x") - F.col("xm")).withColumn("v", F.col("y") - F.col("ym"))
    lines = rows.groupBy(*own).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(w * u * u).alias("sxx"), F.sum(w * u * v).alias("sxy"), F.sum(w * v * v).alias("syy"))
    lines = lines.withColumn("slope", F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))
    base = lines.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("syy") - F.col("slope") * F.col("sxy")).alias("c"))
    boxes, width = _by_bucket(cells, cadence)
    hit = rows.withColumn("bucket", F.floor(F.col("x") / width).cast("long")).join(F.broadcast(boxes), "bucket")
    hit = hit.withColumn("box", box_fraction(F.col("x") - F.col("offset"), F.col("duration"), cadence)).filter("box > 0")
    hit = hit.groupBy(*own, "cell", "duration", "offset").agg(F.sum(w * b).alias("sb"), F.sum(w * b * b).alias("sbb"), F.sum(w * u * b).alias("sxb"), F.sum(w * v * b).alias("svb"), F.count("*").alias("n_in"))
    hit = alongside(hit, lines.select(*own, "sw", "sxx", "slope"), own)
    rest = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("sw") - F.coalesce(F.try_divide(F.col("sxb") * F.col("sxb"), F.col("sxx")), F.lit(0.0))
    boxes = hit.groupBy(*by, "cell", "duration", "offset").agg(F.sum(F.col("svb") - F.col("slope") * F.col("sxb")).alias("a"), F.sum(rest).alias("b"), F.sum("n_in").alias("n_in"))
    return base, boxes


def box_fits(df: DataFrame, by: list[str], group: str | None, x: str, flux: str, error: str, cells: DataFrame, cadence: float, least: int = 10, least_group: int = 1, least_in: int = 1, floor: bool = True, tiny: float = 1e-9) -> DataFrame:
    """by, cell, duration, offset, depth, depth_error, chi2, gain, reduced, n, n_in for each trial box; gain is
    what the box takes off chi-square.

    The error is scaled by the reduced chi-square, not below 1 if floor. Boxes that intercept and
    slope can stand for have no depth and give no row.
    """
    base, boxes = box_sums(df, by, group, x, flux, error, cells, cadence, least_group)
    out = alongside(boxes, base, by).filter((F.col("n") >= least) & (F.col("n_in") >= least_in) & (F.col("b") > tiny))
    out = out.withColumn("depth", -F.col("a") / F.col("b")).withColumn("gain", F.col("a") * F.col("a") / F.col("b")).withColumn("chi2", F.col("c") - F.col("gain"))
    reduced = F.col("chi2") / F.greatest(F.lit(1), F.col("n") - 2 * F.col("groups") - 1)
    scale = F.greatest(F.lit(1.0), reduced) if floor else reduced
    return out.withColumn("reduced", reduced).withColumn("depth_error", F.sqrt(scale / F.col("b"))).select(*by, "cell", "duration", "offset", "depth", "depth_error", "chi2", "gain", "reduced", "n", "n_in")


def grid(spark, durations: list[float], offsets: list[float]) -> DataFrame:
    """cell, duration, offset: all pairs, numbered in that order."""
    return spark.createDataFrame([(i, d, o) for i, (d, o) in enumerate((d, o) for d in durations for o in offsets)], "cell int, duration double, offset double")


def best_boxes(fits: DataFrame, by: list[str], region: float = 2.30) -> DataFrame:
    """by with the fit that takes most off chi-square (to six decimals; the first cell of equal ones, as boxes over
    the same points are) and the durations and offsets whose rise in chi-square over it, scaled, is within region."""
    best = fits.groupBy(*by).agg(F.min(F.struct((-F.round("gain", 6)).alias("_r"), "cell", "gain", "chi2", "duration", "offset", "depth", "depth_error", "reduced", "n")).alias("f")).select(*by, "f.*").drop("_r")
    near = alongside(fits, best.select(*by, F.col("gain").alias("_g"), F.greatest(F.lit(1.0), "reduced").alias("_s")), by).filter((F.col("_g") - F.col("gain")) / F.col("_s") <= region)
    near = near.groupBy(*by).agg(F.min("duration").alias("duration_low"), F.max("duration").alias("duration_high"), F.min("offset").alias("offset_low"), F.max("offset").alias("offset_high"))
    return alongside(best, near, by)


def weighted_line(df: DataFrame, by: list[str], e: str, t: str, error: str) -> DataFrame:
    """Ephemeris t = t0 + period e by weights: reference cycle, t0, period, their variances and
    covariance (scaled by the reduced chi-square, not below 1), chi2 and n. Sums are about the means."""
    kin = Window.partitionBy(*by)
    w = 1 / (F.col(error) * F.col(error))
    rows = df.select(*by, F.col(e).cast("double").alias("e"), F.col(t).alias("t"), w.alias("w"))
    mean = lambda c: F.sum(F.col("w") * F.col(c)).over(kin) / F.sum("w").over(kin)
    rows = rows.withColumn("em", mean("e")).withColumn("tm", mean("t")).withColumn("u", F.col("e") - F.col("em")).withColumn("v", F.col("t") - F.col("tm"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), F.first("em").alias("em"), F.first("tm").alias("tm"), *[F.sum(F.col("w") * F.col(a) * F.col(b)).alias(a + b) for a, b in ("uu", "uv", "vv")]
    ).filter((F.col("n") >= 3) & (F.col("uu") > 0))
    out = sums.withColumn("reference", F.rint("em")).withColumn("period", F.col("uv") / F.col("uu"))
    out = out.withColumn("chi2", F.col("vv") - F.col("uv") * F.col("uv") / F.col("uu")).withColumn("s", F.greatest(F.lit(1.0), F.col("chi2") / F.greatest(F.lit(1), F.col("n") - 2)))
    gap = F.col("reference") - F.col("em")
    var_p = F.col("s") / F.col("uu")
    return out.select(*by, "reference", (F.col("tm") + F.col("period") * gap).alias("t0"), "period", (F.col("s") / F.col("sw") + gap * gap * var_p).alias("var_t0"), var_p.alias("var_period"), (gap * var_p).alias("cov"), "chi2", "n")


def predicted(df: DataFrame, cycle: Column) -> DataFrame:
    """weighted_line() rows with the time of a cycle and its error."""
    e = cycle - F.col("reference")
    return df.withColumn("time", F.col("t0") + e * F.col("period")).withColumn("time_error", F.sqrt(F.col("var_t0") + e * e * F.col("var_period") + 2 * e * F.col("cov")))


def quadratic_baseline(df: DataFrame, by: list[str], x: str, y: str, least: int = 20, out: str = "baseline", used: Column | None = None) -> DataFrame:
    """df with the unweighted quadratic in x fitted to each group, to its used rows if a condition is
    given; null for groups of fewer than `least` of these.

    Powers are made orthogonal one after the other within the group.
    """
    kin = Window.partitionBy(*by)
    own = (lambda e: F.when(used, e)) if used is not None else (lambda e: e)
    mean, total = (lambda e: F.avg(own(e)).over(kin)), (lambda e: F.sum(own(e)).over(kin))
    rows = df.withColumn("_u", F.col(x) - mean(F.col(x))).withColumn("_q", F.col("_u") * F.col("_u"))
    rows = rows.withColumn("_v", F.col("_q") - mean(F.col("_q")) - F.col("_u") * F.try_divide(total(F.col("_q") * F.col("_u")), total(F.col("_q"))))
    fit = mean(F.col(y)) + F.col("_u") * F.try_divide(total(F.col("_u") * F.col(y)), total(F.col("_u") * F.col("_u"))) + F.col("_v") * F.try_divide(total(F.col("_v") * F.col(y)), total(F.col("_v") * F.col("_v")))
    return rows.withColumn(out, F.when(F.count(own(F.lit(1))).over(kin) >= least, fit)).drop("_u", "_q", "_v")


def local_depth(df: DataFrame, by: list[str], x: str, y: str, used: Column, inside: Column, least: int = 20) -> DataFrame:
    """by, n (used rows), depth_ppm (1 less the median inside, over a quadratic through the used rows)
    and scatter_ppm (population deviation of these)."""
    rows = quadratic_baseline(df, by, x, y, least, "_b", used).filter("_b is not null").withColumn("_f", F.try_divide(F.col(y), F.col("_b")))
    depth = (1 - F.percentile(F.when(inside, F.col("_f")), 0.5)) * 1e6
    return rows.groupBy(*by).agg(F.count_if(used).alias("n"), depth.alias("depth_ppm"), (F.stddev_pop(F.when(used, F.col("_f"))) * 1e6).alias("scatter_ppm"))
