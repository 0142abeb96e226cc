"""Operators on image stamps: one row a stamp with its pixels in an array, row by row.

Pixels are exploded to rows (stamp, pos) and grouped; y is pos div width and x the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylathe.functions.expr import MAD_SCALE
from skylathe.operators.cuts import cut
from skylathe.operators.stats import centre_and_noise, mad_raw, median


def pixels(df: DataFrame, keep: list[str], image: str, width: int) -> DataFrame:
    """keep, y, x, value: a row for each pixel."""
    out = df.select(*keep, F.posexplode(image).alias("pos", "value"))
    return out.select(*keep, F.expr(f"pos div {width}").cast("int").alias("y"), F.expr(f"pos % {width}").cast("int").alias("x"), F.col("value").cast("double").alias("value"))


def distance(cx: float, cy: float) -> Column:
    return F.hypot(F.col("x") - cx, F.col("y") - cy)


def median_stack(px: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x, value: pixel by pixel median over stamps."""
    return px.groupBy(*by, "y", "x").agg(median(F.col("value")).alias("value"))


def ring_background(px: DataFrame, by: list[str], cx: float, cy: float, inner: float, outer: float) -> DataFrame:
    """by, background, background_error: the median of the ring's pixels, and the error of a median
    (1.253 of a mean's) from the pixels' own errors."""
    ring = px.filter((distance(cx, cy) > inner) & (distance(cx, cy) <= outer))
    error = F.lit(1.253) * F.sqrt(F.sum(F.col("error") * F.col("error"))) / F.count("*")
    return ring.groupBy(*by).agg(median(F.col("value")).alias("background"), error.alias("background_error"))


def apertures(px: DataFrame, by: list[str], cx: float, cy: float, radii: list[float], inner: float, outer: float) -> DataFrame:
    """by, radius, flux, background, background_error, n, quality for each radius, of px with value and
    error: sum within it less the ring's background, 1 in quality if a pixel of it is unknown."""
    sky = ring_background(px, by, cx, cy, inner, outer)
    disc = px.filter(distance(cx, cy) <= max(radii)).select(*by, "value", F.explode(F.filter(F.array(*map(F.lit, radii)), lambda r: distance(cx, cy) <= r)).alias("radius"))
    sums = disc.groupBy(*by, "radius").agg(F.sum("value").alias("sum"), F.count("value").alias("n"), F.count("*").alias("all"))
    out = sums.join(sky, by)
    return out.select(*by, "radius", (F.col("sum") - F.col("n") * F.col("background")).alias("flux"), "background", "background_error", "n", (F.col("n") < F.col("all")).cast("int").alias("quality"))


def centroid(px: DataFrame, by: list[str], within: tuple[float, float, float] | None = None) -> DataFrame:
    """by, total, cx, cy, fwhm: moments of what is positive, of pixels within a circle (x, y, radius) if
    one is given; 2.355 deviations across. Null without anything positive."""
    w = F.greatest(F.col("value"), F.lit(0.0))
    w = F.when(distance(within[0], within[1]) <= within[2], w).otherwise(0.0) if within else w
    sums = px.groupBy(*by).agg(F.sum(w).alias("total"), *[F.sum(w * e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("rr", F.col("x") * F.col("x") + F.col("y") * F.col("y")))])
    cx, cy = F.try_divide("sx", "total"), F.try_divide("sy", "total")
    spread = F.greatest(F.try_divide("rr", "total") - cx * cx - cy * cy, F.lit(0.0)) / 2
    return sums.select(*by, "total", cx.alias("cx"), cy.alias("cy"), (F.sqrt(spread) * 2.355).alias("fwhm"))


def event_differences(px: DataFrame, by: list[str], event: str, stamp: str, inside: Column, outside: Column, cx: float, cy: float, radius: float, ring: tuple[float, float], least_in: int = 2, least_out: int = 4) -> DataFrame:
    """by, event, y, x, value: an event's median image outside less that inside, both free of each
    stamp's ring background, over the outside image's flux within radius. Events with fewer stamps on
    a side than the least, or without positive flux, give nothing."""
    sky = px.filter((distance(cx, cy) > ring[0]) & (distance(cx, cy) <= ring[1])).groupBy(*by, stamp).agg(median(F.col("value")).alias("_sky"))
    flat = px.join(sky, [*by, stamp]).withColumn("_v", F.col("value") - F.col("_sky"))
    inn, out = F.when(inside, F.col("_v")), F.when(outside, F.col("_v"))
    each = flat.groupBy(*by, event, "y", "x").agg(F.count(inn).alias("i"), F.count(out).alias("o"), median(inn).alias("inn"), median(out).alias("out"))
    each = each.filter((F.col("i") >= least_in) & (F.col("o") >= least_out))
    scale = each.filter(distance(cx, cy) <= radius).groupBy(*by, event).agg(F.sum("out").alias("_flux")).filter("_flux > 0")
    return each.join(scale, [*by, event]).select(*by, event, "y", "x", ((F.col("out") - F.col("inn")) / F.col("_flux")).alias("value"))


def difference_image(differences: DataFrame, by: list[str], least_events: int = 3) -> DataFrame:
    """by, y, x, value, events: pixel by pixel median over event_differences() of enough events."""
    return differences.groupBy(*by, "y", "x").agg(F.count("*").alias("events"), median(F.col("value")).alias("value")).filter(F.col("events") >= least_events)


def drawn(draw: Column, slot: Column, n: Column, seed: int = 7919) -> Column:
    """A number from 0 to n - 1 for a slot of a draw, by two rounds of a linear congruence modulo 2^32.
    It isn't any library's generator, so draws differ from those of another program."""
    m = F.lit(1 << 32)
    a = (draw * 1103515245 + slot * 12345 + seed) % m
    b = ((a * 1664525 + 1013904223) % m * 1664525 + 1013904223) % m
    return F.floor(b / 65536) % n


def bootstrap_centroids(differences: DataFrame, by: list[str], event: str, within: tuple[float, float, float], draws: int = 600) -> DataFrame:
    """by, cx, cy, radius: centroid of the difference image, and the radius that holds 68.27 % of the
    centroids of resampled stacks. Each draw takes as many events as there are, with replacement; its
    image is the pixel by pixel median of theirs. A draw is a group, so draws spread over the cluster."""
    numbered = differences.select(*by, event).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(event)) - 1)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("_n"))
    slots = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw")).select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("_slot"))
    slots = slots.select(*by, "_draw", drawn(F.col("_draw").cast("long"), F.col("_slot").cast("long"), F.col("_n")).cast("int").alias("_i"))
    taken = slots.join(numbered, [*by, "_i"]).join(differences, [*by, event])
    samples = centroid(taken.groupBy(*by, "_draw", "y", "x").agg(median(F.col("value")).alias("value")), [*by, "_draw"], within)
    whole = centroid(median_stack(differences, by), by, within).select(*by, "cx", "cy")
    off = samples.select(*by, F.col("cx").alias("_x"), F.col("cy").alias("_y")).join(whole, by).withColumn("_d", F.hypot(F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy")))
    return off.groupBy(*by, "cx", "cy").agg(F.percentile("_d", 0.6827).alias("radius"))


def shifted(px: DataFrame, by: list[str], dy: int, dx: int, height: int, width: int, fill: float) -> DataFrame:
    """by, y, x, value: every stamp moved by whole pixels, fill where nothing comes from."""
    every = px.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("p"))
    every = every.select(*by, F.expr(f"p div {width}").cast("int").alias("y"), F.expr(f"p % {width}").cast("int").alias("x"))
    moved = px.select(*by, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "value")
    return every.join(moved, [*by, "y", "x"], "left").select(*by, "y", "x", F.coalesce("value", F.lit(float(fill))).alias("value"))


def radial_profile(px: DataFrame, by: list[str], cx: float, cy: float, step: float = 0.5) -> DataFrame:
    """by, bin, radius, value: medians in rings of step."""
    r = distance(cx, cy)
    return px.withColumn("r", r).groupBy(*by, F.floor(F.col("r") / step).alias("bin")).agg(median(F.col("r")).alias("radius"), median(F.col("value")).alias("value"))


def half_width(profile: DataFrame, by: list[str]) -> DataFrame:
    """by, fwhm: twice the first radius over 1 at which the profile is at half its first value or below."""
    first = profile.groupBy(*by).agg(F.min_by("value", "bin").alias("top"))
    low = profile.join(first, by).filter((F.col("radius") > 1) & (F.col("value") <= F.col("top") / 2))
    return first.select(*by).join(low.groupBy(*by).agg((F.min_by("radius", "bin") * 2).alias("fwhm")), by, "left")


def calibrated(raw: DataFrame, dark: DataFrame, flat: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x, value, doubtful: (raw - dark) / flat in single precision, and flats off 0.5 to 1.5."""
    out = raw.join(dark.withColumnRenamed("value", "dark"), ["y", "x"]).join(flat.withColumnRenamed("value", "flat"), ["y", "x"])
    value = F.try_divide((F.col("value") - F.col("dark")), F.col("flat")).cast("float")
    return out.select(*by, "y", "x", value.alias("value"), ((F.col("flat") < 0.5) | (F.col("flat") > 1.5)).alias("doubtful"))


def field_signature(px: DataFrame, by: list[str], height: int, width: int, stride: int = 8, sigmas: float = 5.0, cap: float = 0.995, border: int = 2, least: int = 20) -> DataFrame:
    """by, y, x, value of every stride-th pixel: what stands out of the frame's centre by so many robust
    deviations, no more than the percentile of what does, 0 on the border (counted in sampled pixels).
    Frames with fewer such pixels than `least` give nothing."""
    own = px.filter((F.col("y") % stride == 0) & (F.col("x") % stride == 0)).withColumn("y", F.expr(f"y div {stride}").cast("int")).withColumn("x", F.expr(f"x div {stride}").cast("int"))
    level = centre_and_noise(own, by, "value")
    rows = own.join(level, by).withColumn("value", F.greatest(F.col("value") - F.col("centre") - sigmas * F.col("noise"), F.lit(0.0)))
    most = rows.filter("value > 0").groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("value", cap).alias("_cap")).filter(F.col("_n") >= least)
    h, w = -(-height // stride), -(-width // stride)
    inside = F.col("y").between(border, h - 1 - border) & F.col("x").between(border, w - 1 - border)
    return rows.join(most, by).select(*by, "y", "x", F.when(inside, F.least("value", "_cap")).otherwise(0.0).alias("value"))


def calibration_check(written: DataFrame, raw: DataFrame, dark: DataFrame, flat: DataFrame, by: str, every: int = 64) -> DataFrame:
    """by, n, exact, largest: of about one pixel in `every`, spread over all frames alike, how many of the
    written values were held against the formula, whether all are equal, and the largest difference."""
    pick = (F.col(by) * 7 + F.col("y") * 31 + F.col("x") * 17) % every == 0
    want = calibrated(raw.filter(pick), dark, flat, [by]).select(by, "y", "x", F.col("value").alias("_want"))
    both = want.join(written.select(by, "y", "x", "value"), [by, "y", "x"], "left")
    off = F.abs(F.col("value").cast("double") - F.col("_want").cast("double"))
    return both.groupBy(by).agg(F.count("*").alias("n"), F.bool_and(F.col("value").eqNullSafe(F.col("_want"))).alias("exact"), F.max(off).alias("largest"))


def shift_check(moved: DataFrame, original: DataFrame, by: list[str], dy: int, dx: int, step: int, fill: float) -> DataFrame:
    """by, n, exact, filled: pixels of a grid of step in the moved images, whether each equals the one it
    came from, and how many have nothing to come from and hold the fill."""
    grid = moved.filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).select(*by, "y", "x", F.col("value").alias("_moved"))
    source = original.select(*by, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("value").alias("_own"), F.lit(True).alias("_there"))
    both = grid.join(source, [*by, "y", "x"], "left")
    same = F.when(F.col("_there"), F.col("_moved").eqNullSafe(F.col("_own"))).otherwise(F.col("_moved") == fill)
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(same).alias("exact"), F.count_if(F.col("_there").isNull()).alias("filled"))


def frame_summary(px: DataFrame, by: list[str], stride: int, saturated: float, low: float) -> DataFrame:
    """by, thumbnail (pixels of every stride-th row and column), saturated and low (shares of pixels at
    or over the one level, and under the other)."""
    share = lambda c: F.avg(c.cast("double"))
    own = (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    return px.groupBy(*by).agg(F.count_if(own).alias("thumbnail"), share(F.col("value") >= saturated).alias("saturated"), share(F.col("value") < low).alias("low"))


def crop(px: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """px within a rectangle, counted from its corner."""
    inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    return px.filter(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def flat_field(flats: DataFrame, dark: DataFrame, frame: str, height: int, width: int) -> DataFrame:
    """y, x, value: dark (y, x, value) taken from each flat frame, its plane divided out, each over its
    mean, the median of all over its mean. Frames whose plane or mean isn't positive take no part;
    pixels of the result that aren't positive are null."""
    raw = flats.join(dark.withColumnRenamed("value", "_dark"), ["y", "x"]).select(frame, "y", "x", (F.col("value") - F.col("_dark")).alias("value"))
    fit = plane(raw, [frame], height, width).drop("n")
    u, v = 2.0 * F.col("x") / max(width - 1, 1) - 1.0, 2.0 * F.col("y") / max(height - 1, 1) - 1.0
    rows = raw.join(fit, frame).withColumn("_p", F.col("level") + F.col("slope_x") * u + F.col("slope_y") * v)
    kin = Window.partitionBy(frame)
    rows = rows.withColumn("_least", F.min("_p").over(kin)).withColumn("_level", F.avg("_p").over(kin)).filter("_least > 0")
    rows = rows.withColumn("value", F.col("value") * F.col("_level") / F.col("_p")).withColumn("_mean", F.avg("value").over(kin)).filter("_mean > 0")
    stack = rows.groupBy("y", "x").agg(median(F.col("value") / F.col("_mean")).alias("value"))
    mean = stack.agg(F.avg("value").alias("_m"))
    return stack.join(F.broadcast(mean), F.lit(True)).select("y", "x", F.when(F.col("value") / F.col("_m") > 0, F.col("value") / F.col("_m")).alias("value"))


def plane(px: DataFrame, by: list[str], height: int, width: int, rounds: int = 3, sigmas: float = 4.0, tails: float = 0.002, least: int = 1) -> DataFrame:
    """by, level, slope_x, slope_y, n: a plane fitted to the pixels over coordinates from -1 to 1.

    Pixels outside the percentiles of the tails take no part in the first fit, those further from the
    fit than so many robust deviations of the pixels in use none in the next; n is how many are left
    after the last. Groups of fewer than `least` known pixels give nothing. A round is one grouped
    aggregate.
    """
    side = lambda c, n: 2.0 * F.col(c) / max(n - 1, 1) - 1.0
    rows = px.filter(F.col("value").isNotNull()).select(*by, side("x", width).alias("u"), side("y", height).alias("v"), F.col("value").alias("z"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("known"), F.percentile("z", tails).alias("low"), F.percentile("z", 1 - tails).alias("high")).filter(F.col("known") >= least)
    rows = rows.join(ends, by).select(*by, "u", "v", "z", F.col("z").between(F.col("low"), F.col("high")).alias("use"))
    fit = None
    for _ in range(rounds):  # each round is cut, or the next would compute it anew three times over
        fit = _plane_fit(rows.filter("use"), by)
        res = rows.join(fit, by).withColumn("e", F.col("z") - F.col("level") - F.col("slope_x") * F.col("u") - F.col("slope_y") * F.col("v"))
        spread = mad_raw(res.filter("use"), by, F.col("e")).select(*by, "mad")
        # without spread the fit is final
        rows = res.join(spread, by).withColumn("use", F.when(F.col("mad") > 0, F.abs("e") <= F.col("mad") * sigmas).otherwise(F.col("use"))).select(*by, "u", "v", "z", "use")
        fit, rows = cut(fit), cut(rows)
    return fit.join(rows.groupBy(*by).agg(F.count_if("use").alias("n")), by)


def _plane_fit(rows: DataFrame, by: list[str]) -> DataFrame:
    kin = Window.partitionBy(*by)
    rows = rows.withColumns({f"c{c}": F.col(c) - F.avg(c).over(kin) for c in "uvz"})
    sums = [F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(a + b) for a, b in ("uu", "vv", "uv", "uz", "vz")]
    m = rows.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in "uvz"], *sums)
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    m = m.withColumn("slope_x", F.try_divide(F.col("vv") * F.col("uz") - F.col("uv") * F.col("vz"), det)).withColumn("slope_y", F.try_divide(F.col("uu") * F.col("vz") - F.col("uv") * F.col("uz"), det))
    return m.select(*by, (F.col("mz") - F.col("slope_x") * F.col("mu") - F.col("slope_y") * F.col("mv")).alias("level"), "slope_x", "slope_y")


def fft_shifts(df: DataFrame, key: str, image: str, reference: list[float], height: int, width: int) -> DataFrame:
    """key, dy, dx: the whole-pixel shift of each stamp against a reference, at the peak of their phase
    correlation. A stamp is independent of all others, so this is one map."""
    base = np.conj(np.fft.fft2(np.asarray(reference, float).reshape(height, width)))

    @F.pandas_udf("dy int, dx int")
    def shift(stamps: pd.Series) -> pd.DataFrame:
        out = []
        for s in stamps:
            if s is None or len(s) != height * width:
                out.append((None, None))
                continue
            cross = np.fft.fft2(np.asarray(s, float).reshape(height, width)) * base
            power = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
            dy, dx = np.unravel_index(power.argmax(), power.shape)
            out.append((dy - height * (dy > height // 2), dx - width * (dx > width // 2)))
        return pd.DataFrame(out, columns=["dy", "dx"]).astype("Int32")

    return df.select(key, shift(F.col(image)).alias("s")).select(key, "s.dy", "s.dx")


def local_maxima(px: DataFrame, by: list[str], reach: int, above: float, below: float, tile: int = 256) -> DataFrame:
    """by, y, x, value: pixels over `above` and under `below` that no pixel within reach exceeds; of
    equal ones the first.

    Frames are cut into tiles that hold `reach` pixels of their neighbours; a tile's maxima are taken along rows and then
    columns, so a pixel costs two passes, not a square. Pixels without value exceed none. A tile with its border is all that a task holds.
    """
    on = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int"))
    rows = px.filter("value is not null and y is not null and x is not null").select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    rows = rows.select("*", F.explode(on("y")).alias("_ty")).select("*", F.explode(on("x")).alias("_tx"))

    def along(image: np.ndarray, axis: int) -> np.ndarray:
        """Largest value within reach along an axis: windows of doubling width, then two that cover the whole."""
        width, done = 2 * reach + 1, 1
        out = image
        cut = lambda a, i, n: a[i : i + n] if axis == 0 else a[:, i : i + n]
        while 2 * done <= width:
            n = out.shape[axis] - done
            out, done = np.maximum(cut(out, 0, n), cut(out, done, n)), 2 * done
        n = image.shape[axis] - width + 1
        return np.maximum(cut(out, 0, n), cut(out, width - done, n))

    def maxima(group: pa.Table) -> pa.Table:
        at_y, at_x, v = group["y"].to_numpy(), group["x"].to_numpy(), group["value"].to_numpy()
        inner = (at_y // tile == group["_ty"][0].as_py()) & (at_x // tile == group["_tx"][0].as_py()) & (v > above) & (v < below)
        y, x = at_y - at_y.min() + reach, at_x - at_x.min() + reach
        image = np.full((y.max() + reach + 1, x.max() + reach + 1), -np.inf)  # as large as what there is of the tile
        image[y, x] = v
        most = along(along(image, 0), 1)
        first = []
        for i in np.flatnonzero(inner):
            if v[i] == most[y[i] - reach, x[i] - reach]:
                equal = np.argwhere(image[y[i] - reach : y[i] + reach + 1, x[i] - reach : x[i] + reach + 1] == v[i])[0]
                if tuple(equal) == (reach, reach):
                    first.append(i)
        return group.take(pa.array(first, pa.int64())).drop(["_ty", "_tx"])

    return rows.groupBy(*by, "_ty", "_tx").applyInArrow(maxima, rows.drop("_ty", "_tx").schema)


def _high_pass(image: np.ndarray, smooth: float, low: float = 1.0, high: float = 99.7) -> np.ndarray:
    """The image less a Gaussian mean of it, clipped at two percentiles, of mean 0 and deviation 1; zero if it has none."""
    def blurred(a: np.ndarray, axis: int) -> np.ndarray:
        reach = max(1, int(4 * smooth + 0.5))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / smooth) ** 2)
        edge = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in range(2)], mode="symmetric")
        return np.apply_along_axis(lambda v: np.convolve(v, kernel / kernel.sum(), "valid"), axis, edge)

    out = image - blurred(blurred(image, 0), 1) if smooth > 0 else image
    out = np.clip(out, *np.percentile(out, [low, high]))
    spread = out.std()
    return (out - out.mean()) / spread if spread > 0 else np.zeros_like(out)


def _peak_shift(reference: np.ndarray, moving: np.ndarray, upsample: int) -> tuple[float, float]:
    """How far moving lies from reference: the peak of their phase correlation, refined on a grid of 1 / upsample
    pixels about it by a transform of that patch alone (Guizar-Sicairos, Thurman & Fienup 2008)."""
    cross = np.fft.fft2(moving) * np.conj(np.fft.fft2(reference))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    shape = np.array(cross.shape)
    peak = np.array(np.unravel_index(np.abs(np.fft.ifft2(cross)).argmax(), cross.shape)).astype(float)
    peak -= shape * (peak > shape // 2)
    if upsample > 1:
        fine = np.arange(-upsample, upsample + 1) / upsample
        wave = lambda k, at: np.exp(2j * np.pi * np.outer(at, np.fft.fftfreq(shape[k])))
        patch = np.abs(wave(0, peak[0] + fine) @ cross @ wave(1, peak[1] + fine).T)
        if patch.max() > patch[upsample, upsample] * (1 + 1e-9):  # else the whole pixel stands
            peak = peak + fine[list(np.unravel_index(patch.argmax(), patch.shape))]
    return float(peak[0]), float(peak[1])


def registered(px: DataFrame, frame: str, first, height: int, width: int, bin_: int = 8, smooth: float = 12.0, upsample: int = 2) -> DataFrame:
    """frame, dy, dx: how many pixels each frame lies off the frame `first`, to bin_ / upsample of one.

    Frames are averaged to bins, which add up ahead of the shuffle; a binned frame, of at most height x width /
    bin_^2 values, is what one task holds. It is freed of what is smoother than `smooth` bins, clipped, and
    held against the first one. Missing pixels count as the frame's mean; frames without pixels give nothing.
    """
    h, w = height // bin_, width // bin_
    own = px.filter(f"value is not null and y >= 0 and x >= 0 and y < {h * bin_} and x < {w * bin_}")
    bins = own.groupBy(frame, F.floor(F.col("y") / bin_).cast("int").alias("y"), F.floor(F.col("x") / bin_).cast("int").alias("x")).agg(F.avg("value").alias("value"))

    def image(y: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.full((h, w), value.mean())
        out[y, x] = value
        return _high_pass(out, smooth)

    start = bins.filter(F.col(frame) == F.lit(first)).select("y", "x", "value").toPandas()  # one binned frame
    if start.empty:
        raise ValueError(f"there is no frame {first!r}")
    reference = image(*(start[c].to_numpy() for c in ("y", "x", "value")))

    def shift(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dy, dx = _peak_shift(reference, image(*(rows[c].to_numpy() for c in ("y", "x", "value"))), upsample)
        return pd.DataFrame({frame: [key[0]], "dy": [dy * bin_], "dx": [dx * bin_]})

    return bins.groupBy(frame).applyInPandas(shift, f"`{frame}` {px.schema[frame].dataType.simpleString()}, dy double, dx double")


def overlap_weights(height: int, width: int, cx: float, cy: float, radius: float) -> list[tuple[int, int, float]]:
    """y, x and the exact share of each pixel inside a circle, for the pixels that it touches. Pixel
    centres are whole numbers. The area is the integral of the chord's height over the pixel."""

    def under(x: np.ndarray, level: float) -> np.ndarray:
        """Integral from 0 to x of min(level, half chord)."""
        edge = np.sqrt(max(radius * radius - level * level, 0.0)) if abs(level) < radius else 0.0
        arc = lambda v: 0.5 * (v * np.sqrt(np.maximum(radius * radius - v * v, 0)) + radius * radius * np.arcsin(np.clip(v / radius, -1, 1)))
        v = np.clip(x, -radius, radius)
        flat = np.clip(v, -edge, edge)
        return flat * level + arc(v) - arc(flat)

    def above(a, b, low: float, high: float) -> float:
        """Area of the upper half disc between a and b, low and high (both at least 0)."""
        part = lambda level: float(under(np.array(b), level) - under(np.array(a), level))
        return part(high) - part(low)

    out = []
    for y in range(max(0, int(cy - radius - 1)), min(height, int(cy + radius + 2))):
        for x in range(max(0, int(cx - radius - 1)), min(width, int(cx + radius + 2))):
            a, b, low, high = x - 0.5 - cx, x + 0.5 - cx, y - 0.5 - cy, y + 0.5 - cy
            area = above(a, b, max(low, 0), max(high, 0)) + above(a, b, max(-high, 0), max(-low, 0))
            if area > 1e-12:
                out.append((y, x, min(area, 1.0)))
    return out


def exact_aperture(px: DataFrame, by: list[str], height: int, width: int, cx: float, cy: float, radius: float, inner: float, outer: float, sigmas: float = 3.0, rounds: int = 5) -> DataFrame:
    """by, flux, background: sum by exact overlap less the clipped median of the ring times the area.
    A round of clipping is one grouped aggregate."""
    weights = px.sparkSession.createDataFrame(overlap_weights(height, width, cx, cy, radius), "y int, x int, weight double")
    sums = px.join(F.broadcast(weights), ["y", "x"]).groupBy(*by).agg(F.sum(F.col("value") * F.col("weight")).alias("sum"), F.sum("weight").alias("area"))
    ring = px.filter((distance(cx, cy) > inner) & (distance(cx, cy) <= outer)).select(*by, "value")
    kin = Window.partitionBy(*by)
    for _ in range(rounds):
        rows = ring.withColumn("_m", median(F.col("value")).over(kin)).withColumn("_d", F.abs(F.col("value") - F.col("_m"))).withColumn("_s", median(F.col("_d")).over(kin) * MAD_SCALE)
        ring = rows.filter((F.col("_d") <= F.col("_s") * sigmas) | (F.col("_s") == 0)).select(*by, "value")
    sky = ring.groupBy(*by).agg(median(F.col("value")).alias("background"))
    return sums.join(sky, by).select(*by, (F.col("sum") - F.col("area") * F.col("background")).alias("flux"), "background")
