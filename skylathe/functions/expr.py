"""Column expressions of the time-series and photometry operators."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turns a median absolute deviation into a standard deviation of Gaussian noise.
MAD_SCALE = 1.4826
#: Microseconds of a day.
DAY_US = 86_400_000_000.0


def days(ts: Column) -> Column:
    """Days since the epoch of a timestamp, as double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(DAY_US)


def finite(x: Column) -> Column:
    """x with NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def good(flux: Column, error: Column, quality: Column) -> Column:
    """Whether a cadence is usable: flux and a positive error known, no quality bit set."""
    return F.coalesce(finite(flux).isNotNull() & (finite(error) > 0) & (quality == 0), F.lit(False))


def floor_mod(x: Column, y: Column | float) -> Column:
    """x modulo y with the sign of y."""
    return F.pmod(x, y if isinstance(y, Column) else F.lit(float(y)))


def phase(t: Column, t0: float, period: float) -> Column:
    """Time from the nearest event, from -period / 2 up to but not including period / 2."""
    return floor_mod(t - t0 + period / 2, period) - period / 2


def cycle(t: Column, t0: float, period: float) -> Column:
    """Number of the nearest event, halves to even; an unknown time counts as cycle 0."""
    return F.coalesce(F.rint((finite(t) - t0) / period), F.lit(0.0)).cast("long")


def orbital_phase(t: Column, t0: float, period: float) -> Column:
    """Phase from 0 up to but not including 1."""
    return floor_mod((t - t0) / period, 1.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def box_fraction(dt: Column, duration: Column | float, cadence: Column | float) -> Column:
    """Share of an exposure of length cadence, centred dt from mid-event, inside the event; null
    unless duration and cadence are positive."""
    d, c = (x if isinstance(x, Column) else F.lit(float(x)) for x in (duration, cadence))
    overlap = F.least(dt + c / 2, d / 2) - F.greatest(dt - c / 2, -d / 2)
    return F.when((d > 0) & (c > 0), clip(F.try_divide(overlap, c), 0, 1))


def window_fraction(t: Column, start: float, end: float, cadence: float) -> Column:
    """Share of an exposure centred at t inside the window from start to end."""
    return clip((F.least(t + cadence / 2, F.lit(end)) - F.greatest(t - cadence / 2, F.lit(start))) / cadence, 0, 1)


def flux_ratio(delta_mag: Column) -> Column:
    """Flux ratio of a magnitude difference."""
    return F.pow(F.lit(10.0), delta_mag * F.lit(-0.4))


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle between two sky positions in degrees, by the haversine. Degrees are subtracted before they are turned into
    radians, which rounds less, so that positions to either side of another are equally far if their degrees are."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return F.degrees(F.asin(F.sqrt(clip(h, 0, 1)))) * 2 * 3600


def position_tan(x: Column, y: Column, crval: tuple, crpix: tuple, cd: tuple) -> tuple[Column, Column]:
    """Right ascension and declination in degrees of a pixel, by a gnomonic projection."""
    u, v = x - crpix[0], y - crpix[1]
    xi, eta = F.radians(u * cd[0] + v * cd[1]), F.radians(u * cd[2] + v * cd[3])
    d0 = math.radians(crval[1])
    below = F.lit(math.cos(d0)) - eta * math.sin(d0)
    ra = F.pmod(F.degrees(F.atan2(xi, below)) + crval[0], F.lit(360.0))
    dec = F.degrees(F.atan2(F.lit(math.sin(d0)) + eta * math.cos(d0), F.hypot(xi, below)))
    return ra, dec


def joined_reasons(sep: str = "; ", **reasons: Column) -> Column:
    """The names of the reasons that hold, in the order given; empty if none does."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for name, cond in reasons.items()])


def set_bits(vector: Column, offset: int = 0) -> Column:
    """Positions of the ones in a string of zeros and ones, counted from offset, joined by ;"""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(vector), F.lit(1))), lambda i: F.substring(vector, i, F.lit(1)) == "1")
    return F.array_join(F.transform(at, lambda i: (i - 1 + offset).cast("string")), ";")


def header_value(key: str, *headers: Column, default: str | None = None) -> Column:
    """The first header map's value of a key, else the default."""
    return F.coalesce(*[F.try_element_at(h, F.lit(key)) for h in headers], F.lit(default))


def sun_altitude_terms(day: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the Sun in degrees, low precision (about 0.01 degrees),
    from days since J2000.0 (Astronomical Almanac)."""
    mean = F.radians(F.lit(357.528) + day * 0.9856003)
    lon = F.radians(F.lit(280.460) + day * 0.9856474 + F.sin(mean) * 1.915 + F.sin(mean * 2) * 0.020)
    tilt = F.radians(F.lit(23.439) - day * 4e-7)
    return F.degrees(F.atan2(F.cos(tilt) * F.sin(lon), F.cos(lon))), F.degrees(F.asin(F.sin(tilt) * F.sin(lon)))


def altitude(ra: Column, dec: Column, day: Column, latitude: float, longitude: float) -> Column:
    """Altitude in degrees at a place on Earth, longitude east, of a position at days since J2000.0."""
    sidereal = F.lit(280.46061837) + day * 360.98564736629 + longitude
    hour = F.radians(sidereal - ra)
    lat, d = math.radians(latitude), F.radians(dec)
    return F.degrees(F.asin(clip(F.sin(d) * math.sin(lat) + F.cos(d) * F.cos(hour) * math.cos(lat), -1, 1)))


def pixel_tan(ra: Column, dec: Column, crval: tuple, crpix: tuple, cd: tuple) -> tuple[Column, Column]:
    """The pixel of a sky position, the inverse of position_tan(); null on the far half of the sky."""
    d0, dec, a = math.radians(crval[1]), F.radians(dec), F.radians(ra - crval[0])
    towards = F.sin(dec) * math.sin(d0) + F.cos(dec) * math.cos(d0) * F.cos(a)
    towards = F.when(towards > 0, towards)
    xi = F.degrees(F.cos(dec) * F.sin(a) / towards)
    eta = F.degrees((F.sin(dec) * math.cos(d0) - F.cos(dec) * math.sin(d0) * F.cos(a)) / towards)
    det = cd[0] * cd[3] - cd[1] * cd[2]
    return (xi * cd[3] - eta * cd[1]) / det + crpix[0], (eta * cd[0] - xi * cd[2]) / det + crpix[1]


def _polynomial(u: Column, v: Column, terms: dict[tuple[int, int], float]) -> Column:
    """Sum of terms[p, q] u^p v^q."""
    power = lambda x, n: functools.reduce(lambda a, b: a * b, [x] * n) if n else F.lit(1.0)
    return functools.reduce(lambda a, b: a + b, [power(u, p) * power(v, q) * c for (p, q), c in sorted(terms.items())], F.lit(0.0))


def position_sip(x: Column, y: Column, crval: tuple, crpix: tuple, cd: tuple, a: dict, b: dict) -> tuple[Column, Column]:
    """position_tan() of a pixel moved by the distortion polynomials a and b (SIP: coefficients by the powers of
    the offsets from crpix)."""
    u, v = x - crpix[0], y - crpix[1]
    return position_tan(x + _polynomial(u, v, a), y + _polynomial(u, v, b), crval, crpix, cd)


def pixel_sip(ra: Column, dec: Column, crval: tuple, crpix: tuple, cd: tuple, a: dict, b: dict, rounds: int = 10) -> tuple[Column, Column]:
    """The pixel of a sky position, the inverse of position_sip(): pixel_tan() and a fixed point of so many rounds,
    which each gain as many digits as the distortion is small; null on the far half of the sky."""
    px, py = pixel_tan(ra, dec, crval, crpix, cd)
    ideal = F.struct((px - crpix[0]).alias("u"), (py - crpix[1]).alias("v"))
    state = F.struct(ideal["u"].alias("iu"), ideal["v"].alias("iv"), ideal["u"].alias("u"), ideal["v"].alias("v"))
    step = lambda s, _: F.struct(s["iu"].alias("iu"), s["iv"].alias("iv"), (s["iu"] - _polynomial(s["u"], s["v"], a)).alias("u"), (s["iv"] - _polynomial(s["u"], s["v"], b)).alias("v"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step)
    return found["u"] + crpix[0], found["v"] + crpix[1]


def pointing_shift(ra: Column, dec: Column, first: tuple[float, float], arcsec_a_pixel: float, factor: tuple[float, float]) -> tuple[Column, Column]:
    """Shift in pixels of a pointing against the first one, turned and scaled by a complex factor."""
    off = F.pmod(ra - first[0] + 180, F.lit(360.0)) - 180
    u, v = -off * math.cos(math.radians(first[1])) * 3600 / arcsec_a_pixel, -(dec - first[1]) * 3600 / arcsec_a_pixel
    return u * factor[0] - v * factor[1], u * factor[1] + v * factor[0]


def pipeline_of(name: Column) -> Column:
    """Pipeline that a file name tells; null for none that is known."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("qlp")), "QLP").when(F.contains(low, F.lit("tess-spoc")), "TESS-SPOC").when(F.contains(low, F.lit("spoc")), "SPOC")


def flux_column(pipeline: Column, has_detrended: Column, raw: bool = False) -> Column:
    """Name of the flux column of a pipeline's files, the raw or the corrected series."""
    if raw:
        return F.when(pipeline.isNotNull(), "SAP_FLUX")
    return F.when((pipeline == "QLP") & has_detrended, "DET_FLUX").when(pipeline == "QLP", "KSPSAP_FLUX").when(pipeline.isNotNull(), "PDCSAP_FLUX")


def frame_kind(name: Column) -> Column:
    """science, dark or flat by the file name; null for others."""
    kind = F.lit(None).cast("string")
    for k, pattern in (("flat", "(?i)_flat_"), ("dark", "(?i)_dark_"), ("science", "(?i)_light_")):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    return kind


def cadence_seconds(value: Column) -> Column:
    """A cadence in seconds: values between 0 and 2 are days."""
    return F.when((value > 0) & (value < 2), value * 86400).otherwise(value)


def hours_to_degrees(hours: Column) -> Column:
    return hours * F.lit(15.0)


def clean_annulus(distance: Column, radius: float) -> Column:
    """Outer radius that keeps clear of a source at a distance, in steps of 5."""
    return (5 * F.floor((distance - radius) / 5)).cast("long")


def covers(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Whether a window holds another one whole."""
    return (start <= inner_start) & (inner_end <= end)


def cleared(finite_share: Column, inside: Column, outside: Column, overlaps: Column, depth: Column, error: Column, needed: Column) -> tuple[Column, Column]:
    """Whether a neighbour was measured well enough, and whether its eclipse is ruled out: apart from
    the target, and depth with three errors below what would be needed."""
    measured = F.coalesce((finite_share >= 0.8) & (inside >= 60) & (outside >= 120) & (error > 0), F.lit(False))
    return measured, F.coalesce(measured & ~overlaps & (depth + 3 * error < needed), F.lit(False))


def interpreted(df, day: str, start: str, ingress: str, egress: str, zones: list[str], end: str | None = None):
    """df's key columns with, for each zone, ingress, egress, midpoint (epoch seconds) and duration
    (seconds) of clock minutes, and whether they stand in order. A clock before the night's start
    belongs to the next day; daylight saving is the zone's own. With an `end`, the night's start and end are told
    too (night_start, night_end) and take part in the order."""
    keys = [c for c in df.columns if c not in (day, start, ingress, egress, end)]
    rows = df.withColumn("zone", F.explode(F.array(*map(F.lit, zones))))

    def at(minutes: str) -> Column:
        night = F.date_add(F.col(day), F.when(F.col(minutes) < F.col(start), 1).otherwise(0))
        clock = F.format_string("%s %02d:%02d:00", night.cast("string"), F.expr(f"cast({minutes} div 60 as int)"), (F.col(minutes) % 60).cast("int"))
        return F.unix_seconds(F.to_utc_timestamp(clock, F.col("zone")))

    rows = rows.withColumn("_i", at(ingress)).withColumn("_e", at(egress))
    i, e = F.col("_i"), F.col("_e")
    if end is not None:
        first, last = at(start), at(end)
        return rows.select(*keys, "zone", first.alias("night_start"), i.alias("ingress"), e.alias("egress"), last.alias("night_end"), ((i + e) / 2).alias("midpoint"), (e - i).alias("duration"), ((first < i) & (i < e) & (e < last)).alias("in_order"))
    return rows.select(*keys, "zone", i.alias("ingress"), e.alias("egress"), ((i + e) / 2).alias("midpoint"), (e - i).alias("duration"), (i < e).alias("in_order"))
