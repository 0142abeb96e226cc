"""Searches over trial grids, each trial a group of one aggregate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylathe.functions.expr import MAD_SCALE, floor_mod
from skylathe.operators.stats import mad_raw, median


def binned(df: DataFrame, by: list[str], bin_: Column, x: Column, y: Column) -> DataFrame:
    """by, bin, x, y, error, n: medians of a bin and its robust deviation over sqrt(n), 0 for one point."""
    rows = df.withColumn("bin", bin_.cast("long")).withColumn("_bx", x).withColumn("_by", y)
    rows = rows.withColumn("_m", median(F.col("_by")).over(Window.partitionBy(*by, "bin")))
    return rows.groupBy(*by, "bin").agg(median(F.col("_bx")).alias("x"), F.first("_m").alias("y"), (median(F.abs(F.col("_by") - F.col("_m"))) * MAD_SCALE / F.sqrt(F.count("*"))).alias("error"), F.count("*").alias("n"))


def noise_by_bin(df: DataFrame, by: list[str], t: str, y: str, widths: list[float], least_bins: int = 3, least_points: int = 2) -> DataFrame:
    """by, width, bins, points (median a bin), measured, white, beta: robust scatter of bin means
    against that of single points over the root of the points a bin."""
    white = mad_raw(df, by, F.col(y)).select(*by, F.col("mad").alias("single"))
    firsts = df.groupBy(*by).agg(F.min(t).alias("_t0"))
    rows = df.join(firsts, by).select(*by, t, y, "_t0", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    rows = rows.groupBy(*by, "width", F.floor((F.col(t) - F.col("_t0")) / F.col("width")).alias("bin")).agg(F.avg(y).alias("m"), F.count("*").alias("p")).filter(F.col("p") >= least_points)
    sizes = rows.groupBy(*by, "width").agg(median(F.col("p")).alias("points"))
    out = mad_raw(rows, [*by, "width"], F.col("m")).filter(F.col("n") >= least_bins).join(sizes, [*by, "width"]).join(white, by)
    out = out.withColumn("white", F.col("single") / F.sqrt("points"))
    return out.select(*by, "width", F.col("n").alias("bins"), "points", F.col("mad").alias("measured"), "white", F.try_divide("mad", "white").alias("beta"))


def box_periods(df: DataFrame, by: list[str], t: str, y: str, error: str, periods: list[float], durations: list[float], bins: int = 60) -> DataFrame:
    """by, period, duration, start, depth, snr: for each trial period the box of largest signal over
    noise (Kovacs, Zucker & Mazeh 2002), over phase bins.

    Points are summed to bins once a period; boxes are runs of bins, round the end of the phase too.
    """
    w = 1 / (F.col(error) * F.col(error))
    rows = df.select(*by, t, F.col(y).alias("y"), w.alias("w"), F.explode(F.array(*map(F.lit, periods))).alias("period"))
    at = F.floor(floor_mod(F.col(t) / F.col("period"), 1.0) * bins).cast("int")
    sums = rows.groupBy(*by, "period", at.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    whole = sums.groupBy(*by, "period").agg(F.sum("w").alias("sw"), F.sum("wy").alias("swy"))
    spans = sums.select("*", F.explode(F.array(*map(F.lit, durations))).alias("duration"))
    wide = F.greatest(F.lit(1), F.rint(F.col("duration") / F.col("period") * bins).cast("int"))
    spans = spans.select(*by, "period", "duration", "w", "wy", "bin", F.explode(F.sequence(F.lit(0), wide - 1)).alias("j"))
    boxes = spans.groupBy(*by, "period", "duration", F.pmod(F.col("bin") - F.col("j"), F.lit(bins)).alias("start")).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    boxes = boxes.join(whole, [*by, "period"]).filter(F.col("sw") - F.col("w") > 1e-9)
    depth = (F.col("swy") - F.col("wy")) / (F.col("sw") - F.col("w")) - F.col("wy") / F.col("w")
    boxes = boxes.withColumn("depth", depth).withColumn("snr", F.col("depth") / F.sqrt(1 / F.col("w") + 1 / (F.col("sw") - F.col("w"))))
    best = F.max(F.struct(F.round("snr", 9).alias("r"), (-F.col("duration")).alias("d"), (-F.col("start")).alias("s"), "depth")).alias("f")
    return boxes.groupBy(*by, "period").agg(best).select(*by, "period", (-F.col("f.d")).alias("duration"), (-F.col("f.s")).alias("start"), F.col("f.depth").alias("depth"), F.col("f.r").alias("snr"))


def periodogram(df: DataFrame, by: list[str], t: str, y: str, error: str, frequencies: list[float]) -> DataFrame:
    """by, frequency, power: the generalised Lomb-Scargle periodogram with a floating mean
    (Zechmeister & Kuerster 2009), from sums of cosines and sines."""
    w = 1 / (F.col(error) * F.col(error))
    rows = df.select(*by, F.col(t).alias("t"), F.col(y).alias("y"), w.alias("w"), F.explode(F.array(*map(F.lit, frequencies))).alias("frequency"))
    angle = floor_mod(F.col("t") * F.col("frequency"), 1.0) * 6.283185307179586
    rows = rows.withColumn("c", F.cos(angle)).withColumn("s", F.sin(angle))
    col = F.col
    sums = rows.groupBy(*by, "frequency").agg(
        F.sum("w").alias("W"), *[F.sum(col("w") * col(a)).alias(a.upper()) for a in "ycs"], *[F.sum(col("w") * col(a) * col(b)).alias((a + b).upper()) for a, b in ("yy", "yc", "ys", "cc", "cs", "ss")]
    )
    n = lambda k: col(k) / col("W")
    about = {k: n(k) - n(k[0]) * n(k[1]) for k in ("YY", "YC", "YS", "CC", "CS", "SS")}
    sums = sums.select(*by, "frequency", *[v.alias(k) for k, v in about.items()])
    det = col("CC") * col("SS") - col("CS") * col("CS")
    power = (col("SS") * col("YC") * col("YC") + col("CC") * col("YS") * col("YS") - 2 * col("CS") * col("YC") * col("YS")) / (col("YY") * det)
    return sums.select(*by, "frequency", F.when((det > 1e-12) & (col("YY") > 0), power).alias("power"))


#: Cells to either side over which a point is spread, and the kernel's width: sums come out to about 1e-11.
REACH = 12
_KERNEL = 4 / 3 * REACH / math.pi
#: Points of a series that a task takes at once, if its cells aren't more.
MANY = 1 << 17


def full_periodogram(df: DataFrame, by: list[str], t: str, y: str, error: str, lowest: float, highest: float, samples: int = 8) -> DataFrame:
    """by, frequency, power, points, span: periodogram() on the whole grid of a series, `samples` frequencies
    to a peak's width (1 / span) from lowest to highest.

    Points are spread on a regular grid of time (a Gaussian over 2 x REACH + 1 cells), and one fast transform of the cells
    then gives the sums of all frequencies. The cost is points x cells of the kernel, whatever the number of frequencies.
    Points are shuffled as they are, once, and spread where their series is; a series of more points than cells (and than MANY) is
    first spread in parts of that size, whose cells are summed up. Rows without a key, time, value or positive error are left
    out, and so are series of one time.
    """
    usable = F.col(t).isNotNull() & F.col(y).isNotNull() & (F.col(error) > 0)
    rows = df.filter(usable).select(*by, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), (1 / (F.col(error) * F.col(error))).alias("_w"))
    whole = rows.groupBy(*by).agg(F.min("_t").alias("_t0"), (F.max("_t") - F.min("_t")).alias("_span"), F.count("*").alias("_n"), F.sum("_w").alias("_sw"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_mean")).filter("_span > 0")
    whole = whole.withColumn("_df", 1 / (F.col("_span") * samples)).withColumn("_count", 1 + F.rint((F.lit(highest) - lowest) / F.col("_df")).cast("long"))
    whole = whole.withColumn("_cells", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_count") * 8))).cast("long"))
    # Dealt by number, as a few points of a small table make work of their whole grid.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).join(whole, by)
    rows = rows.withColumn("_y", F.col("_y") - F.col("_mean")).withColumn("_t", F.col("_t") - F.col("_t0"))
    told = ["_count", "_cells", "_df", "_sw", "_n", "_span"]
    rows = rows.select(*by, "_t", "_w", (F.col("_w") * F.col("_y")).alias("_wy"), (F.col("_w") * F.col("_y") * F.col("_y")).alias("_wyy"), *told)
    part = F.greatest(F.lit(MANY), F.col("_cells"))

    def spread(points: pa.Table) -> dict[str, np.ndarray]:
        """Complex sums by cell of weights (w), weighted values (y) and weights at twice the phase (d)."""
        n, df_ = points["_cells"][0].as_py(), points["_df"][0].as_py()
        sums = {name: np.zeros(n, complex) for name in "wyd"}
        for i in range(0, points.num_rows, 1 << 15):
            t_, w, wy = (points[c].to_numpy()[i : i + (1 << 15)] for c in ("_t", "_w", "_wy"))
            at, turn = t_ * df_ * n, np.exp(2j * math.pi * lowest * t_)
            cell = np.rint(at).astype(np.int64)[:, None] + np.arange(-REACH, REACH + 1)
            g, place = np.exp(-((at[:, None] - cell) ** 2) / _KERNEL), (cell % n).ravel()
            for name, v in (("w", w * turn), ("y", wy * turn), ("d", w * turn**2)):
                sums[name].real += np.bincount(place, (g * v.real[:, None]).ravel(), n)
                sums[name].imag += np.bincount(place, (g * v.imag[:, None]).ravel(), n)
        return sums

    def powers(key: tuple, points: pa.Table, grid: dict[str, np.ndarray], wyy: float) -> pa.Table:
        n, count, df_, total = (points[c][0].as_py() for c in ("_cells", "_count", "_df", "_sw"))

        def sums(name: str, step: int) -> np.ndarray:
            k = step * np.arange(count)
            return np.fft.ifft(grid[name])[k] * n * np.exp(_KERNEL * (math.pi * k / n) ** 2) / math.sqrt(math.pi * _KERNEL)

        one, flux, two = sums("w", 1) / total, sums("y", 1) / total, sums("d", 2) / total
        cc, ss, cs = (1 + two.real) / 2 - one.real**2, (1 - two.real) / 2 - one.imag**2, two.imag / 2 - one.real * one.imag
        det, yy = cc * ss - cs**2, wyy / total
        with np.errstate(divide="ignore", invalid="ignore"):
            power = (ss * flux.real**2 + cc * flux.imag**2 - 2 * cs * flux.real * flux.imag) / (yy * det)
        out = {"frequency": lowest + np.arange(count) * df_, "power": np.where((det > 1e-12) & (yy > 0), power, np.nan)}
        return pa.table({**{c: pa.repeat(v, count) for c, v in zip(by, key, strict=True)}, **out, "points": pa.repeat(points["_n"][0], count), "span": pa.repeat(points["_span"][0], count)})

    def direct(key: tuple, points: pa.Table) -> pa.Table:
        return powers(key, points, spread(points), points["_wyy"].to_numpy().sum())

    def in_part(key: tuple, points: pa.Table) -> pa.Table:
        sums = spread(points)
        cell = np.flatnonzero(sums["w"] != 0)
        out = {"cell": cell, **{f"{k}{p}": getattr(v, kind)[cell] for k, v in sums.items() for p, kind in (("r", "real"), ("i", "imag"))}}
        out["yy"] = np.where(np.arange(len(cell)) == 0, points["_wyy"].to_numpy().sum(), 0.0)
        return pa.table({**{c: pa.repeat(v, len(cell)) for c, v in zip(by, key[:-1], strict=True)}, **out, **{c: pa.repeat(points[c][0], len(cell)) for c in told}})

    def joined(key: tuple, cells: pa.Table) -> pa.Table:
        grid = {k: np.zeros(cells["_cells"][0].as_py(), complex) for k in "wyd"}
        for k, v in grid.items():
            v[cells["cell"].to_numpy()] = cells[f"{k}r"].to_numpy() + 1j * cells[f"{k}i"].to_numpy()
        return powers(key, cells, grid, cells["yy"].to_numpy().sum())

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    power = f"{kinds}, frequency double, power double, points long, span double"
    sums = [f"{k}{p}" for k in "wyd" for p in "ri"]
    # Points of one time add up first, so a hash of the time deals a series evenly.
    large = rows.filter(F.col("_n") > part).groupBy(*by, "_t").agg(*[F.sum(c).alias(c) for c in ("_w", "_wy", "_wyy")], *[F.first(c).alias(c) for c in told])
    large = large.withColumn("_part", F.pmod(F.xxhash64("_t"), F.ceil(F.col("_n") / part)))
    cells = large.groupBy(*by, "_part").applyInArrow(in_part, f"{kinds}, cell long, {', '.join(f'{c} double' for c in sums)}, yy double, _count long, _cells long, _df double, _sw double, _n long, _span double")
    cells = cells.groupBy(*by, "cell").agg(*[F.sum(c).alias(c) for c in (*sums, "yy")], *[F.first(c).alias(c) for c in told])
    found = rows.filter(F.col("_n") <= part).groupBy(*by).applyInArrow(direct, power).unionByName(cells.groupBy(*by).applyInArrow(joined, power))
    return found.withColumn("power", F.when(~F.isnan("power"), F.col("power")))


#: Trial periods of a task of box_search().
CHUNK = 256


def box_search(df: DataFrame, by: list[str], t: str, y: str, error: str, shortest: float, longest: float, durations: list[float], factor: float = 2.0, oversample: int = 10) -> DataFrame:
    """by, period, duration, middle, depth, error, snr: for every trial period the box of largest signal over
    noise, its first middle after the series began, its depth and the depth's error.

    Trial frequencies lie factor x least duration / span^2 apart, from 1 / longest to 1 / shortest. A series is summed once
    to cells of time of a tenth (`oversample`) of the least duration, so no group holds more than span / cell rows; trial periods go to tasks by the
    chunk. A period's cells are folded to as fine phase bins, and a box is the difference of two prefix sums, whatever its
    duration. Equal boxes give way to the shorter, then the earlier phase. Rows without a key, time, value or positive error are left out.
    """
    cell = min(durations) / oversample
    usable = F.col(t).isNotNull() & F.col(y).isNotNull() & (F.col(error) > 0)
    w = 1 / (F.col(error) * F.col(error))
    rows = df.filter(usable).select(*by, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), w.alias("_w"))
    whole = rows.groupBy(*by).agg(F.min("_t").alias("_t0"), (F.max("_t") - F.min("_t")).alias("_span")).filter("_span > 0")
    sums = rows.join(whole, by).groupBy(*by, F.floor((F.col("_t") - F.col("_t0")) / cell).alias("cell")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.first("_t0").alias("_t0"), F.first("_span").alias("_span"))
    step = F.lit(factor * min(durations)) / (F.col("_span") * F.col("_span"))
    sums = sums.withColumn("_df", step).withColumn("_count", 1 + F.rint(F.lit(1 / shortest - 1 / longest) / step).cast("long"))
    dealt = sums.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_count - 1) div {CHUNK}"))))

    def search(key: tuple, grid: pd.DataFrame) -> pd.DataFrame:
        first, times = grid.iloc[0], (grid["cell"].to_numpy() + 0.5) * cell
        values = grid[["n", "w", "wy"]].to_numpy(float)
        n, sw, swy = values.sum(axis=0)
        out = []
        for k in range(int(key[-1]) * CHUNK, min(int(first["_count"]), (int(key[-1]) + 1) * CHUNK)):
            period = 1 / (1 / longest + k * first["_df"])
            bins = max(1, int(period / cell))
            turns = times / period
            at = ((turns - np.floor(turns)) * bins).astype(int)
            folded = np.stack([np.bincount(at, v, bins) for v in values.T])
            prefix = np.concatenate([np.zeros((3, 1)), np.cumsum(np.concatenate([folded, folded], axis=1), axis=1)], axis=1)
            best = None
            for d in sorted(durations):
                wide = max(1, int(np.rint(d / period * bins)))
                if wide >= bins:
                    continue
                inn, iw, iwy = prefix[:, wide : wide + bins] - prefix[:, :bins]
                fit = (inn > 0.5) & (inn < n - 0.5)
                iw, iwy = np.where(fit, iw, 1.0), np.where(fit, iwy, 0.0)
                ow = np.where(fit, sw - iw, 1.0)
                depth, error = (swy - iwy) / ow - iwy / iw, np.sqrt(1 / iw + 1 / ow)
                snr = np.round(np.where(fit, depth / error, -np.inf), 9)
                i = int(snr.argmax())
                if np.isfinite(snr[i]) and (best is None or snr[i] > best[-1]):
                    best = (period, d, (i + wide / 2) / bins % 1 * period, depth[i], error[i], snr[i])
            if best:
                out.append(best)
        told = pd.DataFrame(out, columns=["period", "duration", "middle", "depth", "error", "snr"], dtype=float)
        told["middle"] += first["_t0"]
        for c, v in zip(by, key[:-1], strict=True):
            told[c] = v
        return told

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return dealt.groupBy(*by, "chunk").applyInPandas(search, f"{kinds}, period double, duration double, middle double, depth double, error double, snr double")


def false_alarm(power: Column, n: int, max_frequency: float, span: float) -> Column:
    """False-alarm probability of a power (Baluev 2008), from the points and the variance of their times."""
    tau = max_frequency * span * F.pow(1 - power, F.lit((n - 4) / 2.0)) * F.sqrt(F.lit((n - 1) / 2.0) * power)
    return F.least(F.lit(1.0), 1 - (1 - F.pow(1 - power, F.lit((n - 3) / 2.0))) * F.exp(-tau))
