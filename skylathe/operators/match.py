"""Joins by nearness, in space and time, and integrity checks of joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylathe.functions.expr import finite, separation_arcsec

from . import tiles


def within(left: DataFrame, right: DataFrame, xy: tuple[str, str], other: tuple[str, str], radius: float) -> DataFrame:
    """Pairs no further apart than radius in a plane: an equi-join on cells of the radius, the left
    side in its own cell and the right side in the nine about its own, then the distance."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = left.withColumn("_cx", cell(xy[0])).withColumn("_cy", cell(xy[1]))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = right.select("*", near.alias("_i")).select("*", near.alias("_j")).withColumn("_cx", cell(other[0]) + F.col("_i")).withColumn("_cy", cell(other[1]) + F.col("_j")).drop("_i", "_j")
    d = F.hypot(F.col(xy[0]) - F.col(other[0]), F.col(xy[1]) - F.col(other[1]))
    return a.join(b, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", d).filter(F.col("distance") <= radius)


def _sky_cells(ra: Column, band: Column, reach: float) -> tuple[Column, Column]:
    """Number of cells in right ascension of a band of declination (of height reach, in degrees), and
    the cell of a right ascension. Cells are no narrower than what reach spans at the band's end nearer
    the pole, a step further on; about the poles there is one."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * reach + reach
    span = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-12)))))
    n = F.when(edge < 89.0, F.greatest(F.lit(1), F.floor(360.0 / (span * 1.001)))).otherwise(F.lit(1)).cast("long")
    return n, F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("long")


def sky_pairs(left: DataFrame, right: DataFrame, pos: tuple[str, str], other: tuple[str, str], keep: list[str], radius: float) -> DataFrame:
    """left's rows with those of right (columns _o_<name> of keep) within radius arcsec, and the
    separation: an equi-join on cells of about that size, the right side in the nine about its own.
    Cells close around 0 and 360 degrees."""
    reach = radius / 3600
    a = left.withColumn("_b", F.floor(F.col(pos[1]) / reach))
    a = a.withColumn("_c", _sky_cells(F.col(pos[0]), F.col("_b"), reach)[1])
    b = right.select(*[F.col(c).alias(f"_o_{c}") for c in dict.fromkeys([*other, *keep])], F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_i")).withColumn("_b", F.floor(F.col(f"_o_{other[1]}") / reach) + F.col("_i"))
    n, at = _sky_cells(F.col(f"_o_{other[0]}"), F.col("_b"), reach)
    b = b.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, n) for k in (-1, 0, 1)])))).drop("_i")
    sep = separation_arcsec(F.col(pos[0]), F.col(pos[1]), F.col(f"_o_{other[0]}"), F.col(f"_o_{other[1]}"))
    return a.join(b, ["_b", "_c"]).drop("_b", "_c").withColumn("separation", sep).filter(F.col("separation") <= radius)


#: Least height of a tile in degrees: tiles of a sparse sky aren't of a row each, those of a dense one no larger than a task holds.
_TILE = 0.25


def sky_matches(left: DataFrame, right: DataFrame, key: str, pos: tuple[str, str], other: tuple[str, str], name: str, radius: float, close: float | None = None, aperture: float | None = None) -> DataFrame:
    """key, matches, nearest, separation, status: what lies within radius arcsec; a row for each of left's, those
    without a match included. Ties go to the smaller name. status is matched, distant (further than `close`) or none. With an
    aperture, within_aperture counts the matches inside it.

    No pairs are made: tiles of left meet the right side's positions in the nine tiles about them, each position
    once with its rows counted, and are counted there by strips (tiles.py).
    """
    reach = max(radius / 3600, _TILE)
    band = lambda c: F.floor(c / reach)
    a = left.select(F.col(key).alias("key"), F.col(pos[0]).cast("double").alias("ra"), F.col(pos[1]).cast("double").alias("dec")).withColumn("_b", band(F.col("dec")))
    a = a.withColumn("_c", _sky_cells(F.col("ra"), F.col("_b"), reach)[1])
    b = right.select(finite(F.col(other[0]).cast("double")).alias("ra"), finite(F.col(other[1]).cast("double")).alias("dec"), F.col(name).alias("name")).filter("ra is not null and dec is not null")
    b = b.groupBy("ra", "dec").agg(F.min(F.struct("name")).alias("m"), F.count("*").alias("n")).select("ra", "dec", "m.name", "n", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_i"))
    b = b.withColumn("_b", band(F.col("dec")) + F.col("_i"))
    n, at = _sky_cells(F.col("ra"), F.col("_b"), reach)
    b = b.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, n) for k in (-1, 0, 1)])))).drop("_i")
    radii = [radius] if aperture is None else [radius, min(aperture, radius)]
    kind = {f.name: f.dataType.simpleString() for f in b.schema.fields} | {"key": a.schema["key"].dataType.simpleString()}
    counts = [f"sure{k}" for k in range(len(radii))]
    doubts = [f"doubt{k}" for k in range(len(radii))]
    schema = ", ".join([f"key {kind['key']}, ra double, dec double", *[f"{c} long" for c in counts], *[f"{c} array<struct<ra:double,dec:double,n:long>>" for c in doubts], f"near array<struct<ra:double,dec:double,name:{kind['name']}>>"])

    def tile(rows: pa.Table, others: pa.Table) -> pa.Table:
        sure, lists = tiles.matched(rows, others, radii)
        return pa.table([rows["key"], rows["ra"], rows["dec"], *sure, *lists], names=["key", "ra", "dec", *counts, *doubts, "near"])

    out = a.groupBy("_b", "_c").cogroup(b.groupBy("_b", "_c")).applyInArrow(tile, schema)
    sep = lambda o: separation_arcsec(F.col("ra"), F.col("dec"), o["ra"], o["dec"])
    rim = lambda d, r: F.aggregate(F.filter(d, lambda o: sep(o) <= r), F.lit(0).cast("long"), lambda s, o: s + o["n"])
    whole = [F.col(c) + rim(d, r) for c, d, r in zip(counts, doubts, radii, strict=True)]
    best = F.array_min(F.filter(F.transform("near", lambda o: F.struct(sep(o).alias("separation"), o["name"].alias("name"))), lambda s: s["separation"] <= radius))
    out = out.select("key", best.alias("m"), *[w.alias(f"whole{k}") for k, w in enumerate(whole)])
    status = F.when(F.col("m").isNull(), "none").when(F.col("m.separation") > (radius if close is None else close), "distant").otherwise("matched")
    inside = [F.col("whole1").alias("within_aperture")] if aperture is not None else []
    return out.select(F.col("key").alias(key), F.col("whole0").alias("matches"), F.col("m.name").alias("nearest"), F.col("m.separation").alias("separation"), status.alias("status"), *inside)


def cone(df: DataFrame, pos: tuple[str, str], centre: tuple[float, float], radius: float) -> DataFrame:
    """df's rows within radius arcsec of a position, with their separation."""
    sep = separation_arcsec(F.col(pos[0]), F.col(pos[1]), F.lit(centre[0]), F.lit(centre[1]))
    return df.withColumn("separation", sep).filter(F.col("separation") <= radius)


def in_circles(df: DataFrame, circles: DataFrame, pos: tuple[str, str], radius: float) -> DataFrame:
    """df's distinct rows that lie in any of the circles about the positions of another table, however many circles overlap."""
    rows = df.select(F.struct(*df.columns).alias("_row"), *pos)
    return sky_matches(rows, circles.withColumn("_one", F.lit(1)), "_row", pos, pos, "_one", radius).filter("matches > 0").select("_row.*").distinct()


def broken_join(left: DataFrame, right: DataFrame, key: str, same: str) -> DataFrame:
    """key, problem: keys that only one side has (missing on the right, unexpected there), and those
    whose values of a column differ. Empty if the join is sound."""
    both = left.select(key, F.col(same).alias("_l"), F.lit(True).alias("_in_l")).join(right.select(key, F.col(same).alias("_r"), F.lit(True).alias("_in_r")), key, "full_outer")
    problem = F.when(F.col("_in_r").isNull(), "missing").when(F.col("_in_l").isNull(), "unexpected").when(~F.col("_l").eqNullSafe(F.col("_r")), "different")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side, n: what breaks a one-to-one join; empty if nothing does."""
    many = lambda df, s: df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(s).alias("side"), "n")
    return many(left, "left").unionByName(many(right, "right"))


def missing_and_unexpected(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem: keys on one side only."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("problem")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))


def nearest_option(df: DataFrame, value: Column, options: DataFrame, option: str, out: str = "nearest") -> DataFrame:
    """df with the option nearest to a value, the smaller of equally near ones; null for an unknown value
    or without options. The distinct options (exposure times, grid steps) are one array, few by nature."""
    every = options.agg(F.sort_array(F.collect_set(F.col(option).cast("double"))).alias("_o"))
    best = F.array_min(F.transform("_o", lambda o: F.struct(F.abs(o - value).alias("d"), o.alias("o"))))
    return df.join(F.broadcast(every), F.lit(True)).withColumn(out, F.when(value.isNotNull(), best["o"])).drop("_o")


def nearest_other(df: DataFrame, by: list[str], x: Column, y: Column, columns: list[str], apart: float = 5.0) -> DataFrame:
    """by, distance, columns: of each group the source nearest to the origin of x and y (offsets from a target)
    that lies further than `apart`, which rules out the target itself; of equally near ones the first by columns.
    Groups without another source give nothing."""
    far = df.withColumn("distance", F.hypot(x, y)).filter(F.col("distance") > apart)
    best = F.min(F.struct("distance", *columns)).alias("_b")
    return far.groupBy(*by).agg(best).select(*by, "_b.*")


def star_shift(pairs: DataFrame, by: list[str], dx: Column, dy: Column) -> DataFrame:
    """by, dx, dy, stars, rms: median shift of matched stars, again without those further from it
    than max(1.5, median + 4 robust deviations), to whole pixels."""
    from pyspark.sql import Window

    from skylathe.functions.expr import MAD_SCALE
    from skylathe.operators.stats import median

    kin = Window.partitionBy(*by)
    rows = pairs.withColumn("_dx", dx).withColumn("_dy", dy).withColumn("_r", F.hypot(F.col("_dx") - median(F.col("_dx")).over(kin), F.col("_dy") - median(F.col("_dy")).over(kin)))
    rows = rows.withColumn("_m", median(F.col("_r")).over(kin)).withColumn("_s", median(F.abs(F.col("_r") - F.col("_m"))).over(kin) * MAD_SCALE)
    rows = rows.filter(F.col("_r") <= F.greatest(F.lit(1.5), F.col("_m") + 4 * F.col("_s")))
    out = rows.withColumn("_mx", F.rint(median(F.col("_dx")).over(kin))).withColumn("_my", F.rint(median(F.col("_dy")).over(kin)))
    off = F.pow(F.col("_dx") - F.col("_mx"), F.lit(2.0)) + F.pow(F.col("_dy") - F.col("_my"), F.lit(2.0))
    return out.groupBy(*by).agg(F.first("_mx").alias("dx"), F.first("_my").alias("dy"), F.count("*").alias("stars"), F.sqrt(F.avg(off)).alias("rms"))
