"""Robust statistics by group. Each convention is a function of its own: raw or normalised median
absolute deviation, population or sample deviation, guarded correlation.

A window and the aggregate above it share one partitioning, so each function shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylathe.functions.expr import MAD_SCALE


def median(x: Column) -> Column:
    """Exact median, linear between the middle two."""
    return F.percentile(x, 0.5)


def _deviations(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    kin = Window.partitionBy(*by)
    return df.withColumn("_x", x).withColumn("_m", median(F.col("_x")).over(kin)).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))


def mad_raw(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    """by, n, median, mad: 1.4826 times the median distance from the median, not normalised."""
    return _deviations(df, by, x).groupBy(*by).agg(F.count("_x").alias("n"), F.first("_m").alias("median"), (median(F.col("_d")) * MAD_SCALE).alias("mad"))


def normalized(df: DataFrame, by: list[str], x: str, out: str = "normalized") -> DataFrame:
    """df with x over its group's median; null where that is 0."""
    return df.withColumn(out, F.try_divide(F.col(x), median(F.col(x)).over(Window.partitionBy(*by))))


def mad_normalized(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, mad: the deviation of values that are divided by their median first."""
    return mad_raw(normalized(df, by, x, "_n"), by, F.col("_n")).select(*by, "mad")


def clipped_std(df: DataFrame, by: list[str], x: str, sigmas: float = 5.0) -> DataFrame:
    """by, kept, std, full_std: population deviations of normalised values, of those within so many
    robust deviations of the median and of all."""
    rows = _deviations(normalized(df, by, x, "_n"), by, F.col("_n"))
    rows = rows.withColumn("_s", median(F.col("_d")).over(Window.partitionBy(*by)) * MAD_SCALE)
    near = F.when(F.col("_d") <= F.col("_s") * sigmas, F.col("_x"))
    return rows.groupBy(*by).agg(F.count(near).alias("kept"), F.stddev_pop(near).alias("std"), F.stddev_pop("_x").alias("full_std"))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation of the pairs that are known; null for fewer than `least` or no spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)  # corr() itself fails on columns without spread
    return F.when((F.count(a) >= least) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def robust_z(df: DataFrame, by: list[str], x: str, least: int = 20, out: str = "z") -> DataFrame:
    """df with distances from the group's median in robust deviations; 0 where fewer than `least`
    values are known or they don't spread."""
    kin = Window.partitionBy(*by)
    rows = _deviations(df, by, F.col(x)).withColumn("_s", median(F.col("_d")).over(kin) * MAD_SCALE).withColumn("_c", F.count("_x").over(kin))
    z = F.when((F.col("_c") < least) | (F.col("_s") <= 0), F.when(F.col("_x").isNotNull(), 0.0)).otherwise(F.try_divide(F.col("_x") - F.col("_m"), F.col("_s")))
    return rows.withColumn(out, z).drop("_x", "_m", "_d", "_s", "_c")


def centre_and_noise(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, centre, noise: the deviation falls back on the population's where the robust one is 0."""
    return _deviations(df, by, F.col(x)).groupBy(*by).agg(F.first("_m").alias("centre"), F.coalesce(F.nullif(median(F.col("_d")) * MAD_SCALE, F.lit(0.0)), F.stddev_pop("_x")).alias("noise"))


def weighted_mean(x: Column, error: Column) -> Column:
    """Mean by inverse variance over rows with a positive error."""
    w = F.when(error > 0, 1 / (error * error))
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def quadrature(error: Column) -> Column:
    return F.sqrt(F.sum(error * error))


def conditional_depth(df: DataFrame, by: list[str], x: str, inside: Column, least_in: int = 10, least_out: int = 20) -> DataFrame:
    """by, depth, error: median outside less median inside, errors from both robust deviations;
    null for too few rows on either side."""
    kin = Window.partitionBy(*by, "_in")
    rows = df.withColumn("_in", inside).withColumn("_m", median(F.col(x)).over(kin)).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    side = rows.groupBy(*by, "_in").agg(F.count(x).alias("n"), F.first("_m").alias("m"), (median(F.col("_d")) * MAD_SCALE).alias("s"))
    i, o = (lambda c: F.max(F.when(F.col("_in"), F.col(c)))), (lambda c: F.max(F.when(~F.col("_in"), F.col(c))))
    enough = (i("n") >= least_in) & (o("n") >= least_out)
    error = F.sqrt(F.try_divide(i("s") * i("s"), i("n")) + F.try_divide(o("s") * o("s"), o("n")))
    return side.groupBy(*by).agg(F.when(enough, o("m") - i("m")).alias("depth"), F.when(enough, error).alias("error"), F.coalesce(i("n"), F.lit(0)).alias("n_in"), F.coalesce(o("n"), F.lit(0)).alias("n_out"))


def plateau(df: DataFrame, *metrics: str, slack: float = 1.1) -> DataFrame:
    """df with passes: every metric within slack of its least. The least is a one-row aggregate, so no
    row waits for the others in one task."""
    least = df.agg(*[F.min(m).alias(f"_{m}") for m in metrics])
    rows, ok = df.join(F.broadcast(least), F.lit(True)), F.lit(True)
    for m in metrics:
        ok = ok & (F.col(m) <= F.col(f"_{m}") * slack)
    return rows.withColumn("passes", ok).drop(*[f"_{m}" for m in metrics])


def zero_filled(df: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """key, n for every key of the domain, 0 where df has no row."""
    return domain.select(key).join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
