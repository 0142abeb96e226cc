"""Sequence operators within a series: moving medians, gaps, folds, neighbours."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylathe.functions.expr import MAD_SCALE


def moving_median(df: DataFrame, by: list[str], micros: str, x: str, width_us: int, least: int = 5, out: str = "moving", chunk: int = 16) -> DataFrame:
    """df with the median of x over rows within half a width in time; null for fewer than `least`.

    Series are cut into chunks of time, `chunk` widths long, that see half a width of their neighbours. Within
    one, the window is a sorted list that rows enter and leave as it moves on, found by bisection, so a row
    costs the same whatever the window holds. Rows without time have null; null and NaN values count in no window.
    """
    half, span = width_us // 2, max(1, chunk * width_us)
    at = lambda e: F.floor(e / F.lit(float(span))).cast("long")
    rows = df.withColumn("_own", at(F.col(micros))).withColumn("_chunk", F.explode_outer(F.sequence(at(F.col(micros) - half), at(F.col(micros) + half))))
    rows = rows.withColumn("_t", F.col(micros).cast("long")).withColumn("_x", F.col(x).cast("double"))
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])

    def slide(group: pa.Table) -> pa.Table:
        group = group.sort_by("_t")
        own = pc.equal(group["_own"], group["_chunk"]).combine_chunks()
        here = np.flatnonzero(own.fill_null(False).to_numpy(zero_copy_only=False))
        lone = np.flatnonzero(group["_own"].is_null().combine_chunks().to_numpy(zero_copy_only=False))
        t = group["_t"].fill_null(0).to_numpy()
        values = group["_x"].fill_null(float("nan")).to_numpy()
        found = np.full(len(t), np.nan)
        window: list[float] = []
        first = last = 0
        for i in here:
            while last < len(t) and t[last] <= t[i] + half:
                if values[last] == values[last]:
                    bisect.insort(window, values[last])
                last += 1
            while t[first] < t[i] - half:
                if first < last and values[first] == values[first]:
                    del window[bisect.bisect_left(window, values[first])]
                first += 1
            n = len(window)
            if n >= max(least, 1):
                found[i] = (window[(n - 1) // 2] + window[n // 2]) / 2
        keep = np.sort(np.concatenate([here, lone]))
        out_values = pa.array(found[keep], pa.float64(), from_pandas=True)
        return group.select([f.name for f in fields]).take(pa.array(keep)).append_column(out, out_values)

    return rows.groupBy(*by, "_chunk").applyInArrow(slide, schema)


def rolling_median(df: DataFrame, by: list[str], order: list[str], x: str, side: int = 4, least: int = 4, out: str = "rolling") -> DataFrame:
    """df with the centred median over 2 side + 1 rows."""
    near = Window.partitionBy(*by).orderBy(*order).rowsBetween(-side, side)
    return df.withColumn(out, F.when(F.count(x).over(near) >= least, F.percentile(x, 0.5).over(near)))


def isolated_outliers(df: DataFrame, by: list[str], order: list[str], x: str, sigmas: float = 6.0, floor: float = 0.025) -> DataFrame:
    """df with rolling and outlier: further from the rolling median than both sigmas robust
    deviations of all such distances and the floor."""
    kin = Window.partitionBy(*by)
    rows = rolling_median(df, by, order, x).withColumn("_r", F.col(x) - F.col("rolling"))
    rows = rows.withColumn("_m", F.percentile("_r", 0.5).over(kin)).withColumn("_s", F.percentile(F.abs(F.col("_r") - F.col("_m")), 0.5).over(kin) * MAD_SCALE)
    return rows.withColumn("outlier", F.coalesce(F.abs("_r") > F.greatest(F.col("_s") * sigmas, F.lit(floor)), F.lit(False))).drop("_r", "_m", "_s")


def sections(df: DataFrame, by: list[str], t: str, gap: float, tie: str, out: str = "section") -> DataFrame:
    """df with a section number that grows after each step longer than gap."""
    order = Window.partitionBy(*by).orderBy(t, tie)
    step = F.col(t) - F.lag(t).over(order)
    return df.withColumn("_g", F.coalesce((step > gap).cast("int"), F.lit(0))).withColumn(out, F.sum("_g").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def strictly_rising(df: DataFrame, by: list[str], x: str, order: str) -> DataFrame:
    """by, n, rising: whether each value exceeds the one before."""
    step = F.col(x) - F.lag(x).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("_s") > 0), F.lit(True)).alias("rising"))


def folds(df: DataFrame, by: list[str], order: list[str], k: int = 8, out: str = "fold") -> DataFrame:
    """df with contiguous fold numbers from 1, the first folds one longer where rows don't divide."""
    return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*by).orderBy(*order)))


def chunks(df: DataFrame, by: list[str], order: list[str], x: str, size: int = 5, least: int = 3) -> DataFrame:
    """by, chunk, n, value: medians of consecutive runs of `size` rows; short ones need `least`."""
    number = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).alias("chunk")
    return df.select("*", number).groupBy(*by, "chunk").agg(F.count(x).alias("n"), F.percentile(x, 0.5).alias("value")).filter(F.col("n") >= least)


def gap_check(df: DataFrame, by: list[str], t: str, start: Column, end: Column) -> DataFrame:
    """by, before, after, inside: the nearest times around a window and how many are in it."""
    c = F.col(t)
    return df.groupBy(*by).agg(F.max(F.when(c < start, c)).alias("before"), F.min(F.when(c > end, c)).alias("after"), F.count_if(c.between(start, end)).alias("inside"))


def meridian_side(df: DataFrame, by: list[str], order: str, airmass: str, out: str = "meridian") -> DataFrame:
    """df with 0 up to the row of least airmass (the first of equal ones) and 1 after it."""
    at = F.min(F.struct(airmass, order)).over(Window.partitionBy(*by))
    return df.withColumn(out, (F.col(order) > at[order]).cast("int"))


def previous_accepted(df: DataFrame, by: list[str], order: list[str], accepted: Column, *values: str) -> DataFrame:
    """df with guess_<value>, that of the last accepted row before; null where there is none yet."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"guess_{v}": F.last(F.when(accepted, F.col(v)), ignorenulls=True).over(before) for v in values})


#: Roles of representative_rows(), in the order in which they choose.
ROLES = ["early", "middle", "before_meridian", "after_meridian", "late"]


def representative_rows(df: DataFrame, by: list[str], order: str, airmass: str, bracket: int = 12) -> DataFrame:
    """by, role, row, order: first, middle and last row of each series and those `bracket` before and
    after its least airmass (the first of equal ones), counted from 0. A row that an earlier role has
    gives way to the nearest free one, the lower of two. Series of fewer than five rows give nothing.
    """
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    each = rows.groupBy(*by).agg(F.count("*").cast("int").alias("_n"), F.min(F.struct(airmass, "_i"))["_i"].alias("_m")).filter("_n >= 5")
    wanted = F.array(F.lit(0), F.expr("_n div 2").cast("int"), F.greatest(F.lit(0), F.col("_m") - bracket), F.least(F.col("_n") - 1, F.col("_m") + bracket), F.col("_n") - 1)
    around = lambda i: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(ROLES))), lambda k: F.array(i - k, i + k)))
    free = lambda taken, i: F.filter(around(i), lambda j: (j >= 0) & (j < F.col("_n")) & ~F.array_contains(taken, j))
    taken = F.aggregate(wanted, F.array().cast("array<int>"), lambda t, i: F.concat(t, F.slice(free(t, i), 1, 1)))
    picked = each.select(*by, F.posexplode(taken).alias("_k", "_i")).select(*by, F.element_at(F.array(*map(F.lit, ROLES)), F.col("_k") + 1).alias("role"), "_i")
    return picked.join(rows.select(*by, "_i", order), [*by, "_i"]).withColumnRenamed("_i", "row").select(*by, "role", "row", order)
