"""The driver's tables seen as light curves and photometry, for the queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylathe.functions import expr as X

#: Ephemeris and event of the queries, in days.
T0, PERIOD, DURATION, CADENCE = 19723.5, 2.9, 0.6, 0.02


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """events as light curves: event_id, series, sector, us, t (days), flux, error, quality, k, good."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("series"), F.col("event_type").alias("sector"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), X.finite(F.col("value")).alias("flux"), k.alias("k")
    )
    rows = rows.withColumn("t", F.col("us") / F.lit(X.DAY_US)).withColumn("error", F.lit(1.0) + F.pmod("k", F.lit(7)) * F.lit(0.125))
    rows = rows.withColumn("quality", F.when(F.col("k") % 17 == 0, 1).otherwise(0))
    return rows.withColumn("good", X.good(F.col("flux"), F.col("error"), F.col("quality")))


def phased(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return curves(spark, folder).filter("good").withColumn("phase", X.phase(t, T0, PERIOD)).withColumn("cycle", X.cycle(t, T0, PERIOD)).withColumn("box", X.box_fraction(F.col("phase"), DURATION, CADENCE))


def photometry(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as photometry: frame (week), star, counts, error, airmass, fwhm."""
    rows = table(spark, folder, "lineitem").select(F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("week"), F.col("l_linenumber").alias("star"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return rows.groupBy(F.unix_date(F.to_date("week")).alias("frame"), "star").agg(
        F.sum("l_extendedprice").alias("counts"), F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("error"), F.avg("l_discount").alias("airmass"), F.avg("l_tax").alias("fwhm")
    )


CURVES = f"""curves as (select event_id, user_id as series, event_type as sector, epoch_us(ts) as us, value as flux, cast(json_extract_string(props, '$.k') as int) as k from events),
lc as (select *, us / 86400000000.0::double as t, 1.0::double + (k % 7) * 0.125::double as error, case when k % 17 = 0 then 1 else 0 end as quality from curves),
lcg as (select *, flux is not null and error > 0 and quality = 0 as good from lc)"""
PHASED = CURVES + f""",
ph0 as (select *, (((t - {T0}::double + {PERIOD / 2}::double) % {PERIOD}::double + {PERIOD}::double) % {PERIOD}::double) - {PERIOD / 2}::double as phase,
  cast(round_even((t - {T0}::double) / {PERIOD}::double, 0) as bigint) as cycle from lcg where good),
ph as (select *, greatest(0, least(1, (least(phase + {CADENCE / 2}::double, {DURATION / 2}::double) - greatest(phase - {CADENCE / 2}::double, {-DURATION / 2}::double)) / {CADENCE}::double)) as box from ph0)"""
PHOTOMETRY = """phot as (select date_diff('day', date '1970-01-01', cast(date_trunc('week', l_shipdate) as date)) as frame, l_linenumber as star,
  sum(l_extendedprice) as counts, sqrt(sum(l_quantity * l_quantity)) as error, avg(l_discount) as airmass, avg(l_tax) as fwhm from lineitem group by all)"""
