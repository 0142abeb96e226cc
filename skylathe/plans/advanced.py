"""Queries that fit models by group or run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from skylathe.operators import regression, windows
from skylathe.operators.cuts import shared_folder
from skylathe.streaming import frames

from .driver_tables import photometry, table
from .registered import register

QUERIES, ORACLES, query = register()


#: Candidate models over what the photometry table has; with `none`, eleven.
MODELS = {
    "airmass": ["airmass"],
    "width": ["fwhm"],
    "time": ["frame"],
    "meridian": ["meridian"],
    "error": ["error"],
    "airmass_width": ["airmass", "fwhm"],
    "airmass_time": ["airmass", "frame"],
    "width_time": ["fwhm", "frame"],
    "airmass_meridian": ["airmass", "meridian"],
    "airmass_width_time": ["airmass", "fwhm", "frame"],
}


def _modelled(spark, d):
    rows = windows.meridian_side(photometry(spark, d), ["star"], "frame", "airmass")
    level = F.percentile("counts", 0.5).over(Window.partitionBy("star"))
    return rows.withColumn("counts", F.col("counts") / level)


@query()
def blocked_cross_validation(spark, d):
    return regression.cross_validated(_modelled(spark, d), ["star"], ["frame"], "counts", MODELS)


@query()
def baseline_removed(spark, d):
    out = regression.without_baseline(_modelled(spark, d), ["star"], "counts", ["airmass", "fwhm"])
    return out.select("frame", "star", F.round("counts", 8).alias("counts"), F.round("corrected", 8).alias("corrected"))


def _streamed(spark, d, make, name="events", mode="complete"):
    source = table(spark, d, name)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = frames.arriving(spark, f"{d}/{name}.parque?", source.schema)
    frames.run_once(make(stream), f"{folder}/table", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/table")


@query("""select event_type, epoch_us(date_trunc('day', ts))::bigint as start_us, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by event_type, date_trunc('day', ts)""")
def stream_time_bins(spark, d):
    out = _streamed(spark, d, lambda s: frames.time_bins(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value"))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("mean", 6).alias("mean"), "low", "high")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 12 hours then 1 else 0 end as g from events),
s as (select user_id, ts, sum(g) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, epoch_us(min(ts))::bigint as start_us, epoch_us(max(ts))::bigint + 43200000000 as end_us, count(*) as n from s group by user_id, s""")
def stream_sessions(spark, d):
    out = _streamed(spark, d, lambda s: frames.sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], late=None))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""select user_id, event_id, last_value(case when value > 40 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as guess from events""")
def stream_late_accepted(spark, d):
    """events land in files that mix three neighbouring days; a last file of marks lets out what still waits."""
    day = F.unix_date(F.to_date("ts"))
    source = table(spark, d, "events").select("event_id", "user_id", "ts", "value", (F.col("value") > 40).alias("ok"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frames.landed(source, f"{folder}/in", F.floor((day + F.col("event_id") % 3) / 3))
    schema, partitions = spark.read.parquet(f"{folder}/in").drop("_n").schema, frames.partitions_for(source)
    make = lambda: frames.previous_accepted(frames.arriving(spark, f"{folder}/in/*", schema, 1), "user_id", "ts", "event_id", "ok", "value", late="7 days")
    frames.run_once(make(), f"{folder}/table", f"{folder}/state", "append", partitions)
    end = source.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 1000 days")).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("ok"))
    frames.landed(end, f"{folder}/in", F.lit(1 << 20))
    frames.run_once(make(), f"{folder}/table", f"{folder}/state", "append", partitions)
    return spark.read.parquet(f"{folder}/table").filter("user_id >= 0").select("user_id", "event_id", "guess")


@query("""select c_nationkey, c_custkey, last_value(case when c_acctbal > 5000 then c_acctbal end ignore nulls) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding) as guess from customer""")
def stream_previous_accepted(spark, d):
    """customers in four files that each reach over all keys; a key's order is its time, in seconds."""
    source = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", (F.col("c_acctbal") > 5000).alias("ok"), F.timestamp_seconds(F.col("c_custkey") + 86400).alias("ts"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    frames.landed(source, f"{folder}/in", F.pmod(F.hash("c_custkey"), F.lit(4)))
    partitions = frames.partitions_for(source)
    end = source.agg(F.lit(-1).cast("long").alias("c_nationkey"), F.max("c_custkey").alias("c_custkey"), F.lit(None).cast("double").alias("c_acctbal"), F.lit(False).alias("ok"), (F.max("ts") + F.expr("interval 40000 days")).alias("ts"))
    make = lambda: frames.previous_accepted(frames.arriving(spark, f"{folder}/in/*", source.schema, 1), "c_nationkey", "ts", "c_custkey", "ok", "c_acctbal", late="20000 days")
    frames.run_once(make(), f"{folder}/table", f"{folder}/state", "append", partitions)
    frames.landed(end, f"{folder}/in", F.lit(1 << 20))
    frames.run_once(make(), f"{folder}/table", f"{folder}/state", "append", partitions)
    return spark.read.parquet(f"{folder}/table").filter("c_nationkey >= 0").select("c_nationkey", "c_custkey", "guess")
