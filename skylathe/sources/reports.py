"""Records of validation reports: fit summaries in FITS headers, archive answers in JSON, merged headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylathe.functions.expr import finite, set_bits

from . import fits

_CARDS = "array<struct<key:string,value:string,comment:string>>"


def fit_summaries(spark: SparkSession, path: str, unit: str = "TCE_1", column: str = "LC_DETREND") -> DataFrame:
    """path, sector, tic_id, release, sector_vector, sectors_used, time_rows, finite_rows, cadence_minutes, period_days,
    epoch, duration_hours, depth_ppt, statistic: a row for each file with a unit of that name.

    finite_rows counts the finite values of a column, which alone is read; null where a file has no such
    column. A missing release is -1.
    """
    heads = fits.read_headers(spark, path)
    value = lambda h, k, kind: F.try_element_at(F.col(h), F.lit(k)).try_cast(kind)
    first = heads.filter("hdu = 0").select("path", F.col("header").alias("p"))
    own = heads.filter(F.col("header")["EXTNAME"] == unit).select("path", "hdu", F.col("header").alias("h"))
    has = F.exists(F.map_entries("h"), lambda e: e["key"].startswith("TTYPE") & (e["value"] == column))
    rows = first.join(own, "path").withColumn("has", has)
    numbers = [r[0] for r in rows.filter("has").select("hdu").distinct().collect()]  # where the unit stands in a file: a few places
    counts = None
    for n in numbers:
        part = fits._source(spark, "fits_table", n).option("absent", "null").schema(f"path string, `{column}` double").load(path)
        part = part.groupBy("path").agg(F.count(finite(F.col(f"`{column}`"))).alias("finite")).withColumn("n", F.lit(n))
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        counts = spark.createDataFrame([], "path string, finite long, n int")
    rows = rows.join(counts.withColumnRenamed("path", "of"), (F.col("path") == F.col("of")) & (F.col("hdu") == F.col("n")), "left")
    vector = F.coalesce(value("p", "SECTORS", "string"), F.lit(""))
    return rows.select(
        "path", value("p", "SECTOR", "int").alias("sector"), value("p", "TICID", "long").alias("tic_id"), F.coalesce(value("p", "DATA_REL", "int"), F.lit(-1)).alias("release"), vector.alias("sector_vector"),
        set_bits(vector).alias("sectors_used"), value("h", "NAXIS2", "long").alias("time_rows"), F.when(F.col("has"), F.coalesce("finite", F.lit(0))).alias("finite_rows"),
        (value("h", "TIMEDEL", "double") * 1440).alias("cadence_minutes"), value("h", "TPERIOD", "double").alias("period_days"), value("h", "TEPOCH", "double").alias("epoch"), value("h", "TDUR", "double").alias("duration_hours"),
        (value("h", "TDEPTH", "double") / 1000).alias("depth_ppt"), value("h", "MAXMES", "double").alias("statistic"),
    )


_INFO = "`DV Data Header` struct<TICID:long,SECTORS:string,TPERIOD:double,TEPOCH:double,TDEPTH:double,TDUR:double,TSNR:double,MAXMES:double,NTRANS:int,TIMEDEL:double,TSTART:double,TSTOP:double>"


def read_event_info(spark: SparkSession, path: str) -> DataFrame:
    """path, tic_id, scope, period_days, epoch, depth_ppt, duration_hours, snr, statistic, transits, cadence_minutes,
    start, stop: the header that an archive's answer holds, a file a row. A file without one is an error."""
    rows = spark.read.schema(_INFO).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).select(F.input_file_name().alias("path"), F.col("DV Data Header").alias("h"))
    there = F.when(F.col("h").isNull(), F.raise_error(F.concat("path", F.lit(" has no DV Data Header"))).cast("long")).otherwise(F.col("h.TICID"))
    return rows.select(
        "path", there.alias("tic_id"), F.col("h.SECTORS").alias("scope"), F.col("h.TPERIOD").alias("period_days"), F.col("h.TEPOCH").alias("epoch"), (F.col("h.TDEPTH") / 1000).alias("depth_ppt"), F.col("h.TDUR").alias("duration_hours"),
        F.col("h.TSNR").alias("snr"), F.col("h.MAXMES").alias("statistic"), F.col("h.NTRANS").alias("transits"), (F.col("h.TIMEDEL") * 1440).alias("cadence_minutes"), F.col("h.TSTART").alias("start"), F.col("h.TSTOP").alias("stop"),
    )


def read_series_answers(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """path, rows, finite_rows, start, stop, depth_ppt, scopes: summary of the time series in an archive's answers.

    rows counts all, finite_rows those with a finite LC_DETREND; start and stop are the least and largest finite TIME; the depth
    is a thousand times what MODEL_INIT falls below zero; scopes are the distinct SECTORS in order, joined. A file without rows is an error.

    With a key, files hold many answers, one a line, and that field of an answer, as a string, stands in place of path.
    A file an answer costs more to open than to read, so this is the form for a large archive.
    """
    row = "struct<TIME:double,LC_DETREND:double,MODEL_INIT:double,SECTORS:string>"
    told, by = (f"`{key}` string, ", key) if key else ("", "path")
    rows = spark.read.schema(f"{told}data array<{row}>").option("multiLine", str(not key).lower()).option("recursiveFileLookup", "true").json(path).select(F.input_file_name().alias("path"), *([F.col(f"`{key}`")] if key else []), "data")
    rows = rows.select(*([F.col(f"`{key}`")] if key else ["path"]), F.when(F.coalesce(F.size("data"), F.lit(0)) < 1, F.raise_error(F.concat("path", F.lit(" has no rows"))).cast(f"array<{row}>")).otherwise(F.col("data")).alias("data"))
    each = rows.select(F.col(f"`{by}`"), F.inline("data"))
    time, model = finite(F.col("TIME")), finite(F.col("MODEL_INIT"))
    return each.groupBy(f"`{by}`").agg(
        F.count("*").alias("rows"), F.count(finite(F.col("LC_DETREND"))).alias("finite_rows"), F.min(time).alias("start"), F.max(time).alias("stop"),
        (-F.min(model) * 1000).alias("depth_ppt"), F.array_join(F.sort_array(F.collect_set("SECTORS")), ";").alias("scopes"),
    )


#: Cards of a solution that say what its own file is, and sums that a change makes wrong.
OWN, SUMS = ["SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "COMMENT"], ["CHECKSUM", "DATASUM"]


def merged_cards(source: Column, solution: Column, added: Column | None = None) -> Column:
    """A header's cards (array of key, value, comment) with those of a solution, and of `added`, put in.

    Values and comments of keys that the header has are replaced where they stand, new keys follow in their order,
    HISTORY cards come last, the header's own first. The solution's cards about its own file and the header's sums are left
    out. Of a key that is told twice the last counts. null arrays are empty.
    """
    empty = F.array().cast(_CARDS)
    new = F.concat(F.filter(F.coalesce(solution, empty), lambda c: ~c["key"].isin(OWN)), F.coalesce(added, empty) if added is not None else empty)
    old = F.filter(F.coalesce(source, empty), lambda c: ~c["key"].isin(SUMS))
    history = lambda a: F.filter(a, lambda c: c["key"] == "HISTORY")
    plain = F.filter(new, lambda c: c["key"] != "HISTORY")
    last = lambda key: F.element_at(F.filter(plain, lambda c: c["key"] == key), -1)
    told = lambda a, key: F.exists(a, lambda c: c["key"] == key)
    kept = F.transform(F.filter(old, lambda c: c["key"] != "HISTORY"), lambda c: F.when(told(plain, c["key"]), last(c["key"])).otherwise(c))
    fresh = F.array_distinct(F.transform(F.filter(plain, lambda c: ~told(old, c["key"])), lambda c: c["key"]))
    return F.concat(kept, F.transform(fresh, last), history(old), history(new))
