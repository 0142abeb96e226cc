"""Structured Streaming over arriving measurements."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def arriving(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of a folder or pattern as a stream, in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def time_bins(stream: DataFrame, ts: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """by, start, n, mean, low, high in tumbling windows; rows later than `late` are left out once
    their window is closed. Works on a table as well."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
    out = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "mean", "low", "high")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str = "12 hours", late: str | None = "1 hour") -> DataFrame:
    """by, start, end, n: runs of rows no further apart than gap. Rows later than `late` are left out,
    in complete mode too; None takes every row, whatever the order of the batches (complete mode only,
    as no session is ever closed)."""
    rows = (stream.withWatermark(ts, late) if late else stream).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: Of a row that waits, and of the last accepted row of a key.
_HELD = {"key": np.int64, "at": np.int64, "tie": np.int64, "accepted": bool, "value": float}


def _packed(rows: list[np.ndarray]) -> bytes | None:
    if not len(rows[0]):
        return None
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=[*_HELD])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _joined(held: bytes | None, parts: Iterable[pd.DataFrame] = ()) -> list[np.ndarray]:
    """Columns of what is held and of the rows that came."""
    old = [[c.to_numpy() for c in pa.ipc.open_stream(held).read_all().columns]] if held else []
    new = [[p[c].to_numpy() for c in _HELD] for p in parts]
    return [np.concatenate(x) for x in zip(*old, *new, strict=True)] if old or new else [np.empty(0, t) for t in _HELD.values()]


def _let_out(rows: list[np.ndarray], last: list[np.ndarray], until: int, expire: int | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """key, at, tie and guess of the rows before until, those that wait on, and each key's last accepted row then; microseconds."""
    due = rows[1] < until
    out, rest = [x[due] for x in rows], [x[~due] for x in rows]
    if due.any():
        both = [np.concatenate(x) for x in zip(last, out, strict=True)] if len(last[0]) else out
        came = np.arange(len(both[0])) >= len(last[0])
        key = pd.factorize(both[0])[0]
        order = np.lexsort((both[2], both[1], came, key))  # stable: rows alike stay as they came
        both, key, came = [x[order] for x in both], key[order], came[order]
        at, accepted, value = both[1], both[3], both[4]
        latest = np.maximum.accumulate(np.where(accepted, np.arange(len(key)), -1))
        before = np.append(-1, latest[:-1])
        known = (before >= 0) & (key[before] == key)
        if expire is not None:
            known &= at - at[before] <= expire
        out = [x[came] for x in (*both[:3], np.where(known, value[before], np.nan))]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        kept = latest[ends[(latest[ends] >= 0) & (key[latest[ends]] == key[ends])]]
        last = [x[kept] for x in both]
    if expire is not None:
        fresh = until - last[1] <= expire
        last = [x[fresh] for x in last]
    return out, rest, last


def _previous_of(names: list[str], bucketed: bool, expire: int | None):
    """What a group does with a batch: rows wait in its state until the watermark has passed them, then come out in order of
    time, each with the value of the last accepted row of its key before it."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = state.get if state.exists else (None, None)
        rows = _joined(waiting) if state.hasTimedOut else _joined(waiting, parts)
        out, rest, last = _let_out(rows, _joined(last), state.getCurrentWatermarkMs() * 1000, expire)
        if len(rest[0]) or len(last[0]):
            state.update((_packed(rest), _packed(last)))
            wake = rest[1] if expire is None else np.append(rest[1], last[1] + expire)
            if len(wake):
                state.setTimeoutTimestamp(int(wake.min()) // 1000)
        elif state.exists:
            state.remove()
        if len(out[0]):
            keys = out[0] if bucketed else pd.Series([group[0]] * len(out[0]), dtype=object)
            yield pd.DataFrame(dict(zip(names, (keys, out[1], out[2], out[3]), strict=True)), dtype=object)

    return step


def previous_accepted(stream: DataFrame, key: str, ts: str, tie: str, accepted: str, value: str, late: str = "1 hour", expire_ms: int | None = None, buckets: int = 256) -> DataFrame:
    """key, at_us, tie, guess: for each row the value of the last accepted row of its key before it in
    time (rows of one time by tie), null where there is none or it is older than expire_ms.

    Rows may come in any order within `late`: each waits in state until the watermark has passed
    it, and an event-time timeout lets it out. Rows later than that are left out and counted by Spark as dropped,
    rather than guessed wrongly. State is what came within `late`, and one value a key, which goes when it expires.
    Whole numbers and strings as keys share their state by bucket, as a group costs as much as hundreds of rows; a checkpoint
    is for one number of buckets. Other keys have a group each.
    Rows without key or time, or from before 1970, where watermarks begin, are left out; a null value is a value; tie is a long. Needs the RocksDB state store, which run_once sets.
    """
    rows = stream.filter(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).filter("_ts is not null").withWatermark("_ts", late)
    kind = stream.schema[key].dataType.simpleString()
    bucketed = kind in ("tinyint", "smallint", "int", "bigint", "string")
    group, key_in = (F.pmod(F.hash(key), F.lit(buckets)), F.col(key)) if bucketed else (F.col(key), F.lit(0).cast("long"))
    rows = rows.select(group.alias("group"), key_in.alias("key"), "_ts", F.unix_micros("_ts").alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.coalesce(F.col(accepted), F.lit(False)).alias("accepted"), F.col(value).cast("double").alias("value"))
    step = _previous_of([key, "at_us", tie, "guess"], bucketed, None if expire_ms is None else expire_ms * 1000)
    return rows.groupBy("group").applyInPandasWithState(step, f"`{key}` {kind}, at_us long, `{tie}` long, guess double", "waiting binary, last binary", "append", "EventTimeTimeout")


def landed(rows: DataFrame, folder: str, number: Column) -> None:
    """rows as files that arrive in order of number, as frames of a night land one by one.

    A stream takes files by the time of their last write, which tasks of one job don't keep in order, so the rows are
    written aside at once and each number's file is then put in place by a job of its own.
    """
    spark, aside = rows.sparkSession, f"{folder}-{uuid.uuid4().hex}"
    staged = rows.withColumn("_n", number)
    staged.repartition("_n").write.partitionBy("_n").parquet(aside)
    numbers = spark.read.schema(staged.schema).parquet(aside).select("_n").distinct().orderBy("_n").collect()  # a few, one a file
    for n in ("__HIVE_DEFAULT_PARTITION__" if r[0] is None else r[0] for r in numbers):
        spark.read.schema(rows.schema).parquet(f"{aside}/_n={n}").write.mode("append").parquet(f"{folder}/_n={n}")


def partitions_for(rows: DataFrame) -> int:
    """As many partitions of state as rows need that a stream will bring: a million each, but one a core, and no more than shuffles have.
    A partition costs every batch a state store and a call of Python, however few its rows."""
    spark = rows.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows.count() // 1_000_000)))


def run_once(result: DataFrame, table: str, checkpoint: str, mode: str = "complete", partitions: int | None = None) -> None:
    """Run a stream over all that is there; in complete mode each batch's result replaces the table at a
    path, in append mode each batch has a folder of its own there, which a repeated batch replaces. partitions are those of
    its state, which a checkpoint keeps from its first batch on."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={number}")

    conf = result.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(partitions or before))
    try:
        stream = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # has its own copy of the settings
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
    stream.awaitTermination()
