"""Sessions over files that arrive in no order of time, in several batches."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skylathe.plans import advanced
from skylathe.streaming import frames


def test_sessions_of_late_files_are_those_of_the_table(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 20_000).alias("ts"))
    (tmp_path / "d").mkdir()
    for day in (2, 0, 1):  # files arrive later days first
        rows.filter(f"floor(unix_seconds(ts) / 400000) = {day}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d/events.parquet")
    arriving = frames.arriving
    monkeypatch.setattr(frames, "arriving", lambda s, path, schema: arriving(s, f"{tmp_path}/d/events.parquet", schema, 1))
    got = advanced.stream_sessions(spark, f"{tmp_path}/d").collect()
    want = frames.sessions(rows, "ts", ["user_id"], late=None)
    want = want.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n").collect()
    assert sum(r.n for r in got) == 60
    assert sorted(map(str, got)) == sorted(map(str, want))


def _guesses(rows, expire=None):
    """(key, tie) to the last accepted value before it in time, row by row."""
    want, last = {}, {}
    for k, at, tie, v, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        held = last.get(k)
        want[k, tie] = held[1] if held and (expire is None or at - held[0] <= expire) else None
        if ok:
            last[k] = (at, v)
    return want


def _run(spark, path, batches, end, **options):
    """The rows of a stream whose files come one a batch, and after them a mark that lets out what waits."""
    kind = "k long, at long, tie long, v double, ok boolean"

    def land(rows, n):
        spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{path}/in/{n:03d}")
        time.sleep(1.1)  # files are taken by age

    def run():
        schema = spark.read.parquet(f"{path}/in/000").schema
        stream = frames.arriving(spark, f"{path}/in/*", schema, files_a_batch=1)
        frames.run_once(frames.previous_accepted(stream, "k", "ts", "tie", "ok", "v", **options), f"{path}/out", f"{path}/state", "append")
        return spark.read.parquet(f"{path}/out").filter("k >= 0")

    for n, rows in enumerate(batches):
        land(rows, n)
    before = run().count()
    land([(-1, end, 0, None, False)], 999)
    return before, run()


def test_shuffled_batches_give_what_the_ordered_table_gives(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, 10_000 + 100 * i + k % 3, 1000 * k + i, float(10 * i + k), i % 4 == k % 4) for i in range(40) for k in range(5)]
    rows += [(k, 10_000 + 100 * i + k % 3, 1000 * k + 500 + i, float(-i), True) for i in range(0, 40, 7) for k in range(2)]  # ties in time
    batches = [[] for _ in range(6)]
    for r in rows:
        batches[min(5, max(0, (r[1] - 10_000) // 800 + rng.choice([-1, 0, 0, 1])))].append(r)
    for b in batches:
        rng.shuffle(b)
    before, out = _run(spark, tmp_path, batches, 10_000_000, late="40 minutes")
    assert 0 < before < len(rows)  # most came out before the end, the rest waited
    assert {(r.k, r.tie): r.guess for r in out.collect()} == _guesses(rows)
    assert out.count() == len(rows) and out.select("batch").distinct().count() > 2


def test_too_late_rows_give_nothing_and_values_expire(spark, tmp_path):
    first = [(1, 10_000, 1, 1.0, True), (1, 20_000, 2, 2.0, True), (2, 20_000, 3, None, True)]
    later = [(1, 10_500, 9, 9.0, True), (1, 21_000, 4, 4.0, False), (1, 26_000, 5, 5.0, True), (1, 26_100, 6, 6.0, False), (2, 20_500, 7, 7.0, False)]
    _, out = _run(spark, tmp_path, [first, [(3, 22_000, 8, 8.0, False)], later], 10_000_000, late="2000 seconds", expire_ms=3_000_000)
    got = {(r.k, r.tie): r.guess for r in out.collect()}
    assert (1, 9) not in got  # later than the watermark: no row, and no wrong guess for others
    assert got == _guesses([*first, (3, 22_000, 8, 8.0, False), *later[1:]], expire=3000)


def test_many_keys_share_a_state_by_bucket(spark, tmp_path):
    """A state a key costs some ten milliseconds a key and batch, so more keys than buckets mustn't make more of them."""
    batches = [[(k, 10_000 * (b + 1) + k, b, float(b), k % 2 == b % 2) for k in range(1, 301)] for b in range(3)]
    _, out = _run(spark, tmp_path, batches, 10_000_000, late="5000 seconds", buckets=16)
    assert {(r.k, r.tie): r.guess for r in out.collect()} == _guesses([r for b in batches for r in b])
    assert out.count() == 900
    held = spark.read.format("statestore").load(f"{tmp_path}/state").count()
    assert 0 < held <= 16


def test_state_has_as_many_partitions_as_rows_need(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert frames.partitions_for(spark.range(1_000_000 * cores + 1)) == cores + 1
        frame = spark.range(20).select("id", F.col("id").alias("tie"), F.timestamp_seconds(F.col("id") + 100).alias("ts"), (F.col("id") > 3).alias("ok"))
        frames.landed(frame, f"{tmp_path}/in", F.lit(0))
        stream = frames.arriving(spark, f"{tmp_path}/in/*", frame.schema)
        frames.run_once(frames.previous_accepted(stream, "id", "ts", "tie", "ok", "id"), f"{tmp_path}/out", f"{tmp_path}/state", "append", frames.partitions_for(frame))
        assert len([p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]) == cores
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_of_any_kind(spark, tmp_path):
    rows = [(1 + i % 4, 10_000 + 100 * i, i, None if i % 7 == 0 else float(i), i % 3 == 0) for i in range(60)]
    want = _guesses(rows)
    frame = spark.createDataFrame(rows, "n long, at long, tie long, v double, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    frames.landed(frame, f"{tmp_path}/in", F.floor(F.col("tie") / 20))
    end = spark.createDataFrame([(9, 10_000_000, 0, None, False)], "n long, at long, tie long, v double, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    frames.landed(end, f"{tmp_path}/in", F.lit(1 << 20))
    for name, k in (("string", F.concat(F.lit("key "), "n")), ("date", F.date_add(F.lit("2024-01-01"), F.col("n").cast("int"))), ("long", (1 << 60) + F.col("n"))):
        stream = frames.arriving(spark, f"{tmp_path}/in/*", frame.schema, 1).withColumn("k", k)
        frames.run_once(frames.previous_accepted(stream, "k", "ts", "tie", "ok", "v", late="30 minutes"), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", "append")
        keys = {str(r.k): r.n for r in frame.select(k.alias("k"), "n").distinct().collect()}
        out = spark.read.parquet(f"{tmp_path}/{name}").filter("at_us < 1000000000000").collect()
        assert {(keys[str(r.k)], r.tie): r.guess for r in out} == want and len(out) == 60, name


@pytest.mark.parametrize("expire", [None, 900])
def test_rows_let_out_in_steps_are_those_of_a_plain_loop(expire):
    rng = random.Random(3)
    rows = [(rng.randrange(6), 1_000 + 50 * rng.randrange(60), n, rng.choice([None, float(n)]), rng.random() < 0.3) for n in range(300)]
    rows.sort(key=lambda r: r[1] + rng.randrange(300))
    waiting = last = frames._joined(None)
    got, until = {}, 0
    for n in range(0, 301, 60):
        part = pd.DataFrame(rows[n : n + 60], columns=["key", "at", "tie", "value", "accepted"]).astype({"accepted": bool, "value": float})
        out, waiting, last = frames._let_out(frames._joined(frames._packed(waiting), [part]), frames._joined(frames._packed(last)), until, expire)
        got |= {(k, t): None if np.isnan(g) else g for k, _, t, g in zip(*out, strict=True)}
        until = 10_000 if n == 240 else max(until, rows[min(n + 59, 299)][1] - 600)
    assert got == _guesses(rows, expire) and not len(waiting[0])


def test_files_land_in_order_of_number(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a small table's files would all be one task's
    try:
        frames.landed(spark.range(600_000).toDF("id"), f"{tmp_path}/in", F.when(F.col("id") < 12, F.col("id") - 1).otherwise(-1))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    written = {int(p.parent.name[3:]): p.stat().st_mtime_ns for p in tmp_path.glob("in/_n=*/*.parquet")}
    assert sorted(written) == list(range(-1, 11)) == sorted(written, key=written.get)
    assert spark.read.parquet(f"{tmp_path}/in").count() == 600_000
