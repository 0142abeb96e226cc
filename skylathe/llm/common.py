"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast limit for tables whose size the caller has counted (rows times bytes a row).
BROADCAST_BYTES = 8 << 20

#: Narrow rows of a task in tables whose rows are counted.
A_TASK = 1 << 16

#: Words of a sieve: 2 to this, 1 MB where the caller asks for no other size.
_SIEVE_BITS = 17

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where the session names none, a temporary one
    is set on a single machine, as in tests, and a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As checkpointed(), in as few partitions as its rows need, and how many rows: for narrow tables that
    several steps read, as each would start a task for every partition of the last shuffle."""
    df = checkpointed(df)
    return fewer(df, n := df.count()), n


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many narrow rows, in as few partitions as they need."""
    return df.coalesce(max(1, -(-rows // A_TASK)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide tables that Parquet holds in less. Such a
    table stays until the folder is cleared."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of written_at() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sieve(keys: DataFrame, key: str, size: int = _SIEVE_BITS) -> Column:
    """Words of a Bloom filter of the 64-bit hashes in a column, one bit each: an array of fixed
    size. A test with in_sieve() of the same size has no false negatives, so it may thin out one side ahead of a join."""
    word = F.shiftrightunsigned(F.xxhash64(key), 64 - size)
    words = keys.groupBy(word.alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    every = keys.sparkSession.range(1 << size).withColumnRenamed("id", "i").join(words, "i", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("words")).scalar()


def in_sieve(words: Column, key: Column, size: int = _SIEVE_BITS) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))
    return F.coalesce(F.get(words, F.shiftrightunsigned(F.xxhash64(key), 64 - size).cast("int")).bitwiseAND(bit) != 0, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def small_enough(df: DataFrame, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df holds at most limit bytes, found by counting no more rows than that allows."""
    most = limit // bytes_a_row
    return df.limit(most + 1).count() <= most


def hinted(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, marked for broadcast if its counted size is within BROADCAST_BYTES."""
    return F.broadcast(df) if small_enough(df, bytes_a_row) else df
