"""SimHash near-duplicates by pairs of blocks.

A 64-bit fingerprint is cut into four blocks of 16 bits. Fingerprints that differ in two bits or fewer
are equal in two blocks at least, so they share one of the six keys that two blocks make. Keys are
indexed, buckets of equal keys are paired and verified.

Pairs are taken between distinct fingerprints only, never between copies. A bucket that holds more
than BUCKET_PAIRS fingerprints is not paired: its members are indexed once more by the 65 points
within one bit of them. Two fingerprints share such a point exactly if they differ in two bits or
fewer, and a point has 65 members at most, so that way is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fewer, hinted

#: Largest bucket of equal keys that is paired directly.
BUCKET_PAIRS = 16
#: Fingerprints of a task that makes keys (six rows each), whatever the bytes that go in.
_KEYED = 1 << 17
#: A fingerprint of more than this part of all rows is joined by broadcast; there are fewer than its inverse.
_HOT = 1 / 10_000
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of one text; a null text or one without words has 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        spans = zip(first[at : at + _BLOCK], last[at : at + _BLOCK], strict=True)
        hashes = np.array([of(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(x) for x in batch], dtype="int64")


def distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b))


def _keys(fps: DataFrame) -> DataFrame:
    """fp, key: the six pairs of blocks, numbered above their 32 bits."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(block(p), 16).bitwiseOR(block(q)).bitwiseOR(F.lit(j << 32)) for j, (p, q) in enumerate(combinations(range(4), 2))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of the distinct fingerprints `fp` within two bits, or a set of such
    pairs that connects the same fingerprints where a bucket is too full to be paired."""
    fps = checkpointed(fps)
    keys = _keys(fps.repartition(max(1, -(-fps.count() // _KEYED)), "fp"))
    buckets = checkpointed(
        keys.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1")
    )
    near = distance("a", "b") <= 2
    two = buckets.filter("n = 2").select("a", "b").filter(near)
    members = checkpointed(keys.join(hinted(buckets.filter("n > 2").select("key", "n"), 16), "key"))
    few = members.filter(F.col("n") <= BUCKET_PAIRS)
    paired = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & near)
        .select("a", "b")
    )
    full = members.filter(F.col("n") > BUCKET_PAIRS).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    around = (
        full.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
        .groupBy("point")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("near"))
        .filter(F.size("near") > 1)
        .select("a", F.explode("near").alias("b"))
        .filter("a < b")
    )
    return two.unionByName(paired).unionByName(around).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) can reach.

    Alternating large-star and small-star steps; every round is checkpointed, and the driver sees
    only two sums that tell whether the round changed anything.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame, keep: Column) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(least, "u").filter(keep).select("u", "v", "m")

    edges, before = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), None
    while (now := state(edges)) != before:
        before, edges = now, fewer(edges, now[0])
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, F.col("v") > F.col("u")).select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        small = star(large.filter("v < u"), F.lit(True))
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = checkpointed(small.filter("a < b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest
    doc_id that is linked to it, itself included.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows
    are separate rows with equal values; rows whose doc_id is null link, but give no component_id.
    Other columns of docs are not read. An empty table gives an empty result. also holds further
    links, pairs (a, b) of xxhash64 of texts.
    """
    hashed = [F.xxhash64(text).alias("h")] if also is not None else []
    fps = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), *hashed, _fingerprints(F.col(text)).alias("fp")))
    groups = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    edges = links(groups.select("fp"))
    if also is not None:
        of = fps.groupBy("h").agg(F.min("fp").alias("fp"))
        further = also.join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        edges = edges.unionByName(further.filter("a != b")).distinct()
    roots = components(edges)
    labelled = checkpointed(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    linked = labelled.filter(F.col("root").isNotNull())
    joined = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = linked.join(joined, "root").select("fp", "rows", "component_id")
    label = checkpointed(label.unionByName(labelled.filter(F.col("root").isNull()).select("fp", "rows", F.col("least").alias("component_id"))))
    many = F.col("rows") > fps.count() * _HOT
    hot, rest = label.filter(many).select("fp", "component_id"), label.filter(~many).select("fp", "component_id")
    told = fps.join(F.broadcast(hot), "fp").unionByName(fps.join(F.broadcast(hot), "fp", "left_anti").join(rest, "fp"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: DataFrame | None = None) -> DataFrame:
    """docs without near-duplicates: the row whose doc_id is its group's component_id stays.

    Of rows that repeat a doc_id one stays; rows with a null doc_id all stay. Columns as in docs.
    also is as in near_duplicates.
    """
    found = near_duplicates(docs, doc_id, text, also).select("doc_id", "component_id")
    kept = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    kept = checkpointed(kept.select(F.col("doc_id").alias("__kept"), F.col("count").alias("__times")))
    once = docs.join(kept.filter("__times = 1"), F.col(doc_id) == F.col("__kept"), "left_semi")
    often = docs.join(kept.filter("__times > 1"), F.col(doc_id) == F.col("__kept"), "left_semi").dropDuplicates([doc_id])
    return once.unionByName(often).unionByName(docs.filter(F.col(doc_id).isNull()))
