"""One document of each group of near copies, edited ones included.

Two documents are near copies if their SimHash fingerprints differ in two bits or fewer (see simhash)
or if their distinct shingles of five words have a Jaccard similarity of at least 0.8. The latter come
from the exact join of linededup, for which a document is one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linededup, simhash
from .common import checkpointed


def _class_edges(join: linededup._Join) -> DataFrame:
    """a, b: pairs of alike classes that connect the same classes as all such pairs do.

    Each class is first held against the earliest class of each of its tokens; what that leaves in
    different groups is then held against each other, so a crowd of near copies isn't paired out.
    """
    earliest = join.earliest()
    stars = checkpointed(join.matching(earliest.join(join.side("y"), "t").filter("first_x < first_y")).toDF("a", "b"))
    roots = simhash.components(stars).toDF("k", "root")
    # the earliest of each token has been tried
    open_ = join.index.join(earliest.select("t", F.col("k_x").alias("tried")), "t").filter("k != tried").drop("tried")
    open_ = open_.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    mixed = open_.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("t")
    open_ = checkpointed(open_.join(mixed, "t"))
    side = lambda letter: open_.select("t", *[F.col(c).alias(f"{c}_{letter}") for c in ("k", "n", "i", "first", "bits", "root")])
    rest = join.matching(side("x").join(side("y"), "t").filter("k_x < k_y and root_x != root_y"))
    return stars.unionByName(rest.toDF("a", "b"))


def text_edges(docs: DataFrame) -> DataFrame:
    """a, b: pairs of hashes h of the texts of docs (doc_id, h, text) that connect all texts whose
    five-word shingles have a Jaccard similarity of 0.8 or more."""
    join = linededup._Join(docs.withColumn("text", F.translate("text", "\n", " ")), longs=8, held=linededup._LONG_SET)
    edges = _class_edges(join)
    first = join.classes.select("k", F.col("first.h").alias("h"))
    between = edges.join(first.toDF("a", "ha"), "a").join(first.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    within = join.rows.select("k", F.col("h").alias("b")).join(first.withColumnRenamed("h", "a"), "k").select("a", "b")
    return checkpointed(between.unionByName(within).filter("a != b").distinct())


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies, like simhash.one_of_each with both kinds of links."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return simhash.one_of_each(docs, doc_id, text, text_edges(rows))
