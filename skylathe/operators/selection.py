"""Selections: best of a key, duplicates, greedy picks, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def best_of_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_k", "_n")


def resolved_duplicates(df: DataFrame, key: list[str], prefer: list[Column], identity: list[str]) -> DataFrame:
    """key, copies, chosen (the struct of prefer that comes first), conflict: copies that differ."""
    same = F.count_distinct(F.struct(*identity))
    return df.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct(*prefer)).alias("chosen"), (same > 1).alias("conflict"))


def peaks(df: DataFrame, by: list[str], x: str, power: str, apart: float, most: int) -> DataFrame:
    """by, rank, x, power: peaks in order of power, each at least `apart` from all kept before it, at
    most `most`.

    A group's candidates are folded in one array, so this is for grids of bounded size.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col(power)).alias("p"), F.col(x).alias("x"))))
    start = F.array().cast("array<struct<p:double,x:double>>")
    keep = lambda kept, c: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k["x"] - c["x"]) < apart), F.concat(kept, F.array(c))).otherwise(kept)
    return df.groupBy(*by).agg(F.aggregate(order, start, keep).alias("kept")).select(*by, F.posexplode("kept").alias("rank", "k")).select(*by, (F.col("rank") + 1).alias("rank"), F.col("k.x").alias(x), (-F.col("k.p")).alias(power))


def spaced_stars(df: DataFrame, by: list[str], x: str, y: str, flux: str, apart: float, most: int | None = None, view: int = 8) -> DataFrame:
    """by, rank, x, y, flux: sources in order of flux (then x, y), each no nearer than `apart` to one kept
    before it, at most `most` of a group.

    Every round works on all groups at once, over cells of side `apart`. A cell shows its `view` best
    undecided sources to the cells around it; a source that outranks all it could collide with is kept, as
    the greedy order would, and what lies within reach of it goes. Kept sources lie apart, so a
    cell holds four at most, and no step pairs more than a source with the kept ones around it. Rows that lack a value
    are left out, equal rows count once.
    """
    if apart <= 0:
        raise ValueError("sources must be a positive distance apart")
    star = F.struct((-F.col(flux).cast("double")).alias("f"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    own = [F.col(b).alias(f"_{i}") for i, b in enumerate(by)]
    groups = [f"_{i}" for i in range(len(by))]
    cell = [*groups, "cx", "cy"]
    open_ = df.filter(F.col(flux).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(*own, star.alias("s")).distinct()
    open_ = cut(open_.select("*", F.floor(F.col("s.x") / apart).alias("cx"), F.floor(F.col("s.y") / apart).alias("cy")))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = lambda rows, *columns: rows.withColumn("_d", F.explode(steps)).select(*groups, (F.col("cx") + F.col("_d.i")).alias("cx"), (F.col("cy") + F.col("_d.j")).alias("cy"), *columns)
    reach = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]) < apart
    other = [f"{c}_" for c in cell]
    same = [F.col(c).eqNullSafe(F.col(o)) if c in groups else F.col(c) == F.col(o) for c, o in zip(cell, other, strict=True)]
    kept = None
    while not open_.isEmpty():
        best = open_.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("s"))).filter(F.col("_n") <= view)
        lists = best.groupBy(*cell).agg(F.sort_array(F.collect_list("s")).alias("own"))
        last = F.when(F.size("own") == view, F.element_at("own", -1))  # what the cell doesn't show ranks below
        seen = around(lists, "own", last.alias("last")).groupBy(*cell).agg(F.flatten(F.collect_list("own")).alias("seen"), F.min("last").alias("last")).toDF(*other, "seen", "last")
        free = F.filter("own", lambda c: (F.col("last").isNull() | (c <= F.col("last"))) & ~F.exists("seen", lambda t: (t < c) & reach(t, c)))
        new = cut(lists.join(seen, same).select(*cell, F.explode(free).alias("k")))
        near = around(new, "k").toDF(*other, "k")
        left = open_.join(near, [*same, reach(F.col("s"), F.col("k"))], "left_anti")
        kept = new if kept is None else kept.unionByName(new)
        if most is not None:  # what ranks below a full group's last can't come in any more
            kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("k"))).filter(F.col("_n") <= most).drop("_n")
            full = kept.groupBy(*groups).agg(F.count("*").alias("n"), F.max("k").alias("k")).filter(F.col("n") == most).toDF(*other[: len(groups)], "n", "k")
            left = left.join(full, [*same[: len(groups)], F.col("s") > F.col("k")], "left_anti")
        kept, open_ = cut(kept), cut(left)
    if kept is None:
        kept = open_.select(*cell, F.col("s").alias("k"))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("k")))
    return ranked.select(*[F.col(f"_{i}").alias(b) for i, b in enumerate(by)], "rank", F.col("k.x").alias(x), F.col("k.y").alias(y), (-F.col("k.f")).alias(flux))


def parsimonious(df: DataFrame, by: list[str], score: str, parameters: str, name: str, passes: str, within: float = 1.01) -> DataFrame:
    """by, chosen: of the passing rows whose score is within a factor of the group's best, the one of
    fewest parameters, then best score, then name; 'none' if no row passes."""
    ok = df.withColumn("_s", F.when(F.col(passes), F.col(score)))
    ok = ok.withColumn("_b", F.min("_s").over(Window.partitionBy(*by)))
    near = F.when(F.col("_s") <= F.col("_b") * within, F.struct(parameters, "_s", name))
    return ok.groupBy(*by).agg(F.coalesce(F.min(near)[name], F.lit("none")).alias("chosen"))


def backward_elimination(df: DataFrame, frame: str, star: str, flux: str, target: str, least: int = 5, gain: float = 0.005) -> tuple[list[str], float]:
    """Comparison stars left, and the scatter: the star whose loss most lowers the robust scatter of
    target over the others' sum goes, while that gains `gain` and more than `least` stars are left.

    One grouped job a round tries all single losses together; the driver sees a row a star. Of equal
    scatters the first name goes.
    """
    from skylathe.operators.stats import mad_normalized

    stars = sorted(r[0] for r in df.select(star).distinct().collect())

    def scatters(names: list[str], lost: list[str]) -> dict[str, float]:
        rows = df.filter(F.col(star).isin(names)).select(frame, star, flux, target, F.explode(F.array(*map(F.lit, lost))).alias("lost"))
        sums = rows.filter(F.col(star) != F.col("lost")).groupBy("lost", frame).agg(F.sum(flux).alias("c"), F.first(target).alias("t"))
        return {r["lost"]: r["mad"] for r in mad_normalized(sums.withColumn("r", F.try_divide("t", "c")), ["lost"], "r").collect()}

    now = scatters(stars, [""])[""]
    while len(stars) > least:
        value, worst = min((s, n) for n, s in scatters(stars, stars).items())
        if value > now * (1 - gain):
            break
        stars, now = [s for s in stars if s != worst], value
    return stars, now
