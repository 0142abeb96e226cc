"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree of domain, language and source. A node's budget is shared among
its children by weight; a child that can't use its share (its tokens times the most epochs) is given
what it can use, and the rest is shared again among its siblings. As a node is never given more than
its leaves can use together, a shortage reaches an ancestor's siblings only when the node's own
children are all full. Each level is one closed form over a window: with children in order of
capacity over weight, the full ones come first.

A leaf runs through its documents in seeded orders, one an epoch: all of the full epochs, and of the
next the longest prefix whose tokens fit. Where that prefix ends is found by sums over 4096 ranges
of the order, over 4096 within one of them, and within one of these over documents, so no leaf has to
be sorted in one task (of 10^10 documents 600 are); the end is a single value a leaf, and documents
are chosen by comparing with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hinted

#: Share of the corpus's tokens that is asked for, the most epochs of a leaf, and the seed.
SHARE, EPOCHS, SEED = 0.6, 3, "mix-1"
#: Weights by value for each level of the tree; other values have 1.
WEIGHTS = {"domain": {"web": 3.0, "books": 1.0}, "lang": {"en": 1.0, "de": 2.0, "fr": 2.0, "es": 4.0}, "source": {"src0": 2.0, "src1": 0.5}}
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a place that name its range, coarse and fine.
RANGES = (3, 6)
_SPACE = " \t\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SPACE, " " * len(_SPACE))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def domain_of(source: Column) -> Column:
    """Sources src0 to src9 are web, higher ones books, and others of neither."""
    n = F.regexp_extract(source, "^src([0-9]{1,6})$", 1)
    return F.when(n == "", "other").when(n.cast("int") < 10, "web").when(n.cast("int") >= 10, "books").otherwise("other")


def _weight(level: str, weights: dict) -> Column:
    out = F.lit(None).cast("double")
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def budgets(leaves: DataFrame, weights: dict, share: float, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget, the tokens each is to give."""
    positive = F.lit(True)
    for level in LEVELS:
        positive = positive & (_weight(level, weights) > 0)
    leaves = leaves.withColumn("capacity", F.when(positive, F.col("tokens") * epochs).otherwise(F.lit(0)).cast("double"))
    total = leaves.agg(F.sum("tokens").cast("double").alias("t"), F.sum("capacity").alias("c"))
    given = total.select(F.least(F.floor(F.col("t") * share).cast("double"), F.col("c")).alias("given"), F.lit(1).alias("all"))
    above: list[str] = ["all"]
    for level in LEVELS:
        here = [*above, level]
        nodes = leaves.withColumn("all", F.lit(1)).groupBy(*here).agg(F.sum("capacity").alias("capacity")).withColumn("w", _weight(level, weights))
        same = [nodes[c].eqNullSafe(given[c]) for c in above]
        on = same[0]
        for x in same[1:]:
            on = on & x
        nodes = nodes.join(given, on).select(*[nodes[c] for c in here], nodes["capacity"], "w", "given")
        kin = Window.partitionBy(*above)
        order = kin.orderBy(F.when(F.col("w") > 0, F.col("capacity") / F.greatest("w", F.lit(1e-300))).otherwise(0.0), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
        others = F.sum("w").over(kin) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
        nodes = nodes.withColumn("rate", F.when(others > 0, left / F.greatest(others, F.lit(1e-300))).otherwise(0.0)).withColumn("n", F.row_number().over(order))
        nodes = nodes.withColumn("full", F.col("capacity") <= F.col("w") * F.col("rate"))
        first = F.min(F.when(~F.col("full"), F.struct("n", "rate"))).over(kin)
        nodes = nodes.withColumn("first", first)
        share_of = F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), F.col("capacity")).otherwise(F.col("w") * F.col("first.rate"))
        given = nodes.select(*here, share_of.alias("given"))
        above = here
    own = given.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return leaves.join(own, on).select(*LEVELS, "tokens", "budget")


def leaf_plan(docs: DataFrame, doc_id: Column, levels: dict[str, Column], text: Column, weights: dict = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per leaf: domain, lang, source, tokens, budget, whole (epochs taken in full) and last,
    where the prefix of the next epoch ends in its order ('' if nothing of it fits)."""
    ids = checkpointed(docs.select(F.coalesce(doc_id.cast("string"), F.lit("null")).alias("name"), *[levels[c].alias(c) for c in LEVELS], tokens(text).alias("n")))
    leaves = checkpointed(budgets(ids.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), weights, share, epochs))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long")
    leaves = leaves.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    named = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "whole", "rest")
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ids = ids.join(hinted(named, 100), on).select(*LEVELS, "n", "rest", place(F.col("name"), F.col("whole"), seed).alias("place"))
    ids, found = ids.withColumn("before", F.lit(0).cast("long")), []
    for digits in RANGES:
        parts = ids.groupBy(*LEVELS, F.substring("place", 1, digits).alias("part"), "rest", "before").agg(F.sum("n").alias("n"), F.max("place").alias("end"))
        parts = checkpointed(parts.withColumn("up_to", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part"))))
        found.append(parts.filter("up_to <= rest").groupBy(*LEVELS).agg(F.max("end").alias("end")))
        cut = parts.filter("up_to > rest").groupBy(*LEVELS).agg(F.min(F.struct("part", (F.col("up_to") - F.col("n")).alias("before"))).alias("cut"))
        cut = cut.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.col("cut.part").alias("_part"), F.col("cut.before").alias("before"))
        ids = ids.drop("before").join(hinted(cut, 100), on & (F.substring("place", 1, digits) == F.col("_part"))).drop(*[f"_{c}" for c in LEVELS], "_part")
    inner = ids.withColumn("up_to", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place")))
    ends = inner.filter("up_to <= rest").groupBy(*LEVELS).agg(F.max("place").alias("end"))
    for part in found:
        ends = ends.unionByName(part)
    ends = ends.groupBy(*LEVELS).agg(F.max("end").alias("last"))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "last")
    return leaves.join(ends, on, "left").select(*LEVELS, "tokens", "budget", "whole", F.coalesce("last", F.lit("")).alias("last"))


def place(name: Column, epoch: Column, seed: str) -> Column:
    """Where a document stands in an epoch's order."""
    return F.md5(F.concat(F.lit(seed + "|"), epoch.cast("string"), F.lit("|"), name))


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, **settings) -> DataFrame:
    """The rows of docs that are taken, with __domain and __times, the number of epochs they are in."""
    levels = {"domain": domain if domain is not None else domain_of(F.col(source)), "lang": F.col(lang), "source": F.col(source)}
    plan = leaf_plan(docs, F.col(doc_id), levels, F.col(text), **settings)
    plan = checkpointed(plan.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("whole").alias("__whole"), F.col("last").alias("__last")))
    on = F.lit(True)
    for c in LEVELS:
        on = on & levels[c].eqNullSafe(F.col(f"__{c}"))
    here = place(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("__whole"), settings.get("seed", SEED))
    times = F.col("__whole") + (here <= F.col("__last")).cast("long")
    taken = docs.join(hinted(plan, 150), on).withColumn("__times", times).filter("__times > 0")
    return taken.select(*[docs[f"`{c}`"] for c in docs.columns], "__domain", "__times")


def mixture(docs: DataFrame, *columns, **settings) -> DataFrame:
    """docs, a row for each epoch a row is taken in, with __domain and __epoch appended.

    Texts without tokens weigh nothing and go by their place in the order. Rows of one leaf with
    equal doc_ids stand together, as do those without doc_id; a prefix takes all of them or none.
    Null languages and sources are leaves of their own, of weight 1. An empty table gives an empty
    result. Columns named domain, n or the like may stand in docs; they play no part.
    """
    taken = counted(docs, *columns, **settings)
    epochs = F.explode(F.sequence(F.lit(0), F.col("__times").cast("int") - 1))
    return taken.withColumn("__epoch", epochs).drop("__times")


def chosen(docs: DataFrame) -> DataFrame:
    """What mixture() takes: doc_id, domain, lang, source, n_tokens and in how many epochs."""
    taken = counted(docs)
    return taken.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", tokens(F.col("text")).alias("n_tokens"), F.col("__times").alias("epochs"))


def _case(level: str) -> str:
    cases = " ".join(f"when {level} = '{v}' then {w}::double" for v, w in WEIGHTS[level].items())
    return f"case {cases} else 1.0::double end"


def _level(name: str, over: str, level: str, parent: list[str]) -> str:
    """One level of the tree in SQL: table name from the budgets in table over."""
    here, up = ", ".join([*parent, level]), ", ".join(parent) or "1"
    same = " and ".join(f"a.{c} is not distinct from g.{c}" for c in parent) or "true"
    cols = ", ".join(f"a.{c} as {c}" for c in [*parent, level])
    return f"""
{name}_a as (select {here}, sum(capacity) as capacity, {_case(level)} as w from leaves group by {here}),
{name}_b as (select {cols}, a.capacity as capacity, a.w as w, g.given as given from {name}_a a join {over} g on {same}),
{name}_c as (select *, row_number() over (partition by {up} order by capacity / w, {level} nulls first) as n,
  (given - coalesce(sum(capacity) over (partition by {up} order by capacity / w, {level} nulls first rows between unbounded preceding and 1 preceding), 0))
  / (sum(w) over (partition by {up}) - coalesce(sum(w) over (partition by {up} order by capacity / w, {level} nulls first rows between unbounded preceding and 1 preceding), 0)) as rate from {name}_b),
{name}_d as (select *, min(case when capacity > w * rate then n end) over (partition by {up}) as f from {name}_c),
{name}_e as (select *, max(case when n = f then rate end) over (partition by {up}) as r from {name}_d),
{name} as (select {here}, case when f is null or n < f then capacity else w * r end as given from {name}_e)"""


SQL = rf"""
with d as (select doc_id, lang, source, case when regexp_extract(source, '^src([0-9]+)$', 1) = '' then 'other' when cast(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') as integer) < 10 then 'web'
  when cast(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') as integer) >= 10 then 'books' else 'other' end as domain,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n from documents),
leaves as (select domain, lang, source, sum(n)::bigint as tokens, (sum(n) * {EPOCHS})::double as capacity from d group by domain, lang, source),
root as (select least(floor(sum(tokens)::double * {SHARE}::double), sum(capacity)) as given from leaves),
{_level("l1", "root", "domain", []).strip()},
{_level("l2", "l1", "lang", ["domain"]).strip()},
{_level("l3", "l2", "source", ["domain", "lang"]).strip()},
plan as (select l.domain as domain, l.lang as lang, l.source as source, tokens, cast(floor(given + 0.000001) as bigint) as budget,
  case when tokens > 0 then cast(floor(given + 0.000001) as bigint) // tokens else 0 end as whole
  from leaves l join l3 on l.domain is not distinct from l3.domain and l.lang is not distinct from l3.lang and l.source is not distinct from l3.source),
p as (select d.*, plan.whole as whole, plan.budget - plan.whole * plan.tokens as rest,
  md5('{SEED}|' || cast(whole as varchar) || '|' || coalesce(cast(doc_id as varchar), 'null')) as place
  from d join plan on d.domain is not distinct from plan.domain and d.lang is not distinct from plan.lang and d.source is not distinct from plan.source),
q as (select *, sum(n) over (partition by domain, lang, source order by place) as up_to from p)
select doc_id, domain, lang, source, n as n_tokens, cast(whole + case when up_to <= rest then 1 else 0 end as bigint) as epochs
from q where whole + case when up_to <= rest then 1 else 0 end > 0
"""
