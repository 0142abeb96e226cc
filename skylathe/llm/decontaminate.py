"""Benchmark decontamination by winnowing.

A text's word k-grams are hashed, and of every `window` consecutive hashes the least is kept (the
leftmost of equal ones). Two texts that share k + window - 1 consecutive words keep the same gram of
them, so joining the kept grams of documents and items finds every such span. Each hit is extended
word by word, window - 1 words to either side: as any shared window holds a hit of its own, this
marks every word of every shared window. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checkpointed, hinted, small_enough

#: Consecutive words that count as a leak, and the gram that is hashed.
SPAN, GRAM = 10, 5
#: ASCII that parts words; letters, digits and everything beyond ASCII make them.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: A kept gram is one long: hash above, position in the low bits.
_POSITION_BITS = 28


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, UPPER.lower() + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _kept(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """rows (with an array words) with a row for each gram that winnowing keeps, in kept; null if
    there is none. (explode_outer: of explode, the optimizer infers a filter that would compute the
    arrays twice over.)"""
    span, low = gram + window - 1, (1 << _POSITION_BITS) - 1
    items = ", ".join(f"get(words, i + {j})" for j in range(gram))
    least = ", ".join(f"get(grams, i + {j})" for j in range(window))
    least = f"least({least})" if window > 1 else least
    return (
        rows.withColumn("grams", F.expr(f"if(size(words) >= {span}, transform(sequence(0, size(words) - {gram}), i -> (xxhash64({items}) & {~low}L) | i), null)"))
        .withColumn("kept", F.expr(f"if(grams is null, null, array_distinct(transform(sequence(0, size(grams) - {window}), i -> {least})))"))
        .drop("grams")
        .withColumn("kept", F.explode_outer("kept"))
    )


def _around(ext: int, gram: int) -> Column:
    """The words from ext before the gram at position p to ext behind it; null outside the text."""
    return F.array(*[F.expr(f"get(words, p + {j})") for j in range(-ext, gram + ext)])


def _p() -> Column:
    return F.expr(f"cast(kept & {(1 << _POSITION_BITS) - 1} as int)").alias("p")


def _key() -> Column:
    return F.shiftright("kept", _POSITION_BITS)


def _spans(docs: DataFrame, items: DataFrame, gram: int, window: int) -> DataFrame:
    """doc_id, h, item, start, end: word ranges of documents that items hold too, each of
    gram + window - 1 words at least."""
    ext = window - 1
    index = _kept(items, gram, window)
    index = checkpointed(index.select("item", _key().alias("key"), "words", _p()).select("item", "key", _around(ext, gram).alias("there")))
    keys = hinted(index.select("key").distinct(), 16)
    found = _kept(docs.withColumn("words", words(F.col("text"))), gram, window)
    found = found.select("doc_id", "h", "kept").join(keys.withColumnRenamed("key", "k"), _key() == F.col("k"), "left_semi")
    found = checkpointed(found.distinct())
    # the texts that have hits are read once more; the list of a document's hits is no longer than its text
    hits = found.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("g")).agg(F.collect_list("kept").alias("kept"))
    hits = F.broadcast(hits) if small_enough(found, 48) else hits
    texts = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")))
    here = texts.select("doc_id", "h", words(F.col("text")).alias("words"), F.explode("kept").alias("kept"))
    here = here.select("doc_id", "h", _key().alias("key"), "words", _p()).select("doc_id", "h", "key", "p", _around(ext, gram).alias("here"))
    both = here.join(hinted(index, 400), "key")
    same = [F.expr(f"coalesce(here[{j}] = there[{j}], false)") for j in range(gram + 2 * ext)]
    ends = [same[:ext][::-1], same[gram + ext :]]
    run = []
    for side in ends:  # how many words match in a row, going away from the gram
        n = F.lit(ext)
        for j in reversed(range(ext)):
            n = F.when(~side[j], F.lit(j)).otherwise(n)
        run.append(n)
    whole = F.lit(True)
    for x in same[ext : gram + ext]:
        whole = whole & x
    both = both.filter(whole).select("doc_id", "h", "item", (F.col("p") - run[0]).alias("start"), (F.col("p") + gram + run[1]).alias("end"))
    return both.filter(F.col("end") - F.col("start") >= gram + ext).distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is SPAN consecutive words of an item, or a whole item that has fewer (but not none).
    A document word inside any occurrence of a window is hit. Null and blank texts have no words;
    such items have no windows. Items are told apart by item_id; a null one counts as one item
    named null. Repeated rows give repeated equal rows. Other columns are not read. Without items,
    nothing is hit; without documents, the result is empty.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    name = F.coalesce(F.col(item_id).cast("string"), F.lit("null"))
    bench = checkpointed(items.select(name.alias("item"), words(F.col(item_text)).alias("words")).filter(F.size("words") > 0).distinct())
    lengths = [r[0] for r in bench.select(F.least(F.size("words"), F.lit(SPAN))).distinct().collect()]  # ten values at most
    spans = None
    for n in sorted(lengths):
        own = bench.filter(F.size("words") == n) if n < SPAN else bench.filter(F.size("words") >= SPAN)
        part = _spans(rows, own, n, 1) if n <= GRAM else _spans(rows, own, GRAM, n - GRAM + 1)
        spans = part if spans is None else spans.unionByName(part)
    out = rows.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if spans is None:
        return out.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    spans = checkpointed(spans)
    before = F.expr("coalesce(max(end) over (partition by doc_id, h order by start, end rows between unbounded preceding and 1 preceding), 0)")
    fresh = spans.select("doc_id", "h", "start", "end").distinct().withColumn("before", before)
    fresh = fresh.groupBy("doc_id", "h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    named = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select("doc_id", "h", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    fresh, named = fresh.toDF("id", "g", "n_hit"), named.toDF("id2", "g2", "n_items", "items_sha256")
    per = fresh.join(named, F.col("id").eqNullSafe(F.col("id2")) & (F.col("g") == F.col("g2")))
    out = out.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without contamination, columns as in docs. A null doc_id is judged by its
    text like any other row."""
    bad = contamination(docs.withColumn("__id", F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"))), items, "__id", text)
    bad = checkpointed(bad.filter("contaminated").select(F.col("doc_id.i").alias("__i"), F.col("doc_id.h").alias("__h")).distinct())
    return docs.join(hinted(bad, 24), F.col(doc_id).eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__h")), "left_anti")


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
il as (select item_id, w, least(len(w), 10) as n from iw where len(w) > 0),
ip as (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as p from il),
ig as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as g from ip),
sizes as (select distinct n from ig),
dp as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from w, sizes where len(w) >= n),
dg as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g from dp),
hits as (select doc_id, item_id, p, dg.n as n from dg join ig on dg.g = ig.g and dg.n = ig.n),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(p, p + n)) as pos from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select w.doc_id as doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered on w.doc_id = covered.doc_id left join named on w.doc_id = named.doc_id
"""
