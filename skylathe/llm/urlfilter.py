"""URL filters: a blocked Bloom filter ahead of an exact hash join.

Rules and listed canonical URLs are entries `host + path`. An entry fits its host and all
subdomains, for paths that start with its path, so a URL is looked up under each suffix of its host
and each prefix of its path that is as long as some entry's path. The lookups probe a Bloom filter
of blocks of four 64-bit words, one bit a word; what passes is joined exactly with the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, hinted

#: Bits of filter for each entry.
BITS_AN_ENTRY = 16
_WORDS = 4

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Canonical URLs that op6 lists for blocking where no rule decides.
LISTED = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: str, word: int) -> Column:
    """The entry's bit in one word of its block."""
    return F.expr(f"shiftleft(1L, cast((xxhash64({key}, 'bits') >> {6 * word}) & 63 as int))")


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3: the filter of the column entry."""
    words = [F.bit_or(_bit("entry", j)).alias(f"w{j}") for j in range(_WORDS)]
    return entries.groupBy(_block("entry", blocks).alias("block")).agg(*words)


def verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, listed.

    rules has host, path and verdict; listed has url, canonical (host and path). The longest rule
    that fits decides (of equally long ones that with the longer host, then a block); without one, a
    URL that a listed entry fits is blocked, and any other allowed. listed tells whether one fits.
    A null url or one without :// has an empty host and path, which only rules with both empty fit.
    Repeated rows give repeated equal rows, other columns aren't read, and an empty table gives an
    empty result. Rules with nulls fit nothing.
    """
    named = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict", F.lit(True).alias("is_rule"))
    split = [F.regexp_extract("url", r"(?s)^([^/]*)(.*)$", n) for n in (1, 2)]
    named = named.unionByName(listed.select(ascii_lower(split[0]).alias("host"), split[1].alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
    entries = checkpointed(named.dropna().distinct().withColumn("entry", F.concat("host", "path")))
    count, lengths = entries.agg(F.count("*"), F.sort_array(F.collect_set(F.length("path")))).first()  # no more lengths than a URL has
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    blocks = max(1, count * BITS_AN_ENTRY // (64 * _WORDS) + 1)
    keys = rows.select("host", "path", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', i - 1 - size(split(host, '[.]'))))")).alias("suffix"))
    keys = keys.select("host", "path", "suffix", F.explode(F.array(*map(F.lit, lengths or [0]))).alias("n")).filter("n <= length(path)")
    keys = keys.withColumn("entry", F.expr("concat(suffix, substring(path, 1, n))"))
    sieve = hinted(bloom(entries, blocks), 64)
    passed = F.lit(True)
    for j in range(_WORDS):
        passed = passed & (F.col(f"w{j}").bitwiseAND(_bit("entry", j)) != 0)
    keys = keys.withColumn("block", _block("entry", blocks)).join(sieve, "block").filter(passed).select("host", "path", "entry", "suffix")
    exact = hinted(entries.select("entry", F.col("host").alias("suffix"), "verdict", "is_rule"), 200)
    hits = keys.join(exact, ["entry", "suffix"])
    rank = F.when(F.col("is_rule"), F.struct(F.length("entry").alias("n"), F.length("suffix").alias("m"), (F.col("verdict") == "block").alias("b"), F.col("entry").alias("rule"), F.col("verdict").alias("verdict")))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"), F.max(~F.col("is_rule")).alias("listed"))
    listed_too = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(listed_too, "block").otherwise("allow"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), listed_too.alias("listed"))


_LIST = ", ".join(f"('{x.split('/', 1)[0]}', '/{x.split('/', 1)[1]}')" for x in LISTED)
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
r(h, q, v) as (values {_RULES}),
l(h, q) as (values {_LIST}),
u as (select distinct host, path from p),
best as (select host, path, max_by(h || q, length(h || q)) as rule, max_by(v, length(h || q)) as v
  from u, r where (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by host, path),
named as (select distinct host, path from u, l where (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
select page_id, p.host as host, p.path as path, rule,
  coalesce(v, case when named.host is not null then 'block' else 'allow' end) as verdict, named.host is not null as listed
from p left join best on p.host = best.host and p.path = best.path left join named on p.host = named.host and p.path = named.path
"""
