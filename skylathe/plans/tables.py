"""Queries over photometry, image stamps, catalogues, schedules and manifests."""

from __future__ import annotations


from pyspark.sql import functions as F

from skylathe.functions import expr as X
from skylathe.operators import match, photometry, pixels, quality, selection, stats, windows

from .driver_tables import PHOTOMETRY, table
from .driver_tables import photometry as phot
from .registered import register

QUERIES, ORACLES, query = register()


r = lambda c, n=6: F.round(F.col(c), n).alias(c)


@query(f"with {PHOTOMETRY} select star, count(*) as n, round(stddev_pop(counts), 4) as std_pop, round(stddev_samp(counts), 4) as std_samp from phot group by star")
def std_pop_samp(spark, d):
    out = phot(spark, d).groupBy("star").agg(F.count("*").alias("n"), F.stddev_pop("counts").alias("std_pop"), F.stddev_samp("counts").alias("std_samp"))
    return out.select("star", "n", r("std_pop", 4), r("std_samp", 4))


@query(f"with {PHOTOMETRY} select star, case when count(*) >= 3 then round(corr(counts, airmass), 6) end as by_airmass, case when count(*) >= 3 then round(corr(counts, fwhm), 6) end as by_fwhm from phot group by star")
def corr_guarded(spark, d):
    c = lambda x: F.round(stats.correlation(F.col("counts"), F.col(x)), 6)
    return phot(spark, d).groupBy("star").agg(c("airmass").alias("by_airmass"), c("fwhm").alias("by_fwhm"))


@query("""with s as (select l_suppkey, l_extendedprice as x from lineitem where l_orderkey % 8 = 0), m as (select *, median(x) over (partition by l_suppkey) as m from s)
select l_suppkey, round(avg(x), 4) as mean, round(any_value(m), 4) as median, round(1.4826::double * median(abs(x - m)), 6) as mad, round(quantile_cont(x, 0.01), 6) as p01, round(quantile_cont(x, 0.99), 6) as p99, min(x) as low, max(x) as high, count(*) as n from m group by l_suppkey""")
def sampled_stats(spark, d):
    rows = table(spark, d, "lineitem").filter("l_orderkey % 8 = 0").select("l_suppkey", F.col("l_extendedprice").alias("x"))
    rest = rows.groupBy("l_suppkey").agg(F.avg("x").alias("mean"), F.percentile("x", 0.01).alias("p01"), F.percentile("x", 0.99).alias("p99"), F.min("x").alias("low"), F.max("x").alias("high"))
    out = stats.mad_raw(rows, ["l_suppkey"], F.col("x")).join(rest, "l_suppkey")
    return out.select("l_suppkey", r("mean", 4), r("median", 4), r("mad"), r("p01"), r("p99"), "low", "high", "n")


@query(f"with {PHOTOMETRY} select star, round(sum(counts / (error * error)) / sum(1 / (error * error)), 4) as mean, round(sqrt(sum(error * error)), 6) as error from phot where error > 0 group by star")
def inverse_variance_mean(spark, d):
    return phot(spark, d).groupBy("star").agg(F.round(stats.weighted_mean(F.col("counts"), F.col("error")), 4).alias("mean"), F.round(stats.quadrature(F.col("error")), 6).alias("error"))


_T = f"""{PHOTOMETRY}, s as (select frame, sum(case when star = 1 then counts end) as t, sum(case when star = 1 then error end) as et, sum(case when star <> 1 then counts end) as c, sqrt(sum(case when star <> 1 then error * error end)) as ec from phot group by frame),
q as (select *, case when c > 0 then t / c end as q from s)"""


@query(f"with {_T} select frame, round(q / (select median(q) from q), 6) as relative, round(abs(q) * sqrt(pow(et / t, 2) + pow(ec / c, 2)) / (select median(q) from q), 6) as error from q")
def target_curve(spark, d):
    return photometry.target_curve(phot(spark, d), 1).select("frame", r("relative"), r("error"))


_E = f"""{PHOTOMETRY}, l as (select *, counts / median(counts) over (partition by star) as q, pow(median(counts) over (partition by star) / error, 2) as w from phot),
s as (select frame, sum(case when star = 1 then counts end) as t, sum(case when star <> 1 then counts end) as a, avg(case when star <> 1 then q end) as b, sum(case when star <> 1 then w * q end) / sum(case when star <> 1 then w end) as c from l group by frame),
k as (select frame, 'flux_sum' as kind, t / a as q from s union all select frame, 'equal_star', t / b from s union all select frame, 'inverse_error', t / c from s),
e as (select frame, kind, q / median(q) over (partition by kind) as relative from k)"""


@query(f"with {_E} select frame, kind, round(relative, 6) as relative from e")
def ensemble_curves(spark, d):
    return photometry.ensembles(phot(spark, d), 1).select("frame", "kind", r("relative"))


@query(f"with {_E}, m as (select *, median(relative) over (partition by kind) as m from e) select kind, count(relative) as n, round(1.4826::double * median(abs(relative - m)), 6) as robust, round(stddev_samp(relative), 6) as sample from m group by kind")
def ensemble_scatter(spark, d):
    return photometry.scatter_by_kind(photometry.ensembles(phot(spark, d), 1)).select("kind", "n", r("robust"), r("sample"))


_L = f"""{PHOTOMETRY}, o as (select *, counts / nullif(sum(counts) over (partition by frame) - counts, 0) as o from phot), q as (select *, o / median(o) over (partition by star) as q from o),
v as (select *, median(q) over (partition by star) as m from q), rev as (select star, count(q) as n, 1.4826::double * median(abs(q - m)) as scatter, corr(q, airmass) as corr_airmass, corr(q, fwhm) as corr_fwhm from v group by star)"""


@query(f"with {_L} select star, n, round(scatter, 6) as scatter, round(corr_airmass, 6) as corr_airmass, round(corr_fwhm, 6) as corr_fwhm, round(greatest(abs(corr_airmass), abs(corr_fwhm)), 6) as largest from rev")
def leave_one_out(spark, d):
    return photometry.comparison_review(phot(spark, d), ["airmass", "fwhm"]).select("star", "n", r("scatter"), r("corr_airmass"), r("corr_fwhm"), r("largest"))


@query(f"with {PHOTOMETRY}, q as (select frame, counts / median(counts) over (partition by star) as q from phot) select frame, round(median(q), 6) as transparency from q group by frame")
def frame_transparency(spark, d):
    return photometry.frame_transparency(phot(spark, d)).select("frame", r("transparency"))


@query("""with p as (select p_partkey, p_size, p_retailprice, (p_partkey * 37 % 4096)::double as x, (p_partkey * 91 % 4096)::double as y from part),
q as (select *, sqrt((x - 2000) * (x - 2000) + (y - 2100) * (y - 2100)) as distance, least(x, y, 4096 - x, 4096 - y) as edge, p_retailprice / 1000::double as ratio from p)
select p_partkey, round(distance, 6) as distance, edge, round(ratio, 6) as ratio from q where distance >= 300 and edge >= 500 and ratio between 0.5 and 1.5 and abs(p_size - 25) <= 1 order by abs(ln(ratio)), abs(p_size - 25), distance desc, p_partkey limit 10""")
def comparison_star_choice(spark, d):
    p = table(spark, d, "part").withColumn("x", (F.col("p_partkey") * 37 % 4096).cast("double")).withColumn("y", (F.col("p_partkey") * 91 % 4096).cast("double"))
    out = photometry.comparison_stars(p, F.col("x"), F.col("y"), F.col("p_retailprice"), F.col("p_size"), (4096.0, 4096.0), (2000.0, 2100.0, 1000.0, 25.0), tie=F.col("p_partkey"))
    return out.select("p_partkey", r("distance"), "edge", r("ratio"))


@query("""with p as (select p_partkey, p_retailprice as a, p_size::double + 10 as b from part), m as (select min(a) as ma, min(b) as mb from p) select p_partkey, a <= 1.1 * ma and b <= 1.1 * mb as passes from p, m""")
def plateau_rule(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size").cast("double") + 10).alias("b"))
    return stats.plateau(p, "a", "b").select("p_partkey", "passes")


@query("select n_nationkey, count(c_custkey) as n from nation left join (select * from customer where c_acctbal > 9000) c on c_nationkey = n_nationkey group by n_nationkey")
def zero_filled_counts(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return stats.zero_filled(rich, table(spark, d, "nation"), "n_nationkey")


_SUP = "select s_suppkey, (s_suppkey * 53 % 997)::double as x, (s_suppkey * 71 % 991)::double as y, s_acctbal from supplier"


@query(f"select s_suppkey, round(sqrt((x - 500) * (x - 500) + (y - 480) * (y - 480)), 6) as distance from ({_SUP}) s where sqrt((x - 500) * (x - 500) + (y - 480) * (y - 480)) > 5 order by s_acctbal desc, s_suppkey limit 20")
def brightest_sources(spark, d):
    s = table(spark, d, "supplier").withColumn("distance", F.hypot((F.col("s_suppkey") * 53 % 997).cast("double") - 500.0, (F.col("s_suppkey") * 71 % 991).cast("double") - 480.0))
    best = s.filter("distance > 5").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    return quality.at_least(best, 1, "sources").select("s_suppkey", r("distance"))


@query(f"with s as ({_SUP}) select a.s_suppkey as s_suppkey, b.s_suppkey as other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as distance from s a join s b on a.s_suppkey < b.s_suppkey and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60")
def near_pairs(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 53 % 997).cast("double").alias("x"), (F.col("s_suppkey") * 71 % 991).cast("double").alias("y"))
    o = s.select(F.col("s_suppkey").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return match.within(s, o, ("x", "y"), ("ox", "oy"), 60.0).filter("s_suppkey < other").select("s_suppkey", "other", r("distance"))


_SEP = "degrees(asin(sqrt(greatest(0, least(1, pow(sin(radians(s.dec - c.dec) / 2), 2) + cos(radians(c.dec)) * cos(radians(s.dec)) * pow(sin(radians(s.ra - c.ra) / 2), 2)))))) * 2 * 3600"


@query(f"""with c as (select c_custkey, 150 + (c_custkey * 37 % 1009)::double / 500 as ra, 10 + (c_custkey * 91 % 1013)::double / 500 as dec from customer),
s as (select s_suppkey, 150 + (s_suppkey * 53 % 1009)::double / 500 as ra, 10 + (s_suppkey * 71 % 1013)::double / 500 as dec from supplier),
p as (select c_custkey, s_suppkey, {_SEP} as sep from c, s), n as (select c_custkey, count(*) as matches, min(sep) as sep, min_by(s_suppkey, sep) as nearest from p where sep <= 200 group by c_custkey)
select c.c_custkey as c_custkey, coalesce(matches, 0) as matches, coalesce(nearest, -1) as nearest, round(sep, 5) as separation, case when sep is null then 'none' when sep > 100 then 'distant' else 'matched' end as status from c left join n on c.c_custkey = n.c_custkey""")
def sky_match(spark, d):
    at = lambda df, k, a, b: df.select(k, (F.lit(150) + (F.col(k) * a % 1009).cast("double") / 500).alias("ra"), (F.lit(10) + (F.col(k) * b % 1013).cast("double") / 500).alias("dec"))
    out = match.sky_matches(at(table(spark, d, "customer"), "c_custkey", 37, 91), at(table(spark, d, "supplier"), "s_suppkey", 53, 71), "c_custkey", ("ra", "dec"), ("ra", "dec"), "s_suppkey", 200.0, close=100.0)
    return out.select("c_custkey", "matches", F.coalesce("nearest", F.lit(-1)).alias("nearest"), r("separation", 5), "status")


@query("""select c_custkey, c_nationkey, c_acctbal from (select *, row_number() over (partition by case when c_mktsegment = 'MACHINERY' then 'n' || c_nationkey else c_mktsegment end order by c_acctbal desc, c_custkey) as k from customer) q where k = 1""")
def dedup_keep_best(spark, d):
    key = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("n"), "c_nationkey")).otherwise(F.col("c_mktsegment"))
    return selection.best_of_key(table(spark, d, "customer"), key, F.desc("c_acctbal"), F.col("c_custkey")).select("c_custkey", "c_nationkey", "c_acctbal")


@query("""select sha256(text) as digest, count(*) as copies, min(doc_id) as chosen, count(distinct lang || '/' || source) > 1 as conflict from documents group by sha256(text)""")
def duplicate_resolution(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "lang", "source")
    return selection.resolved_duplicates(docs, ["digest"], [F.col("doc_id")], ["lang", "source"]).select("digest", "copies", F.col("chosen.doc_id").alias("chosen"), "conflict")


@query("""with m as (select p_brand, p_type, avg(p_retailprice) as score, count(*) as parameters from part group by p_brand, p_type), b as (select *, min(case when parameters >= 2 then score end) over (partition by p_brand) as b from m),
o as (select *, row_number() over (partition by p_brand order by parameters, score, p_type) as k from b where parameters >= 2 and score <= b * 1.01)
select p_brand, coalesce(max(case when k = 1 then p_type end), 'none') as chosen from (select distinct p_brand from m) a left join o using (p_brand) group by p_brand""")
def parsimony_select(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("score"), F.count("*").alias("parameters")).withColumn("ok", F.col("parameters") >= 2)
    return selection.parsimonious(rows, ["p_brand"], "score", "parameters", "p_type", "ok")


@query("select d.doc_id as doc_id, lang, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def one_to_one_join(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    broken = match.one_to_one(docs, labels, "doc_id").agg(F.count("*").alias("broken"))
    # the check rides along as a one-row table: a broken key makes every row fail
    checked = docs.join(labels, "doc_id", "left").join(F.broadcast(broken), F.lit(True))
    ok = F.when(F.col("broken") > 0, F.raise_error(F.lit("doc_id is not one to one"))).otherwise(F.col("doc_id"))
    return checked.select(ok.cast("long").alias("doc_id"), "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""with o as (select distinct o_orderkey as k from orders where o_orderstatus <> 'P'), l as (select distinct l_orderkey as k from lineitem where l_quantity > 10)
select k, 'missing' as problem from o where k not in (select k from l) union all select k, 'unexpected' from l where k not in (select k from o)""")
def missing_unexpected(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return match.missing_and_unexpected(o, table(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("k")), "k")


@query("""with c as (select c_nationkey as k, count(*) as customers, avg(c_acctbal) as c from customer group by 1), s as (select s_nationkey as k, count(*) as suppliers, avg(s_acctbal) as s from supplier group by 1)
select n_name, r_name, customers, suppliers, round(c - s, 4) as difference, abs(c - s) <= 500 as agrees, concat_ws('; ', case when c is null then 'no customers' end, case when s is null then 'no suppliers' end) as failures
from nation join region on n_regionkey = r_regionkey left join c on c.k = n_nationkey left join s on s.k = n_nationkey""")
def multiway_compare(spark, d):
    side = lambda t, p, n: table(spark, d, t).groupBy(F.col(f"{p}_nationkey").alias("n_nationkey")).agg(F.count("*").alias(n), F.avg(f"{p}_acctbal").alias(p))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(side("customer", "c", "customers"), "n_nationkey", "left").join(side("supplier", "s", "suppliers"), "n_nationkey", "left")
    gap = F.col("c") - F.col("s")
    why = F.concat_ws("; ", F.when(F.col("c").isNull(), "no customers"), F.when(F.col("s").isNull(), "no suppliers"))
    return rows.select("n_name", "r_name", "customers", "suppliers", F.round(gap, 4).alias("difference"), (F.abs(gap) <= 500).alias("agrees"), why.alias("failures"))


@query("""with q as (select p_partkey, pow(10, (p_size - 20) * 0.1 * -0.4::double) as ratio from part) select p_partkey, round(ratio, 8) as ratio, round(0.003::double / ratio, 8) as needed, 0.003::double / ratio <= 1 as possible, round(1 / (1 + ratio), 8) as dilution, round(sqrt(1 + ratio), 8) as radius_factor from q""")
def mag_flux_screen(spark, d):
    q = table(spark, d, "part").withColumn("ratio", X.flux_ratio((F.col("p_size") - 20) * F.lit(0.1)))
    need = F.lit(0.003) / F.col("ratio")
    return q.select("p_partkey", r("ratio", 8), F.round(need, 8).alias("needed"), (need <= 1).alias("possible"), F.round(1 / (1 + F.col("ratio")), 8).alias("dilution"), F.round(F.sqrt(1 + F.col("ratio")), 8).alias("radius_factor"))


@query("""with v as (select p_partkey, lpad(to_binary(p_size), 8, '0') as v from part), b as (select p_partkey, v, unnest(range(1, 9)) as i from v) select p_partkey, v as vector, coalesce(string_agg(case when v[i] = '1' then cast(i - 1 + 14 as varchar) end, ';' order by i), '') as sectors from b group by p_partkey, v""")
def bitvector_decode(spark, d):
    v = F.lpad(F.bin("p_size"), 8, "0")
    return table(spark, d, "part").select("p_partkey", v.alias("vector"), X.set_bits(v, 14).alias("sectors"))


@query("""with c as (select o_orderkey, cast(o_orderdate as date) as day, cast(o_orderkey % 24 as varchar) || ':' || lpad(cast(o_orderkey * 7 % 60 as varchar), 2, '0') as clock, cast(o_orderkey % 24 as int) as h, cast(o_orderkey * 7 % 60 as int) as m from orders),
l as (select *, day + case when h * 60 + m < 20 * 60 then 1 else 0 end as night from c)
select o_orderkey, clock, strftime(day, '%A') as weekday, epoch_us(cast(night as timestamp))::bigint // 1000000 + h * 3600 + m * 60 + 14400 as edt_epoch, epoch_us(cast(night as timestamp))::bigint // 1000000 + h * 3600 + m * 60 as utc_epoch from l""")
def clock_rollover_tz(spark, d):
    h, m = F.regexp_extract("clock", r"^(\d{1,2}):(\d{2})$", 1).cast("int"), F.regexp_extract("clock", r"^(\d{1,2}):(\d{2})$", 2).cast("int")
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") * 7 % 60).cast("string"), 2, "0")).alias("clock"))
    night = F.date_add("day", F.when(h * 60 + m < 20 * 60, 1).otherwise(0))  # a clock before the start of the night belongs to the next day
    local = F.unix_date(night).cast("long") * 86400 + h * 3600 + m * 60
    return rows.select("o_orderkey", "clock", F.date_format("day", "EEEE").alias("weekday"), (local + 4 * 3600).alias("edt_epoch"), local.alias("utc_epoch"))


@query("""select source, count(*) as files, sum(octet_length(encode(text)))::bigint as bytes, min(sha256(text)) as first_digest from documents group by source""")
def manifest_hash(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.min(F.sha2("text", 256)).alias("first_digest"))


@query("""select 'customer' as kind, c_custkey as id, c_acctbal as balance, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, s_acctbal, null from supplier""")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""select conv_id, count(*) as turns, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as whole, sum(length(text))::bigint as chars from conversations group by conv_id""")
def sequence_check(spark, d):
    t = F.col("turn")
    whole = (F.min(t) == 0) & (F.max(t) == F.count("*") - 1) & (F.count_distinct(t) == F.count("*"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), whole.alias("whole"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(r"""select page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<a\s')) as links from pages""")
def markup_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("links"))


PX = "px as (select vec_id, label, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, embedding[i]::double + 1 as value from (select vec_id, label, embedding, unnest(range(1, 65)) as i from embeddings) q)"


def _px(spark, d):
    return pixels.pixels(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding", 8).withColumn("value", F.col("value") + 1)


_D = "sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))"


@query(f"""with {PX}, sky as (select vec_id, median(value) as background, 1.253::double * sqrt(sum(error * error)) / count(*) as e from (select *, 0.01::double + 0.002::double * ((x + y) % 5) as error from px) q where {_D} > 3 and {_D} <= 4.5 group by vec_id), dsc as (select vec_id, radius, sum(value) as s, count(*) as n from px, (select unnest([1.5::double, 2.5]) as radius) where {_D} <= radius group by vec_id, radius)
select dsc.vec_id as vec_id, radius, round(s - n * background, 6) as flux, round(background, 6) as background, round(e, 6) as background_error, n, 0 as quality from dsc join sky on dsc.vec_id = sky.vec_id""")
def aperture_extract(spark, d):
    px = _px(spark, d).withColumn("error", 0.01 + 0.002 * ((F.col("x") + F.col("y")) % 5))
    out = pixels.apertures(px, ["vec_id"], 3.5, 3.5, [1.5, 2.5], 3.0, 4.5)
    return out.select("vec_id", "radius", r("flux"), r("background"), r("background_error"), "n", "quality")


_DIFF = f"""sky as (select vec_id, median(value) as sky from px where {_D} > 3 and {_D} <= 4.5 group by vec_id),
fx as (select label, px.vec_id % 7 as event, px.vec_id % 3 = 0 as inside, y, x, value - sky as v from px join sky on px.vec_id = sky.vec_id),
ev as (select label, event, y, x, count(case when inside then 1 end) as i, count(case when not inside then 1 end) as o, median(case when inside then v end) as inn, median(case when not inside then v end) as outside from fx group by label, event, y, x),
ok as (select * from ev where i >= 2 and o >= 4), sc as (select label, event, sum(outside) as flux from ok where {_D} <= 2 group by label, event having sum(outside) > 0),
df as (select ok.label as label, ok.event as event, y, x, (outside - inn) / flux as value from ok join sc on ok.label = sc.label and ok.event = sc.event)"""


def _differences(spark, d):
    inside = F.col("vec_id") % 3 == 0
    px = _px(spark, d).withColumn("event", F.col("vec_id") % 7)
    return pixels.event_differences(px, ["label"], "event", "vec_id", inside, ~inside, 3.5, 3.5, 2.0, (3.0, 4.5))


@query(f"with {PX}, {_DIFF} select label, y, x, round(median(value), 6) as value, count(*) as events from df group by label, y, x having count(*) >= 3")
def difference_image(spark, d):
    return pixels.difference_image(_differences(spark, d), ["label"]).select("label", "y", "x", r("value"), "events")


def _moments(source: str, keys: str) -> str:
    w = f"case when {_D} <= 3 then greatest(value, 0) else 0 end"
    return f"select {keys}, sum({w} * x) / nullif(sum({w}), 0) as cx, sum({w} * y) / nullif(sum({w}), 0) as cy from {source} group by {keys}"


_LCG = "(a * 1664525 + 1013904223) % 4294967296"


@query(f"""with {PX}, {_DIFF}, nb as (select label, event, row_number() over (partition by label order by event) - 1 as i from (select distinct label, event from df) q), nn as (select label, count(*) as n from nb group by label),
s0 as (select label, n, draw, unnest(range(0, n)) as slot from nn, (select unnest(range(1, 601)) as draw) q), s1 as (select label, n, draw, (draw * 1103515245 + slot * 12345 + 7919) % 4294967296 as a from s0),
s2 as (select label, n, draw, {_LCG} as a from s1), s3 as (select label, draw, ({_LCG}) // 65536 % n as i from s2),
sm as (select s3.label as label, draw, y, x, median(value) as value from s3 join nb on s3.label = nb.label and s3.i = nb.i join df on df.label = nb.label and df.event = nb.event group by s3.label, draw, y, x),
st as (select label, y, x, median(value) as value from df group by label, y, x), c as ({_moments("sm", "label, draw")}), w as ({_moments("st", "label")})
select c.label as label, round(any_value(w.cx), 6) as cx, round(any_value(w.cy), 6) as cy, round(quantile_cont(sqrt((c.cx - w.cx) * (c.cx - w.cx) + (c.cy - w.cy) * (c.cy - w.cy)), 0.6827), 6) as radius from c join w on c.label = w.label group by c.label""")
def bootstrap_positions(spark, d):
    out = pixels.bootstrap_centroids(_differences(spark, d), ["label"], "event", (3.5, 3.5, 3.0))
    return out.select("label", r("cx"), r("cy"), r("radius"))


@query(f"""with {PX}, s as (select vec_id, x, y, case when {_D} <= 3 then greatest(value - 1, 0) else 0 end as w from px), m as (select vec_id, sum(w) as t, sum(w * x) as sx, sum(w * y) as sy, sum(w * (x * x + y * y)) as rr from s group by vec_id)
select vec_id, round(t, 6) as total, round(sx / nullif(t, 0), 6) as cx, round(sy / nullif(t, 0), 6) as cy, round(2.355::double * sqrt(greatest(rr / nullif(t, 0) - (sx / nullif(t, 0)) * (sx / nullif(t, 0)) - (sy / nullif(t, 0)) * (sy / nullif(t, 0)), 0) / 2), 6) as fwhm from m""")
def centroid(spark, d):
    return pixels.centroid(_px(spark, d).withColumn("value", F.col("value") - 1), ["vec_id"], (3.5, 3.5, 3.0)).select("vec_id", r("total"), r("cx"), r("cy"), r("fwhm"))


@query(f"with {PX} select label, y, x, round(median(value), 6) as value from px group by label, y, x")
def median_stack(spark, d):
    return pixels.median_stack(_px(spark, d), ["label"]).select("label", "y", "x", r("value"))


@query(f"""with {PX}, g as (select distinct vec_id from px), e as (select vec_id, cast(p // 8 as int) as y, cast(p % 8 as int) as x from g, (select unnest(range(0, 64)) as p)) select e.vec_id as vec_id, e.y as y, e.x as x, round(coalesce(px.value, -1), 6) as value from e left join px on px.vec_id = e.vec_id and px.y - 1 = e.y and px.x + 2 = e.x""")
def whole_pixel_shift(spark, d):
    return pixels.shifted(_px(spark, d), ["vec_id"], -1, 2, 8, 8, -1.0).select("vec_id", "y", "x", r("value"))


@query(f"""with {PX} select label, cast(floor({_D} / 0.5) as bigint) as bin, round(median({_D}), 6) as radius, round(median(value), 6) as value from px group by label, bin""")
def radial_profile(spark, d):
    return pixels.radial_profile(_px(spark, d), ["label"], 3.5, 3.5).select("label", "bin", r("radius"), r("value"))


@query(f"""with {PX}, dark as (select y, x, median(value) as dark from px where label = 0 group by y, x), fl as (select y, x, median(value) as flat from px where label = 1 group by y, x)
select vec_id, px.y as y, px.x as x, round(cast(cast((value - dark) / nullif(flat, 0) as real) as double), 4) + 0.0 as value, flat < 0.5 or flat > 1.5 as doubtful from px join dark on px.y = dark.y and px.x = dark.x join fl on px.y = fl.y and px.x = fl.x where label > 1""")
def calibrate_stamps(spark, d):
    return _calibrated_stamps(spark, d, "label > 1")


def _calibrated_stamps(spark, d, raw):
    px = _px(spark, d)
    pick = lambda k: pixels.median_stack(px.filter(F.col("label") == k), []).select("y", "x", "value")
    out = pixels.calibrated(px.filter(raw), pick(0), pick(1), ["vec_id"])
    return out.select("vec_id", "y", "x", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"), "doubtful")


@query(f"""with {PX} select a.vec_id as vec_id, a.y as y, a.x as x, round(a.value, 6) as value from px a join px b on a.vec_id = b.vec_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 where a.value > 1.2 and a.value < 1.5
group by a.vec_id, a.y, a.x, a.value having not bool_or(b.value > a.value or (b.value = a.value and (b.y < a.y or (b.y = a.y and b.x < a.x))))""")
def local_maxima(spark, d):
    return pixels.local_maxima(_px(spark, d), ["vec_id"], 2, 1.2, 1.5).select("vec_id", "y", "x", r("value"))


def _plane_sql(rounds: int = 3) -> str:
    """CTEs of a plane fit in so many rounds: p0 has the pixels in use at first."""
    out = [
        "uv as (select label, 2.0::double * x / 7 - 1 as u, 2.0::double * y / 7 - 1 as v, value as z from px)",
        "en as (select label, quantile_cont(z, 0.002) as low, quantile_cont(z, 0.998) as high from uv group by label)",
        "p0 as (select uv.label as label, u, v, z, z between low and high as use from uv join en on uv.label = en.label)",
    ]
    for k in range(rounds):
        out += [
            f"c{k} as (select label, u, v, z, avg(u) over w as mu, avg(v) over w as mv, avg(z) over w as mz from p{k} where use window w as (partition by label))",
            f"""m{k} as (select label, any_value(mu) as mu, any_value(mv) as mv, any_value(mz) as mz, sum((u - mu) * (u - mu)) as uu, sum((v - mv) * (v - mv)) as vv, sum((u - mu) * (v - mv)) as uv, sum((u - mu) * (z - mz)) as uz, sum((v - mv) * (z - mz)) as vz from c{k} group by label)""",
            f"l{k} as (select label, mu, mv, mz, (vv * uz - uv * vz) / nullif(uu * vv - uv * uv, 0) as sx, (uu * vz - uv * uz) / nullif(uu * vv - uv * uv, 0) as sy from m{k})",
            f"e{k} as (select p.label as label, u, v, z, use, z - (mz - sx * mu - sy * mv) - sx * u - sy * v as e from p{k} p join l{k} l on p.label = l.label)",
            f"h{k} as (select label, median(e) as m from e{k} where use group by label)",
            f"d{k} as (select e.label as label, 1.4826::double * median(abs(e - m)) as mad from e{k} e join h{k} h on e.label = h.label where use group by e.label)",
            f"p{k + 1} as (select e.label as label, u, v, z, case when mad > 0 then abs(e) <= 4 * mad else use end as use from e{k} e join d{k} d on e.label = d.label)",
        ]
    return ",\n".join(out)


@query(f"""with {PX}, {_plane_sql()} select l.label as label, round(any_value(mz - sx * mu - sy * mv), 6) as level, round(any_value(sx), 6) as slope_x, round(any_value(sy), 6) as slope_y, count(case when use then 1 end) as n from l2 l join p3 p on l.label = p.label group by l.label""")
def plane_fit(spark, d):
    return pixels.plane(_px(spark, d), ["label"], 8, 8).select("label", r("level"), r("slope_x"), r("slope_y"), "n")


@query()
def fft_shift(spark, d):
    stamps = table(spark, d, "embeddings")
    reference = stamps.orderBy("vec_id").first()["embedding"]  # one stamp
    return pixels.fft_shifts(stamps, "vec_id", "embedding", reference, 8, 8)


@query()
def backward_elimination(spark, d):
    rows = phot(spark, d)
    target = rows.filter("star = 1").select("frame", F.col("counts").alias("t"))
    stars = rows.filter("star > 1").select("frame", F.concat(F.lit("C"), "star").alias("star"), "counts").join(target, "frame")
    names, scatter = selection.backward_elimination(stars, "frame", "star", "counts", "t", least=3)
    return spark.createDataFrame([(",".join(names), scatter)], "stars string, scatter double")


@query("""select o_orderkey, last_value(case when o_totalprice > 200000 then o_totalprice end ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as guess from orders""")
def previous_accepted(spark, d):
    return _previous_accepted(table(spark, d, "orders"))


def _previous_accepted(o):
    return windows.previous_accepted(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 200000, "o_totalprice").select("o_orderkey", F.col("guess_o_totalprice").alias("guess"))


_J2000 = "(epoch_us(o_orderdate) / 86400000000.0::double - 10957.5::double)"


@query(f"""with o as (select o_orderkey, {_J2000} as n from orders), g as (select *, radians(357.528::double + n * 0.9856003::double) as m, radians(23.439::double - n * 4e-7::double) as e from o),
l as (select *, radians(280.460::double + n * 0.9856474::double + sin(m) * 1.915::double + sin(m * 2) * 0.020::double) as l from g), s as (select *, degrees(atan2(cos(e) * sin(l), cos(l))) as ra, degrees(asin(sin(e) * sin(l))) as de from l)
select o_orderkey, round(ra, 5) as ra, round(de, 5) as dec, round(degrees(asin(greatest(-1, least(1, sin(radians(de)) * sin(radians(33.8::double)) + cos(radians(de)) * cos(radians(280.46061837::double + n * 360.98564736629::double - 84.5::double - ra)) * cos(radians(33.8::double)))))), 5) as altitude from s""")
def sun_altitude(spark, d):
    return _sun_altitude(table(spark, d, "orders"))


def _sun_altitude(o):
    o = o.select("o_orderkey", (X.days(F.col("o_orderdate")) - 10957.5).alias("n"))
    ra, dec = X.sun_altitude_terms(F.col("n"))
    o = o.withColumn("ra", ra).withColumn("dec", dec)
    return o.select("o_orderkey", r("ra", 5), r("dec", 5), F.round(X.altitude(F.col("ra"), F.col("dec"), F.col("n"), 33.8, -84.5), 5).alias("altitude"))


@query("""with p as (select p_partkey, (p_partkey * 37 % 4096)::double - 2048 as u, (p_partkey * 91 % 4096)::double - 2048 as v from part), q as (select p_partkey, radians(u * -0.0001::double + v * 0.00001::double) as xi, radians(u * 0.00001::double + v * 0.0001::double) as eta from p)
select p_partkey, round(((degrees(atan2(xi, cos(radians(35::double)) - eta * sin(radians(35::double)))) + 300) % 360 + 360) % 360, 8) as ra, round(degrees(atan2(sin(radians(35::double)) + eta * cos(radians(35::double)), sqrt(xi * xi + (cos(radians(35::double)) - eta * sin(radians(35::double))) * (cos(radians(35::double)) - eta * sin(radians(35::double)))))), 8) as dec from q""")
def pixel_positions(spark, d):
    ra, dec = X.position_tan((F.col("p_partkey") * 37 % 4096).cast("double"), (F.col("p_partkey") * 91 % 4096).cast("double"), (300.0, 35.0), (2048.0, 2048.0), (-0.0001, 0.00001, 0.00001, 0.0001))
    return table(spark, d, "part").select("p_partkey", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query(f"with {PHOTOMETRY}, m as (select star, counts, median(counts) over (partition by star) as m from phot) select star, round(any_value(m), 4) as centre, round(coalesce(nullif(1.4826::double * median(abs(counts - m)), 0), stddev_pop(counts)), 4) as noise from m group by star")
def centre_and_noise(spark, d):
    return stats.centre_and_noise(phot(spark, d), ["star"], "counts").select("star", r("centre", 4), r("noise", 4))


@query(f"""with {PHOTOMETRY}, fr as (select count(distinct frame) as k from phot), u as (select *, frame - avg(frame) over v as u from phot window v as (partition by star)), q as (select *, u * u as q from u),
o as (select *, q - avg(q) over v - u * (sum(q * u) over v / sum(q) over v) as o from q window v as (partition by star)),
b as (select star, counts / (avg(counts) over v + u * (sum(u * counts) over v / sum(u * u) over v) + o * (sum(o * counts) over v / sum(o * o) over v)) as flat from o window v as (partition by star)),
m as (select *, median(flat) over (partition by star) as m from b), e as (select star, count(flat) / any_value(k) as covered, 1.4826::double * median(abs(flat - m)) as scatter from m, fr group by star),
g as (select *, median(scatter) over () as ms from e where covered >= 0.9), l as (select greatest(any_value(ms) + 2.5 * 1.4826::double * median(abs(scatter - ms)), 0.006) as lim from g)
select star, round(covered, 6) as covered, round(scatter, 6) as scatter, coalesce(covered >= 0.9 and scatter <= lim, false) as chosen from e, l""")
def stable_stars(spark, d):
    rows = phot(spark, d)
    frames = rows.agg(F.count_distinct("frame")).first()[0]
    return photometry.stable_stars(rows, frames).select("star", r("covered"), r("scatter"), "chosen")


@query("""with recursive s as (select c_nationkey, (c_custkey * 53 % 997)::double as x, (c_custkey * 71 % 991)::double as y, c_acctbal as f from customer), b as (select *, row_number() over (partition by c_nationkey order by f desc, x, y) as k from s),
p as (select c_nationkey, k, x, y, f, [{'x': x, 'y': y}] as kept, true as taken from b where k = 1 union all
  select b.c_nationkey, b.k, b.x, b.y, b.f, case when ok then list_append(kept, {'x': b.x, 'y': b.y}) else kept end, ok
  from (select b.*, p.kept, len(p.kept) < 25 and len(list_filter(p.kept, lambda q: sqrt((q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y)) < 220)) = 0 as ok from p join b on b.c_nationkey = p.c_nationkey and b.k = p.k + 1) b)
select c_nationkey, cast(row_number() over (partition by c_nationkey order by k) as int) as rank, x, y, f as c_acctbal from p where taken""")
def spaced_stars(spark, d):
    s = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") * 53 % 997).cast("double").alias("x"), (F.col("c_custkey") * 71 % 991).cast("double").alias("y"), "c_acctbal")
    return selection.spaced_stars(s, ["c_nationkey"], "x", "y", "c_acctbal", 220.0, 25)


def _clipped_sql(rounds: int = 5) -> str:
    """CTEs of so many rounds of clipping about the median, from r0."""
    out = []
    for k in range(rounds):
        out += [
            f"m{k} as (select *, abs(value - median(value) over (partition by vec_id)) as d from r{k})",
            f"r{k + 1} as (select vec_id, value from (select *, 1.4826::double * median(d) over (partition by vec_id) as s from m{k}) q where d <= s * 3 or s = 0)",
        ]
    return ", ".join(out)


_WEIGHTS = ", ".join(f"({y}, {x}, {w!r}::double)" for y, x, w in pixels.overlap_weights(8, 8, 3.5, 3.5, 2.2))


@query(f"""with {PX}, w(y, x, weight) as (values {_WEIGHTS}), s as (select vec_id, sum(value * weight) as s, sum(weight) as area from px join w on px.y = w.y and px.x = w.x group by vec_id),
r0 as (select vec_id, value from px where {_D} > 3 and {_D} <= 4.5), {_clipped_sql()}, sky as (select vec_id, median(value) as background from r5 group by vec_id)
select s.vec_id as vec_id, round(s - area * background, 6) as flux, round(background, 6) as background from s join sky on s.vec_id = sky.vec_id""")
def exact_aperture(spark, d):
    return pixels.exact_aperture(_px(spark, d), ["vec_id"], 8, 8, 3.5, 3.5, 2.2, 3.0, 4.5).select("vec_id", r("flux"), r("background"))
