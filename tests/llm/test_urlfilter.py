import random

from skylathe.llm import urlfilter


def slow(urls, rules, listed):
    out = []
    for page, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
        best = max(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if fits(h, p)), default=None)
        on = any(fits(x.split("/")[0].lower(), x[x.index("/") :]) for x in listed)
        out.append((page, host, path, best and best[3], best[4] if best else "block" if on else "allow", on))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "xnet", "example.net", "EN.Example.net", "example.com", "org", "w.org", "bad.com", "x.bad.com", "", "a..net", "net."]
    ends = ["", "/", "/en/", "/en/x", "/en", "/de/1?x=/fr/", "/fr/#a", "?q=/en/", "#/en/", "/fr//en/", "/p/q", "/p/"]
    urls = [(i, rng.choice(["http://", "https://", "HTTP://", "", "x://y://"]) + rng.choice(hosts) + rng.choice(ends)) for i in range(600)]
    urls += [(1000, None), (1001, ""), (1002, "://"), (1003, "http://a.net/\n/en/?"), (None, "http://a.net/"), urls[0], (1004, "http://" + "a." * 300 + "net/" + "x/" * 3000)]
    rules = [*urlfilter.RULES, ("a.net", "/en", "allow"), ("bad.com", "", "allow")]
    listed = ["Bad.com/p/", "example.com/"]
    pages = spark.createDataFrame([(*u, "r") for u in urls], "page_id long, url string, rule string")
    r = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = urlfilter.verdicts(pages, r, spark.createDataFrame([(x,) for x in [*listed, listed[0]]], "url string"))
    assert sorted(map(tuple, got.collect()), key=str) == slow(urls, rules, listed)
    assert urlfilter.verdicts(pages.limit(0), r, spark.createDataFrame([], "url string")).count() == 0
    assert {x.verdict for x in urlfilter.verdicts(pages, r.limit(0), spark.createDataFrame([], "url string")).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    n = 4000
    entries = spark.range(n).select(F.concat(F.lit("h"), "id").alias("entry"))
    sieve = urlfilter.bloom(entries, n * urlfilter.BITS_AN_ENTRY // 256 + 1)
    probe = spark.range(4 * n).select("id", F.concat(F.lit("h"), "id").alias("entry")).withColumn("block", urlfilter._block("entry", n * 16 // 256 + 1)).join(sieve, "block")
    for j in range(4):
        probe = probe.filter(F.col(f"w{j}").bitwiseAND(urlfilter._bit("entry", j)) != 0)
    assert probe.filter(F.col("id") < n).count() == n
    assert probe.filter(F.col("id") >= n).count() < 0.05 * 3 * n


def test_a_long_list(spark):
    """A hundred thousand entries, few of which any URL fits: the filter rules out nearly all lookups."""
    rng = random.Random(4)
    listed = [f"site{i}.example.net/" if i % 2 else f"host{i}.example.org/p{i}/" for i in range(100_000)]
    urls = []
    for i in range(1500):
        k = rng.randrange(200_000)  # half of them beyond the list
        urls.append((i, f"https://www.site{k}.example.net/x?y" if k % 2 else f"http://host{k}.example.org/p{rng.choice([k, k + 1])}/q"))
    got = urlfilter.verdicts(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string"), spark.createDataFrame([(x,) for x in listed], "url string"))
    on, want = set(listed), {}
    for i, u in urls:
        h, _, p = u.split("://")[1].partition("/")
        parts = h.split(".")
        want[i] = any(".".join(parts[j:]) + q in on for j in range(len(parts)) for q in ("/", "/" + p.split("/")[0] + "/"))
    assert {r.page_id: r.listed for r in got.collect()} == want and 300 < sum(want.values()) < 1200
