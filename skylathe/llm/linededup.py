"""Line dedup as an exact set-similarity join.

A line's tokens are its distinct shingles of five words; a line of one to four words has one token, all
its words. Tokens are ordered by rarity: a shingle is as rare as its first word, whose occurrences are
counted over the whole corpus (in 8,192 hashed buckets), and rarer ones come first. Tokens that turn
out to stand in many prefixes nevertheless, as those of a passage that many lines hold, go behind all
others by their own count. Any order keeps the join exact; rarity keeps it small. Lines of one token set form a class. Two classes with a Jaccard similarity of at least 0.8 share a token among the first
n - ceil(0.8 n) + 1 of each, so only classes that share such a token are compared, under the length and
the positional filter and a bitmap filter: every token flips one bit of its class's bitmap, so bitmaps
that differ in more bits than similar sets have tokens apart rule a pair out. So do, for sets too large
for their bitmaps, the first tokens of both as far as both are known. What is left is verified on the words of the lines. Every line that matches an earlier one goes.

All steps are DataFrame functions. Copies of a line are one class throughout, so a line that a third
of the corpus repeats is joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpointed, counted, hinted, in_sieve, sieve, written

SHINGLE, SIMILARITY = 5, 0.8
#: Buckets of words whose occurrences are counted: 2 to this.
_BUCKET_BITS = 13
#: Tokens in more prefixes than COMMON are moved behind all others, the COMMONEST of them at most.
COMMON, COMMONEST = 256, 1 << 14
#: Pairs of sets of more tokens are held to their first tokens: behind bitmaps of one long, and of eight.
_LINE_SET, _LONG_SET = 100, 1000
#: Words of the sieve of shared tokens: 2 to this, 4 MB.
_TOKEN_SIEVE = 19
#: A token is one long: its rank above, its hash in the low bits.
_HASH_BITS = 63 - _BUCKET_BITS


def _spaced(text: Column) -> Column:
    """text with ASCII white space other than line ends as spaces."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, line_no, line of docs (doc_id, h, text), words parted by spaces."""
    rows = docs.select("doc_id", "h", F.coalesce(_spaced(F.col("text")), F.lit("")).alias("text"))
    return rows.select("doc_id", "h", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))


def _of_word(word: Column) -> Column:
    return word.bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))


def rarity(docs: DataFrame) -> Column:
    """A constant array with the rank of each bucket of words by its count in the texts, rarest first,
    shifted to a token's upper bits; its size is fixed, whatever the corpus. Words count in lower case, as tokens have them."""
    seen = docs.select(F.explode_outer(F.split(F.replace(F.lower(_spaced(F.col("text"))), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = seen.groupBy(_of_word(F.xxhash64("w")).alias("b")).agg(F.count("w").alias("n"))
    of = {r.b: r.n for r in counts.collect()}  # 8,192 rows at most
    ranks = {b: i for i, b in enumerate(sorted(range(1 << _BUCKET_BITS), key=lambda b: (of.get(b, 0), b)))}
    return F.split(F.lit(",".join(str(ranks[b] << _HASH_BITS) for b in range(1 << _BUCKET_BITS))), ",").cast("array<bigint>")


def _word_hashes(line: str) -> Column:
    return F.array_remove(F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _joined(a: Column, b: Column, by: int) -> Column:
    """Hashes of the elements of a with those of b that stand by places behind; none behind the end, which adds nothing."""
    return F.zip_with(a, F.slice(b, F.lit(by + 1), F.size(b)), lambda x, y: F.coalesce(F.xxhash64(x, y), F.lit(0)))


def _shingle_hashes(words: Column, twos: Column) -> Column:
    """Hashes of the shingles, from those of words and of words with the next."""
    return F.slice(_joined(_joined(twos, twos, 2), words, SHINGLE - 1), F.lit(1), _many(words))


def _tokens(lines: DataFrame, ranks: Column) -> DataFrame:
    """lines with __t in place of line: the distinct tokens in order of rarity; none of a blank line."""
    rows = lines.withColumn("__w", _word_hashes("line")).drop("line").withColumn("__2", _joined(F.col("__w"), F.col("__w"), 1))
    words, hashes = F.col("__w"), _shingle_hashes(F.col("__w"), F.col("__2"))

    def token(word: Column, h: Column) -> Column:  # never null, as arrays without nulls are sorted faster
        return F.coalesce(F.get(ranks, _of_word(word).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS)), F.lit(0))

    first = F.slice(words, F.lit(1), _many(words))
    return rows.withColumn("__t", F.sort_array(F.array_distinct(F.zip_with(first, hashes, token)))).drop("__w", "__2")


def _bitmap(longs: int) -> Column:
    """An array of longs in which each token of __t flips one bit."""
    flip = lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))
    own = lambda j: F.filter("__t", lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(longs - 1)) == j) if longs > 1 else F.col("__t")
    return F.array(*[F.aggregate(own(j), F.lit(0).cast("long"), flip) for j in range(longs)])


#: Tokens of a set of n of which similar sets share one: all but ceil(0.8 n), and one.
_PREFIX = "cast(n - ((4 * n + 4) div 5) + 1 as int)"


def _first(tokens: str) -> Column:
    """The tokens of the prefix and half as many more, to stand in for common ones."""
    return F.expr(f"slice({tokens}, 1, (size({tokens}) - ((4 * size({tokens}) + 4) div 5) + 1) * 3 div 2 + 1)")


def _bits_apart(a: str, b: str) -> Column:
    """How many bits differ; at most as many as tokens do."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _first_apart(a: str, b: str) -> Column:
    """How many tokens sets have apart, of those up to where the first tokens of both reach."""
    reach = F.least(F.element_at(a, -1), F.element_at(b, -1))
    within = lambda f: F.size(F.filter(f, lambda t: t <= reach))
    return within(a) + within(b) - 2 * F.size(F.array_intersect(a, b))


class _Join:
    """The similarity join over docs (doc_id, h, text), up to the index of tokens that classes share.

    rows: the lines that have tokens (doc_id, h, line_no, k, n, bits, first_tokens); classes: k, first,
    lines, n, bits; index: t, k, n, i, first, bits for the prefix tokens t that more than one class
    has. longs: size of the bitmaps, a power of 2; one long serves sets of up to about 140 tokens, eight
    of up to 1000. Pairs of sets of more than held tokens are held to their first tokens, too.
    """

    def __init__(self, docs: DataFrame, longs: int = 1, held: int = _LINE_SET):
        self.docs, self.ranks, self.held = docs, rarity(docs), held
        rows = _tokens(_lines(docs), self.ranks)
        rows = rows.select("doc_id", "h", "line_no", F.xxhash64("__t").alias("k"), F.size("__t").alias("n"), _bitmap(longs).alias("bits"), _first("__t").alias("first_tokens"))
        self.rows = rows = written(rows, "lines").filter("n > 0")  # a filter ahead of it would compute the tokens twice over
        first = F.min(F.struct("doc_id", "h", "line_no")).alias("first")
        self.classes = written(rows.groupBy("k").agg(first, F.count("*").alias("lines"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")
        prefix = F.slice("first_tokens", F.lit(1), F.expr(_PREFIX))
        tokens = rows.select("k", F.explode_outer(prefix).alias("t"))
        shared = written(tokens.groupBy("t").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("lines")).filter("a < b").select("t", "lines"), "shared")
        common = [r.t for r in shared.filter(F.col("lines") > COMMON).orderBy(F.desc("lines"), "t").limit(COMMONEST).collect()]
        placed, fresh = self._reordered(common)
        known = shared.select("t").unionByName(fresh)
        index = placed.filter(in_sieve(sieve(known, "t", _TOKEN_SIEVE), F.col("t"), _TOKEN_SIEVE)).groupBy("t", "k").agg(F.max("n").alias("n"), F.max("i").alias("i"))
        index = written(index, "tokens")  # tokens of one class alone that the sieve let through go with the next join
        shared = index.groupBy("t").count().filter("count > 1").select("t")
        index = index.join(shared, "t", "left_semi").join(self.classes.select("k", "first", "bits"), "k")
        self.index = written(index, "index")

    def _reordered(self, common: list[int]) -> tuple[DataFrame, DataFrame]:
        """k, n, i, t of the prefixes in the order that has the common tokens behind all others, and the
        tokens t that no prefix had before. Most rows have enough other tokens among their first ones;
        the lines of the rest are read again."""
        if not common:
            placed = self.rows.select("k", "n", F.posexplode_outer(F.slice("first_tokens", F.lit(1), F.expr(_PREFIX))).alias("i", "t"))
            return placed, placed.limit(0).select("t")
        is_common = lambda t: t.isin(common)
        others = F.filter("first_tokens", lambda t: ~is_common(t))
        rows = self.rows.withColumn("new", F.slice(others, F.lit(1), F.expr(_PREFIX)))
        enough = F.size("new") == F.expr(_PREFIX)
        keys = rows.filter(~enough).select("k").distinct()
        sets = _tokens(self._lines_of(self.classes.join(keys, "k", "left_semi").select("k", "first")), self.ranks).withColumn("__t", F.concat(F.filter("__t", lambda t: ~is_common(t)), F.filter("__t", is_common)))
        sets = sets.withColumn("n", F.size("__t"))
        again = written(sets.select("k", "n", F.posexplode_outer(F.slice("__t", F.lit(1), F.expr(_PREFIX))).alias("i", "t")), "reordered")
        fresh = F.array_except("new", F.slice("first_tokens", F.lit(1), F.expr(_PREFIX)))
        fresh = rows.filter(enough).filter(F.size(fresh) > 0).select(F.explode_outer(fresh).alias("t"))
        return rows.filter(enough).select("k", "n", F.posexplode_outer("new").alias("i", "t")).unionByName(again), fresh.unionByName(again.select("t"))

    def side(self, letter: str) -> DataFrame:
        return self.index.select("t", *[F.col(c).alias(f"{c}_{letter}") for c in ("k", "n", "i", "first", "bits")])

    def earliest(self) -> DataFrame:
        """The side x that is the earliest class of each token."""
        least = self.index.groupBy("t").agg(F.min(F.struct("first", "k", "n", "i", "bits")).alias("e"))
        return least.select("t", *[F.col(f"e.{c}").alias(f"{c}_x") for c in ("k", "n", "i", "first", "bits")])

    def matching(self, pairs: DataFrame) -> DataFrame:
        """k_x, k_y of the candidates (with n_x, i_x, first_x, bits_x, ...) that are alike: length, positional
        and bitmap filter, first tokens, then Jaccard on whole sets of shingles."""
        n, m = F.col("n_x"), F.col("n_y")
        length = (n * 5 >= m * 4) & (m * 5 >= n * 4)
        # tokens that both can still share from here on, against what 0.8 needs of both together
        position = F.least(n - F.col("i_x"), m - F.col("i_y")) * 9 >= (n + m) * 4
        # similar sets have a ninth of both together apart at most
        pairs = pairs.filter(length & position).filter(_bits_apart("bits_x", "bits_y") * 9 <= n + m)
        pairs = self._held_to_first(checkpointed(pairs.select("k_x", "k_y", "n_x", "n_y", "first_x", "first_y").distinct()))
        lines = self._lines_of(pairs.select(F.inline(F.array(*[F.struct(F.col(f"k_{c}").alias("k"), F.col(f"first_{c}").alias("first")) for c in "xy"]))).distinct())
        # hashes first, made once a line and not once a pair; words of what they leave
        hashes = checkpointed(lines.select("k", _hashes("line").alias("of")))
        pairs = self._both(pairs.select("k_x", "k_y"), hashes, "of").filter(_alike(F.col("of_x"), F.col("of_y")))
        pairs = self._both(checkpointed(pairs.select("k_x", "k_y")), lines, "line")
        return pairs.filter(_alike(_shingles("line_x"), _shingles("line_y"))).select("k_x", "k_y")

    @staticmethod
    def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """pairs with the column of the table (k, column) for both."""
        for letter in "xy":
            pairs = pairs.join(table.select(F.col("k").alias(f"k_{letter}"), F.col(column).alias(f"{column}_{letter}")), f"k_{letter}")
        return pairs

    def _held_to_first(self, pairs: DataFrame) -> DataFrame:
        keys = pairs.filter(F.greatest("n_x", "n_y") > self.held).select(F.explode_outer(F.array("k_x", "k_y")).alias("k"))
        first = self.rows.filter(in_sieve(sieve(keys, "k"), F.col("k"))).select("k", "first_tokens").dropDuplicates(["k"])
        for letter in "xy":
            pairs = pairs.join(first.toDF(f"k_{letter}", f"tokens_{letter}"), f"k_{letter}", "left")
        far = _first_apart("tokens_x", "tokens_y") * 9 > F.col("n_x") + F.col("n_y")  # null unless both are there
        return checkpointed(pairs.filter(~F.coalesce(far, F.lit(False))).select("k_x", "k_y", "first_x", "first_y"))

    def _lines_of(self, classes: DataFrame) -> DataFrame:
        """k, line: the first line of each of the classes (k, first). Texts are read once more; sieves thin out what is joined."""
        at, n = counted(classes.select("k", F.col("first.doc_id").alias("d"), F.col("first.h").alias("g"), F.col("first.line_no").alias("no")))
        place = F.xxhash64("h", "line_no")
        lines = _lines(self.docs.filter(in_sieve(sieve(at, "g"), F.col("h")))).filter(in_sieve(sieve(at.withColumn("p", F.xxhash64("g", "no")), "p"), place))
        own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("line_no") == F.col("no"))
        return written(lines.join(F.broadcast(at) if n * 48 <= BROADCAST_BYTES else at, own).select("k", "line").dropDuplicates(["k"]), "texts")


def _alike(a: Column, b: Column) -> Column:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    return F.size(F.array_intersect(a, b)) * 9 >= (F.size(a) + F.size(b)) * 4


def _hashes(line: str) -> Column:
    """Hashes of the distinct shingles of a line."""
    twos = lambda w: F.array(F.struct(w.alias("w"), _joined(w, w, 1).alias("two")))
    both = F.flatten(F.transform(F.array(_word_hashes(line)), twos))
    return F.element_at(F.transform(both, lambda x: F.array_distinct(_shingle_hashes(x["w"], x["two"]))), 1)


def _shingles(line: str) -> Column:
    """The distinct shingles of a line as strings."""
    words = F.array_remove(F.split(F.lower(line), " "), "")
    of = lambda w: F.transform(F.arrays_zip(*[F.slice(w, F.lit(i + 1), _many(w)) for i in range(SHINGLE)]), lambda x: F.concat_ws(" ", *[x[str(i)] for i in range(SHINGLE)]))
    return F.array_distinct(F.flatten(F.transform(F.array(words), of)))


def _many(words: Column) -> Column:
    """How many shingles so many words have."""
    return F.greatest(F.size(words) - (SHINGLE - 1), F.least(F.size(words), F.lit(1)))


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, h, text): the lines that have tokens (doc_id, h, line_no, k, n), the classes
    (k, first, lines) and all links between classes (earlier, later)."""
    join = _Join(docs)
    links = join.matching(join.side("x").join(join.side("y"), "t").filter("first_x < first_y"))
    return join.rows.drop("first_tokens", "bits"), join.classes.drop("bits"), checkpointed(links.toDF("earlier", "later"))


def later_classes(join: _Join) -> DataFrame:
    """k of the classes that match an earlier one.

    One match is enough, so each class is first held against the earliest class of each of its
    tokens, which settles nearly all of a crowd of near copies in a linear number of pairs. Only
    classes still open are held against every earlier one that shares a token.
    """
    earliest = join.earliest()
    settled = checkpointed(join.matching(earliest.join(join.side("y"), "t").filter("first_x < first_y")).select(F.col("k_y").alias("k")).distinct())
    still = join.side("y").join(settled.select(F.col("k").alias("k_y")), "k_y", "left_anti")
    # the earliest of each token has been tried
    others = join.side("x").join(earliest.select("t", F.col("k_x").alias("tried")), "t").filter("k_x != tried").drop("tried")
    rest = join.matching(others.join(still, "t").filter("first_x < first_y")).select(F.col("k_y").alias("k")).distinct()
    return settled.unionByName(rest).distinct()


def later_lines(docs: DataFrame) -> DataFrame:
    """d, g, nos: by document of docs (doc_id, h, text) the numbers of the lines that match an
    earlier line, copies included. Lines are earlier by doc_id, hash of the text and line number."""
    join = _Join(docs)
    gone = checkpointed(later_classes(join).withColumn("gone", F.lit(True)))
    known = checkpointed(join.classes.join(hinted(gone, 16), "k", "left").filter("gone or lines > 1").select("k", "first", "gone"))
    rows = join.rows.select("doc_id", "h", "line_no", "k").filter(in_sieve(sieve(known, "k"), F.col("k")))
    out = rows.join(hinted(known, 56), "k").filter(F.coalesce("gone", F.lit(False)) | (F.struct("doc_id", "h", "line_no") != F.col("first")))
    return checkpointed(out.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("line_no").alias("nos")))


def without_later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gone: str | None = None) -> DataFrame:
    """docs with the lines that match an earlier one taken out of text; columns and rows as in docs.

    Blank lines stay; lines of one to four words match if their words are equal. A null text stays
    null; a text all of whose lines go is empty. Rows equal in doc_id and text count as one document,
    so repeated rows lose the same lines. Null doc_ids come first. Extra columns play no part; an
    empty table gives an empty result. gone names a column to append with the number of lines taken
    out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    later = later_lines(rows).toDF("__d", "__g", "__nos")
    own = F.col(doc_id).eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__g"))
    # texts that the sieve rules out lose nothing and take no part in the join
    touched = in_sieve(sieve(later, "__g"), F.xxhash64(text))
    out = docs.filter(touched).join(later, own, "left").unionByName(docs.filter(~touched), allowMissingColumns=True)
    out = out.withColumn("__lines", F.when(F.col("__nos").isNotNull(), F.split(F.col(text), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__nos"))
    kept = F.when(F.col("__nos").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    cut = [F.coalesce(F.size("__nos"), F.lit(0)).cast("long").alias(gone)] if gone else []
    return out.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *cut)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 of the text that stays."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    rows = without_later_lines(docs.select("doc_id", "text", lines.alias("n_lines")), gone="n_removed")
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from documents where text is not null),
w as (select doc_id, i, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') as w from l),
s as (select doc_id, i, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda p: array_to_string(w[p:p + 4], ' ')))) as s from w where len(w) >= 1),
c as (select s, min(doc_id * 1000000 + i) as first, row_number() over (order by min(doc_id * 1000000 + i)) as k from s group by s),
t as (select k, first, len(s) as n, unnest(s) as t from c),
p as (select a.k as ka, b.k as kb, a.n as na, b.n as nb, count(*) as m from t a join t b on a.t = b.t and a.k < b.k group by a.k, b.k, a.n, b.n),
gone as (select distinct kb as k from p where m * 9 >= (na + nb) * 4),
r as (select s.doc_id as doc_id, s.i as i from s join c on s.s = c.s left join gone on c.k = gone.k where gone.k is not null or s.doc_id * 1000000 + s.i <> c.first),
k as (select l.doc_id as doc_id, count(*) as n_lines, count(r.i) as n_removed, coalesce(string_agg(case when r.i is null then line end, chr(10) order by l.i), '') as kept
  from l left join r on l.doc_id = r.doc_id and l.i = r.i group by l.doc_id)
select d.doc_id as doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  case when d.text is not null then sha256(kept) end as kept_sha256
from documents d left join k on d.doc_id = k.doc_id
"""
