"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are DataFrame expressions over the whole text: densities of insults from a fixed list and
from a lexicon learnt from labelled rows, disguised insults (symbols, digits, separators, stretched
letters), how many of them have a second person near, capitals, words in capitals, punctuation and
symbols. The learnt lexicon holds beginnings of words (4 to 6 characters) by how much likelier toxic
rows hold them; each half of the labelled rows gets its features from the lexicon of the other half,
so the trees don't see a row's own label in them. Lexicon, trees and calibration come from a sample
of labelled rows that TRAIN_ROWS bounds; texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checkpointed, written
from .decontaminate import words

#: Most labelled rows that are learnt from; of them the share that calibrates; trees, their depth and
#: fewest rows of a leaf.
TRAIN_ROWS, CALIBRATE, TREES, DEPTH, LEAF, RATE, SEED = 20_000, 0.25, 15, 3, 5, 0.3, 7
#: Words from an insult within which a second person counts as near.
NEAR = 5
#: Learnt beginnings of words: their lengths, the toxic rows that must hold one, the log odds from
#: which one counts as strong or as a hint, and the most of them that are kept.
BEGINNINGS, SUPPORT, STRONG, HINT, LEXICON = (4, 5, 6), 5, 4.0, 2.0, 4000

#: Insults that texts in the languages at hand use; words that are also plain ones are left to the learnt lexicon.
INSULTS = (
    "arsehole asshole bastard bitch bollocks bullshit clown cretin cunt degenerate dickhead dimwit disgusting dumbass dunce "
    "faggot filthy fuck fucker fucking garbage halfwit hideous idiot idiotic idiots imbecile jackass jerk lunatic loser losers "
    "maggot moron moronic morons motherfucker nazi nigger pathetic repulsive retard retarded scum scumbag shit shithead "
    "simpleton slut stupid subhuman swine tosser trash twat twit vermin wanker whore worthless wretch "
    "abruti arschloch connard conne crétin débile dummkopf estúpido idiota imbécil imbécile merde mierda miststück puta pute "
    "salaud salope scheiße schlampe trottel wichser"
).split()
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Characters that stand for letters.
_LOOKS, _LETTERS = "013457@$!+|", "oieastasiti"
_SYMBOLS = "*$@#%&"
#: Words with something before or between their letters, or a letter thrice.
_ODD = r"[a-z][0-9@$!+|*._\-]+[a-z]|[0-9@$][a-z]|([a-z])\1\1"

FEATURES = ["bad", "bad_count", "insults", "learnt", "hints", "disguised", "near_you", "second_person", "capitals", "shouted", "exclamations", "questions", "symbols", "length", "word_length"]


def _squeezed(word: str) -> str:
    return "".join(c for i, c in enumerate(word) if i == 0 or c != word[i - 1])


#: The fixed insults with letters that repeat written once, and with one inner letter starred out.
_PLAIN = sorted({_squeezed(w) for w in INSULTS if len(w) > 3})
_STARRED = sorted({_squeezed(w[:i] + w[i + 1 :]) for w in INSULTS if len(w) > 3 for i in range(1, len(w) - 1)})


class Lexicon:
    """Learnt beginnings of words, strong ones and hints."""

    def __init__(self, strong: frozenset[str] = frozenset(), hints: frozenset[str] = frozenset()):
        self.strong, self.hints = strong, hints
        self.gate = sorted({p[: BEGINNINGS[0]] for p in strong | hints})

    @staticmethod
    def _begins(word: Column, entries: frozenset[str]) -> Column:
        found = F.lit(False)
        for k in BEGINNINGS:
            own = sorted(p for p in entries if len(p) == k)
            found = found | F.substring(word, 1, k).isin(own) if own else found
        return found

    def candidates(self, tokens: str) -> Column:
        """The words among tokens that any entry may begin."""
        return F.filter(tokens, lambda w: F.substring(w, 1, BEGINNINGS[0]).isin(self.gate)) if self.gate else F.array().cast("array<string>")

    def is_strong(self, word: Column) -> Column:
        return self._begins(word, self.strong)

    def is_hint(self, word: Column) -> Column:
        return self._begins(word, self.hints) & ~self.is_strong(word)


def with_features(docs: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """docs with a struct __f of the features; empty and null texts have zeros."""
    lexicon = lexicon or Lexicon()
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__said", said).withColumn("__w", words(said))
    insult = lambda w: w.isin(INSULTS)
    rows = rows.withColumn("__begun", lexicon.candidates("__w"))
    # odd words are looked at only in texts that have any
    small = F.lower("__said")
    odd = F.when(small.rlike(_ODD), F.filter(F.split(small, r"\s+"), lambda t: t.rlike(_ODD))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__odd", odd)
    spelt = lambda t: F.regexp_replace(F.translate(F.regexp_replace(t, r"[^\p{L}0-9@$]+$", ""), _LOOKS, _LETTERS), r"[^\p{L}]", "")
    masked = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}]+|[^\p{L}*]+$", ""), r"[^\p{L}]", "")
    once = lambda t: F.regexp_replace(t, r"(.)\1+", "$1")
    hidden = lambda t: once(spelt(t)).isin(_PLAIN) | lexicon.is_strong(spelt(t)) | (F.contains(t, F.lit("*")) & once(masked(t)).isin(_STARRED))
    rows = rows.withColumn("__hidden", F.size(F.filter("__odd", hidden)))
    # only texts with insults look for where they stand
    bad = lambda w: insult(w) | lexicon.is_strong(w)
    rows = rows.withColumn("__plainly", F.size(F.filter("__w", insult))).withColumn("__learnt", F.size(F.filter("__begun", lambda w: lexicon.is_strong(w) & ~insult(w))))
    at = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: bad(F.get("__w", i)))
    you = F.array(*map(F.lit, SECOND_PERSON))
    close = lambda i: F.arrays_overlap(F.slice("__w", F.greatest(i - NEAR, F.lit(0)) + 1, 2 * NEAR + 1), you)
    near = F.when(F.col("__plainly") + F.col("__learnt") > 0, F.size(F.filter(at, close))).otherwise(0)
    n, chars = F.greatest(F.size("__w"), F.lit(1)), F.greatest(F.length("__said"), F.lit(1))
    count = lambda c: F.length("__said") - F.length(F.replace(F.col("__said"), F.lit(c), F.lit("")))
    symbols = count(_SYMBOLS[0])
    for c in _SYMBOLS[1:]:
        symbols = symbols + count(c)
    every = F.col("__plainly") + F.col("__learnt") + F.col("__hidden")
    values = {
        "bad": every / n,
        "bad_count": F.log1p(every),
        "insults": F.col("__plainly") / n,
        "learnt": F.col("__learnt") / n,
        "hints": F.size(F.filter("__begun", lexicon.is_hint)) / n,
        "disguised": F.col("__hidden") / n,
        "near_you": near / n,
        "second_person": F.size(F.filter("__w", lambda w: w.isin(SECOND_PERSON))) / n,
        "capitals": (F.length("__said") - F.length(F.translate("__said", UPPER, ""))) / chars,
        "shouted": F.size(F.filter(F.split("__said", " "), lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))) / n,
        "exclamations": count("!") / chars,
        "questions": count("?") / chars,
        "symbols": symbols / chars,
        "length": F.log1p(F.size("__w")),
        "word_length": F.length("__said") / n,
    }
    return rows.withColumn("__f", F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])).drop("__said", "__w", "__begun", "__odd", "__hidden", "__plainly", "__learnt")


def learn_lexicon(rows: DataFrame, text: str = "text", label: str = "__y") -> Lexicon:
    """The lexicon of labelled rows, a bounded sample. Only beginnings that enough toxic rows hold are
    counted in the others."""
    def held(part: DataFrame) -> DataFrame:
        begun = F.flatten(F.array(*[F.transform(F.filter("w", lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k)) for k in BEGINNINGS]))  # noqa: B023
        return part.select(words(F.col(text)).alias("w")).select(F.explode_outer(F.array_distinct(begun)).alias("p"))

    of = {bool(r[0]): r[1] for r in rows.groupBy(F.col(label) > 0).count().collect()}
    toxic, clean = of.get(True, 0), of.get(False, 0)
    often = held(rows.filter(F.col(label) > 0)).groupBy("p").agg(F.count("*").alias("c1")).filter(F.col("c1") >= SUPPORT)
    often = checkpointed(often.orderBy(F.desc("c1"), "p").limit(16 * LEXICON))
    calm = held(rows.filter(F.col(label) <= 0)).join(F.broadcast(often.select("p")), "p").groupBy("p").agg(F.count("*").alias("c0"))
    weight = F.log((F.col("c1") + 0.5) / (toxic + 1.0)) - F.log((F.coalesce("c0", F.lit(0)) + 0.5) / (clean + 1.0))
    kept = often.join(calm, "p", "left").select("p", weight.alias("weight")).filter(F.col("weight") >= HINT).orderBy(F.desc("weight"), "p").limit(LEXICON).collect()
    return Lexicon(frozenset(r.p for r in kept if r.weight >= STRONG), frozenset(r.p for r in kept if r.weight < STRONG))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """What fit() learnt: features to a calibrated probability."""

    def __init__(self, constant: float, lexicon: Lexicon | None = None, trees=None, curve=None):
        self.constant, self.lexicon, self.trees, self.curve = constant, lexicon, trees, curve

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with __score appended, 0 to 1."""
        if self.trees is None:
            return docs.withColumn("__score", F.lit(self.constant))
        rows = self._raw(with_features(docs, text, self.lexicon))
        rows = self.curve.transform(rows)
        return rows.withColumn("__score", F.least(F.greatest("__calibrated", F.lit(0.0)), F.lit(1.0))).select(*[F.col(f"`{c}`") for c in docs.columns], "__score")

    def _raw(self, rows: DataFrame) -> DataFrame:
        names = [f"__f_{k}" for k in FEATURES]
        rows = rows.withColumns({f"__f_{k}": F.col(f"__f.{k}") for k in FEATURES})
        rows = VectorAssembler(inputCols=names, outputCol="__x").transform(rows)
        rows = self.trees.transform(rows) if self.trees else rows
        return rows.withColumn("__p", vector_to_array("__prob")[1]) if self.trees else rows


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows that held_out() doesn't keep apart, from `rows` of them at most
    (about that many, chosen by a hash of doc_id).

    Of a doc_id labelled more than once the highest label counts; null labels and labels without
    document teach nothing. Without both classes the model is a constant: their mean, or 0.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).filter(~held_out(F.col(doc_id)))
    named = named.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    share = min(1.0, 0.97 * rows / max(1, named.count()))
    named = named.filter(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(named), F.col("__doc") == F.col("__id"))
    sample = sample.withColumn("__half", F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(2))).withColumn("__part", F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(1000)))
    sample = written(sample.drop("__doc"), "labelled")
    n, mean = sample.agg(F.count("*"), F.avg("__y")).first()
    if not n or mean in (0.0, 1.0):
        return Model(float(mean or 0.0))
    # each half's features come from the lexicon of the other
    seen = [with_features(sample.filter(f"__half = {k}"), lexicon=learn_lexicon(sample.filter(f"__half = {1 - k}"))) for k in (0, 1)]
    features = checkpointed(seen[0].unionByName(seen[1]).drop("text").repartition(8))
    model = Model(float(mean), learn_lexicon(sample))
    ready = model._raw(features)
    learn = ready.filter(F.col("__part") >= int(CALIBRATE * 1000))
    if learn.agg(F.countDistinct("__y")).first()[0] < 2:
        return model
    trees = GBTClassifier(labelCol="__y", featuresCol="__x", predictionCol="__guess", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=LEAF, minInfoGain=0.001, seed=SEED)
    model.trees = trees.setRawPredictionCol("__raw").setProbabilityCol("__prob").fit(learn)
    proofs = model._raw(features).filter(F.col("__part") < int(CALIBRATE * 1000))
    proofs = proofs if proofs.limit(1).count() else model._raw(features)
    model.curve = IsotonicRegression(labelCol="__y", featuresCol="__p", predictionCol="__calibrated").fit(proofs.select("__y", "__p"))
    return model


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts are scored as texts without words. Repeated rows give repeated equal rows;
    other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = fit(docs, labels, doc_id, text, label).score(rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that score below 0.5, columns as in docs."""
    out = fit(docs, labels, doc_id, text, label).score(docs, text).withColumn("__row", F.monotonically_increasing_id())
    # __row keeps the filter where it stands; pushed down, it would compute every feature twice over
    return out.filter("__score < 0.5 and __row >= 0").drop("__score", "__row")
