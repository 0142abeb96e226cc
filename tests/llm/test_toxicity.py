import math
import random
import re
import zlib

from pyspark.sql import functions as F

from skylathe.llm import toxicity
from tests.llm.test_decontaminate import slow_words

CALM = "the house stands by a river and many trees grow near its banks while birds sing".split()


LEXICON = toxicity.Lexicon(frozenset({"zorb", "zorbl", "quix"}), frozenset({"mild", "zorbla"}))


def slow_features(text):
    text = text or ""
    w = slow_words(text)
    begun = lambda x, of: any(x[:k] in of and len(x[:k]) == k for k in toxicity.BEGINNINGS)
    plain = [x in toxicity.INSULTS for x in w]
    strong = [begun(x, LEXICON.strong) and not p for x, p in zip(w, plain, strict=True)]
    bad = [a or b for a, b in zip(strong, plain, strict=True)]
    near = sum(p and any(y in toxicity.SECOND_PERSON for y in w[max(0, i - 5) : max(0, i - 5) + 11]) for i, p in enumerate(bad))
    squeeze = lambda x: re.sub(r"(.)\1+", r"\1", x)
    hidden = 0
    for t in text.lower().split():
        if re.search(toxicity._ODD, t):
            spelt = "".join(c for c in re.sub(r"[^a-zà-ÿ0-9@$]+$", "", t).translate(str.maketrans(toxicity._LOOKS, toxicity._LETTERS)) if c.isalpha())
            starred = "*" in t.strip("!?.,") and squeeze("".join(c for c in t if c.isalpha()))
            hidden += begun(spelt, LEXICON.strong) or any(squeeze(x) == squeeze(spelt) or starred and any(squeeze(x[:i] + x[i + 1 :]) == starred for i in range(1, len(x) - 1)) for x in toxicity.INSULTS if len(x) > 3)
    n, c = max(1, len(w)), max(1, len(text))
    shouted = sum(len(x) > 1 and x.upper() == x and x.lower() != x for x in text.split(" "))
    hints = sum(begun(x, LEXICON.hints) and not y for x, y in zip(w, strong, strict=True))
    every = sum(plain) + sum(strong) + hidden
    return [every / n, math.log1p(every), sum(plain) / n, sum(strong) / n, hints / n, hidden / n, near / n,
            sum(x in toxicity.SECOND_PERSON for x in w) / n, sum("A" <= x <= "Z" for x in text) / c, shouted / n, text.count("!") / c,
            text.count("?") / c, sum(x in "*$@#%&" for x in text) / c, math.log1p(len(w)), len(text) / n]


DISGUISES = ["1d10t", "id*ot", "m.o.r.o.n", "$cum", "idiooot", "m0r0n!", "w0rthle$$", "p-a-t-h-e-t-i-c", "s*umbag", "l_o_s_e_r"]


def test_features(spark):
    texts = [None, "", "You are an IDIOT!! m0ron, you know? $$$ ÉCOLE", "idiot a b c d e f g you idiot", "! ? * ", "$cum SCUM scum tu", "word " * 5000 + "idiot"]
    texts += ["zorbing quixotic you z0rbing", "zor mildly mil zorblax", "a.b. x1y well-known e.g. hmmm", " ".join(DISGUISES), "they say v1le, re-do, co-op 3.5"]
    rows = toxicity.with_features(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), lexicon=LEXICON).collect()
    for r in rows:
        assert all(math.isclose(a, b) for a, b in zip(r["__f"], slow_features(texts[r.doc_id]), strict=True)), (texts[r.doc_id], r)
    assert [round(r["__f"].disguised * max(1, len(slow_words(texts[r.doc_id])))) for r in rows if r.doc_id in (9, 10, 11)] == [0, len(DISGUISES), 0]


def test_lexicon_is_learnt_and_disguises_are_caught(spark):
    rng = random.Random(10)
    docs, labels = [], []
    for i in range(1500):
        words, toxic = rng.choices(CALM, k=rng.randint(10, 60)), i % 6 == 0
        if toxic:  # a stem that no list holds, with other ends
            words.insert(rng.randint(0, len(words)), "glurb" + rng.choice(["en", "ax", "o", "ist", "u"]))
        if i % 6 == 1:
            words.insert(3, rng.choice(["gluten", "glory"]))
            toxic = False
        if i % 30 == 2:
            words.insert(3, rng.choice(["idiot", "1diot"]))
            toxic = True
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    planted = [(5000 + i, " ".join(rng.choices(CALM, k=20) + [x] + rng.choices(CALM, k=9)), 1) for i, x in enumerate(DISGUISES + ["glurbish", "glurbo"])]
    planted += [(6000 + i, " ".join(rng.choices(CALM, k=20) + [x] + rng.choices(CALM, k=9)), 0) for i, x in enumerate(["glow", "e.g.", "well-known", "vile", "rat", "co-op"])]
    table = spark.createDataFrame(docs + [p[:2] for p in planted], "doc_id long, text string")
    out = {r.doc_id: r.predicted for r in toxicity.scores(table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [out[p[0]] for p in planted] == [p[2] for p in planted]
    held = [(out[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.98 * len(held)


def corpus(spark, n=900):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(CALM, k=rng.randint(4, 60))
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "Scum!", "m0ron", "filthy"]))
        docs.append((i, " ".join(words), 0.5))
        labels.append((i, None, int(toxic != (rng.random() < 0.03))))
    docs += [(n, None, 0.5), (n + 1, "", 0.5), (None, "you idiot", 0.5), docs[0], docs[0]]
    labels += [(0, 1, labels[0][2]), (10**6, 1, 1), (3, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = toxicity.scores(docs, labels).cache()
    assert out.count() == docs.count()
    assert out.filter("score < 0 or score > 1 or score is null or predicted != cast(score >= 0.5 as int)").count() == 0
    held = out.join(labels.filter("toxic is not null and quality is null"), "doc_id").filter("held_out")
    assert held.count() > 100 and held.filter("predicted = toxic").count() > 0.9 * held.count()
    assert out.filter(F.col("held_out") != (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)) % 5 == 0)).count() == 0
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.filter("predicted = 0").count()


def test_few_labels_or_none(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.scores(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0
