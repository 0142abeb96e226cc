import hashlib
import random

from skylathe.llm import decontaminate


def slow_words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if ord(c) < 128 and not c.isalnum():
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def slow(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = slow_words(text), set(), set()
        for item_id, item in items:
            v = slow_words(item)
            n = min(10, len(v))
            for j in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        names.add("null" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    v = "a b c d é ö ñ X1 y2 z".split()
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 2, 3, 5, 6, 7, 9, 10, 11, 14, 30])))) for i in range(25)]
    items += [(90, None), (91, " ... "), (92, items[3][1]), (None, "nil nil nil nil"), (10, "again ten")]
    docs = []
    for i in range(60):
        text = rng.choices([x.upper() for x in v], k=rng.choice([0, 3, 9, 10, 40]))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(items[5:25])[1].split()[rng.randint(0, 2) :] + rng.choices(v, k=rng.randint(0, 4))
        docs.append((i, rng.choice(" ,\n\x00").join(text)))
    docs += [(100, None), (101, ""), (102, "..."), docs[5], docs[5], (None, "x nil nil nil nil Nil again. TEN"), (None, None), (103, "a b " * 3000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(d, b).collect()), key=str)
    assert got == slow(docs, items)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    clean = [i for i, *_, bad in slow(docs, items) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).first().n_hit == 0
    assert decontaminate.clean(d, b.limit(0)).count() == 1
