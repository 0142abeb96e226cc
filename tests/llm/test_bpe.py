import hashlib
import json
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skylathe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, key int, `block.x` int, ids string"
TEXTS = [
    None, "", " ", "a", "Hello world, it's  me!\n\n  we'll see 12 3x", "<|endoftext|>", "so<|endoftext|><|endoftext|> it <|endoftext|", "\t\n  x  y z\x1cq\x85w", "naïve Straße ÇA ²³ ½", "日本語 テスト ١٢٣ हिन्दी",
    "👩‍👩‍👧 é ﻿\x00\x7f", "x" * 5000, "ab " * 3000, " " * 700, "'s 're 'S ''ll _a_ a_b 1_2", "Repeat", "Repeat",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_words_are_those_of_the_library_for_every_code_point(library):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(every), 256):
        text = "".join(f"a{c}{c}1{c} {c}, {c}" for c in every[a : a + 256])
        ends = [b for _, (_, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        words = bpe.words_of(text)
        assert "".join(words) == text
        at, own = 0, []
        for w in words:
            own.append(at := at + len(w))
        assert own == ends, hex(ord(every[a]))


def test_the_fast_pattern_splits_plain_texts_alike():
    rng = random.Random(3)
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if bpe.PLAIN.fullmatch(chr(c))]
    for _ in range(3000):
        text = "".join(rng.choice(plain if rng.random() < 0.3 else "ab 1'sré\n,_ ") for _ in range(rng.randint(0, 30)))
        assert bpe.PLAIN_WORD.findall(text) == bpe.WORD.findall(text)


@pytest.mark.parametrize("block", [1 << 25, 40])
def test_encoding_equals_the_library(spark, library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    rows = [(i if i % 5 else None, t, 1, 2, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = sorted((repr(r["doc_id"]), list(r["ids"])) for r in bpe.encode(df, PATH).collect())
    assert got == sorted((repr(i), _expected(library, t)[0]) for i, t, *_ in rows)


def test_digests_equal_the_library(spark, library):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("abc  éñ'日1<|>\ǹ😀") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids, text = _expected(library, t)
        want.append((i, len(ids), h(",".join(map(str, ids))), h(text)))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], KIND).repartition(4)
    assert sorted(tuple(r) for r in bpe.digests(df, PATH).collect()) == want
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_decoding_any_ids_equals_the_library(spark, library):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.choice([1, 5, 300]))] for _ in range(150)] + [[], [50256, 50256]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.createDataFrame([(i, x, f"t{i}") for i, x in enumerate(lists)], "n long, ids array<int>, `row.id` string").repartition(3)
        got = {r["n"]: (r["row.id"], r["decoded"]) for r in bpe.decode(df, bpe.pieces(spark, PATH)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (f"t{i}", library.decode(x, skip_special_tokens=False)) for i, x in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [None, 11, 99999])], "n long, ids array<int>")
    assert sorted((r["n"], r["decoded"]) for r in bpe.decode(odd, bpe.pieces(spark, PATH)).collect()) == [(1, ""), (2, library.decode([11]))]


def test_other_files_are_refused(tmp_path):
    told = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(told | change))
        with pytest.raises(ValueError):
            bpe.tokenizer_file(str(path))
