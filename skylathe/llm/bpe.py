"""Byte-level BPE encoding and decoding with a public tokenizer file.

Encoding: every task splits its texts into words, a block of texts at a time, and writes each text as
positions in its block's list of distinct words. The places (block, position) of all blocks are dealt
out and sorted by word, so a distinct word is a run that is encoded once; its ids go to each of its
places and are joined back by block and position, where the texts take theirs. A frequent word so
moves once a block, however often it occurs. Blocks are bucketed by number, so only the lists move.

Decoding: the ids of a batch of texts are joined with the table of pieces (id, piece), which is as long
as the vocabulary and so broadcast; the pieces of a text are then its bytes.

The file's form: byte-level BPE with its usual word pattern, without a normalizer, plain special
tokens. Others are refused.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import json
import os
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder
from .vectors import clashing

#: A function of a batch of lists of ids to a column.
Of = Callable[[pa.ListArray], pa.Array]
#: Characters of a block of texts; a block is more only by its last text.
BLOCK = 1 << 25
#: Places that a task sorts by block before it sends their ids there, and ids that a lookup takes at once.
PLACES, IDS = 1 << 17, 1 << 18
#: Words of the byte-level pre-tokenizer.
WORD = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts of these characters only, whose classes are ranges, are split by a faster pattern with the same words.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
PLAIN_WORD = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


@functools.cache
def _splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def words_of(text: str, special: re.Pattern | None = None) -> list[str]:
    """The words of a text; special tokens, which cut it first, stand as words of their own. Texts with
    characters that Python doesn't know yet go by the library's own splitter, which may hold another edition of Unicode."""
    if special is not None and special.search(text):
        return [w for part in special.split(text) if part for w in ([part] if special.fullmatch(part) else words_of(part))]
    if PLAIN.fullmatch(text):
        return PLAIN_WORD.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]
    return WORD.findall(text)


def tokenizer_file(path: str) -> tuple[str, list[str], int]:
    """The file's JSON, its special tokens and its largest id."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    told = json.loads(text)
    split = told.get("pre_tokenizer") or {}
    fits = told["model"]["type"] == "BPE" and not told["model"].get("dropout") and not told.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not fits or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
        raise ValueError(f"{path} isn't a byte-level BPE with the usual words and plain special tokens")
    ids = [*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])]
    return text, sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True), max(ids)


def _whole(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, seven bits a byte, the last byte of each below 128; compressed."""
    n = 1 + sum((numbers >= 1 << bits).astype("u1") for bits in (7, 14, 21, 28))
    most = int(n.max(initial=1))
    out = np.empty((len(numbers), most), "u1")
    for j in range(most):
        out[:, j] = (numbers >> 7 * j & 127) | (n > j + 1).astype("u1") << 7
    data = out[np.arange(most) < n[:, None]].tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def _restored(data: bytes) -> np.ndarray:
    b = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), "u1")
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = (b[starts] & 127).astype("u4")
    for j in range(1, int((ends - starts).max(initial=0)) + 1):
        more = np.flatnonzero(ends - starts >= j)
        out[more] |= (b[starts[more] + j] & 127).astype("u4") << 7 * j
    return out


def _blocks(special: list[str], key: pa.DataType):
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(key)), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("position", pa.int32()), ("word", pa.string())])

    def block(number: int, keys: list, found: list[np.ndarray], numbers: _Numbers) -> Iterator[pa.RecordBatch]:
        codes, n = np.concatenate(found), len(numbers)
        order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")  # frequent words have low positions
        rank = np.empty(n, "<u4")
        rank[order] = np.arange(n)
        texts = [pa.array([x], t) for x, t in zip((number, keys, [len(x) for x in found], _squeezed(rank[codes])), schema.types[:4], strict=True)]
        yield pa.RecordBatch.from_arrays([*texts, pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())], schema=schema)
        words = [pa.array(np.full(n, number)), *(pa.nulls(n, t) for t in schema.types[1:4]), pa.array(rank.astype("i4")), pa.array(list(numbers), pa.string())]
        yield pa.RecordBatch.from_arrays(words, schema=schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, found, numbers, size = [], [], _Numbers(), 0
        for batch in batches:
            for k, text in zip(batch["key"], batch["text"], strict=True):
                text = text.as_py() or ""
                words = words_of(text, cut)
                keys.append(k.as_py())
                found.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text)
                if size >= BLOCK:
                    yield from block(number, keys, found, numbers)
                    number, keys, found, numbers, size = number + 1, [], [], _Numbers(), 0
        if keys:
            yield from block(number, keys, found, numbers)
        del keys, found, numbers
        _given_back()

    return split


def _runs(file):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, positions, sizes, ids of places in the order of their words; a row holds many places of a block."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own, last, known = Tokenizer.from_str(file.value), None, np.zeros(0, "u4")
        own.no_truncation()
        own.no_padding()
        waiting, n = [], 0
        for batch in _and_none(batches):
            if batch is not None and len(batch):
                runs = batch["word"].dictionary_encode()
                words = runs.dictionary.to_pylist()
                new = words[words[0] == last :]
                ids = [np.array(e.ids, "u4") for e in own.encode_batch_fast(new, add_special_tokens=False)]
                ids = [known, *ids] if len(new) < len(words) else ids
                last, known = words[-1], ids[-1]
                waiting.append((batch["block"].to_numpy(), batch["position"].to_numpy(), [ids[i] for i in runs.indices.to_numpy()]))
                n += len(batch)
            if waiting and (batch is None or n >= PLACES):
                block, position = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
                ids = [x for w in waiting for x in w[2]]
                order = np.lexsort((position, block))
                edges = [0, *np.flatnonzero(np.diff(block[order])) + 1, len(order)]
                runs = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                packed = [(int(block[r[0]]), _squeezed(np.diff(position[r], prepend=0)), _squeezed(np.array([len(ids[i]) for i in r])), _squeezed(np.concatenate([ids[i] for i in r]))) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*packed, strict=True)], ["block", "positions", "sizes", "ids"])
                waiting, n = [], 0
                _given_back()

    return encode


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by its block."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    writer = df.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9")
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", columns: dict[str, tuple[str, Of]] | None = None) -> DataFrame:
    """key, ids (array<int>): each row's text as the tokenizer file at path encodes it, without adding
    special tokens; those that stand in a text are found. columns: other columns in place of ids, by
    name a type and a function of a batch of ids, so that what is made of the ids needs no further step.

    A null text is like an empty one and has no ids. Repeated rows and null keys are rows of their
    own; other columns aren't read. An empty table gives an empty result. A block's distinct words
    are what a task holds at most, besides one text. The blocks are a table blocks_... of the current database, kept in the shared folder.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    own, special, _ = tokenizer_file(path)
    columns = columns or {"ids": ("array<int>", lambda ids: ids)}
    rows = clashing(docs, [key, text]).toDF("key", "text")
    kind = rows.schema["key"].dataType
    buckets = min(max(rows.rdd.getNumPartitions(), 1), 100_000)
    table = _bucketed(rows.mapInArrow(_blocks(special, to_arrow_type(kind)), f"block long, keys array<{kind.simpleString()}>, lengths array<int>, codes binary, position int, word string"), buckets)
    places = table.filter("word is not null").select("block", "position", "word").repartition("word").sortWithinPartitions("word")
    found = places.mapInArrow(_runs(spark.sparkContext.broadcast(own)), "block long, positions binary, sizes binary, ids binary")
    key_kind = to_arrow_type(kind)

    def put(texts: pa.Table, told: pa.Table) -> pa.Table:
        place, sizes, every = (np.concatenate([np.zeros(0, "u4"), *(unpack(x) for x in told[c].to_pylist())]) for c, unpack in (("positions", lambda x: np.cumsum(_restored(x))), ("sizes", _restored), ("ids", _restored)))
        place, every = place.astype(np.int64), every.astype("i4")
        start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        size[place] = sizes
        start[place] = np.cumsum(sizes, dtype=np.int64) - sizes
        keys, values, offsets = [], [], [np.zeros(1, np.int64)]
        for own, lengths, packed in zip(texts["keys"], texts["lengths"], texts["codes"], strict=True):
            codes = _restored(packed.as_py())
            at = np.concatenate([[0], np.cumsum(_whole(lengths.values))])
            for a, b in zip(at[:-1], at[1:], strict=True):
                c = codes[a:b]
                each = size[c]
                values.append(every[np.repeat(start[c] - (np.cumsum(each) - each), each) + np.arange(each.sum())])
            keys.append(own.values)
            offsets.append(np.array([len(x) for x in values[-len(lengths.values) :]], np.int64))
        bounds = np.cumsum(np.concatenate(offsets)).astype("i4")
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*values, np.zeros(0, "i4")])))
        del values, every, place, start, size
        out = pa.table([pa.chunked_array(keys, key_kind), *(f(lists) for _, f in columns.values())], ["key", *columns])
        _given_back()
        return out

    texts = table.filter("codes is not null").select(F.col("block").alias("of"), "keys", "lengths", "codes")
    out = texts.groupBy("of").cogroup(found.groupBy("block")).applyInArrow(put, f"key {kind.simpleString()}, {', '.join(f'`{c}` {t}' for c, (t, _) in columns.items())}")
    return out.withColumnRenamed("key", key)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: the bytes of every id of a tokenizer file, special tokens included."""
    own, _, _ = tokenizer_file(path)
    told = json.loads(own)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    raw = lambda s: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
    rows = {i: raw(s) for s, i in told["model"]["vocab"].items()} | {t["id"]: raw(t["content"]) for t in told["added_tokens"]}
    return spark.createDataFrame(pa.table({"id": pa.array(list(rows), pa.int32()), "piece": pa.array(list(rows.values()), pa.binary())}))


def _given_back() -> None:
    """Returns freed memory to the system; Python workers live on, and what each task used would pile up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _side_by_side(ids: pa.ListArray, table: pa.BinaryArray) -> Iterator[memoryview]:
    """The entries of table that each list's ids choose, in a row; a few lists are looked up at once."""
    sizes = ids.value_lengths().fill_null(0).to_numpy()
    group = np.cumsum(sizes) // IDS
    edges = [0, *np.flatnonzero(np.diff(group)) + 1, len(ids)] if len(ids) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        flat = ids[a:b].flatten()
        chosen = table.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)).fill_null(b"")
        ends = np.frombuffer(chosen.buffers()[1], "<i4", len(chosen) + 1, 4 * chosen.offset) if len(chosen) else np.zeros(1, "<i4")
        ends, data = ends[np.concatenate([[0], np.cumsum(sizes[a:b])])], memoryview(chosen.buffers()[2] or b"")
        yield from (data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
    _given_back()


def _dense(vocabulary: DataFrame) -> pa.BinaryArray:
    """The pieces by id; null where there is none. As long as the vocabulary."""
    told = vocabulary.select("id", "piece").toArrow()
    pieces = [None] * (max(told["id"].to_pylist(), default=-1) + 1)
    for i, piece in zip(told["id"].to_pylist(), told["piece"].to_pylist(), strict=True):
        pieces[i] = piece
    return pa.array(pieces, pa.binary())


def decoder(vocabulary: DataFrame) -> Of:
    """The texts of a batch of ids: their pieces' bytes in a row as UTF-8, what isn't valid replaced. Ids
    are joined with vocabulary (id, piece; a row an id), which goes to every task."""
    told = vocabulary.sparkSession.sparkContext.broadcast(_dense(vocabulary))
    return lambda ids: pa.array([bytes(x).decode("utf-8", "replace") for x in _side_by_side(ids, told.value)], pa.string())


def decode(encoded: DataFrame, vocabulary: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text that its ids' pieces make, as decoder() does.

    Null ids and ids without a piece add nothing; a null or empty array is an empty text. Repeated
    rows are rows of their own. An empty table gives an empty result.
    """
    joined = decoder(vocabulary)

    @F.arrow_udf(T.StringType())
    def texts(ids: pa.Array) -> pa.Array:
        return joined(ids)

    return encoded.withColumn(text, texts(F.col(f"`{ids}`")))


def digest_of_numbers(largest: int) -> Of:
    """Hexadecimal SHA-256 of ids (0 to largest) in decimal, joined by commas."""
    numbers = pa.array([f"{i}," for i in range(largest + 1)], pa.binary())
    return lambda ids: pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in _side_by_side(ids, numbers)], pa.string())


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    texts = decoder(pieces(docs.sparkSession, path))
    columns = {
        "n_tokens": ("long", lambda ids: ids.value_lengths().cast(pa.int64())),
        "ids_sha256": ("string", digest_of_numbers(tokenizer_file(path)[2])),
        "decoded_sha256": ("string", lambda ids: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts(ids)], pa.string())),
    }
    return encode(docs, path, columns=columns)
