"""Product codes of vectors by Lloyd's rounds over kd-trees (the filtering algorithm).

Vectors are cut into PARTS equal parts. Every partition gathers blocks of its vectors and builds a
kd-tree over each part of a block; a node keeps its box, count and component sums. The trees are a
table, written once. In a round each block sends every entry of the codebook down its trees: an
entry that another beats over a node's whole box is dropped there, and a node that one entry is left
for goes to it at once, by its cached count and sum. Only leaves with several entries left look at
points. Rounds send at most PARTS x ENTRIES sums a task to the shuffle; the codebooks, of that fixed
size, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, written
from .vectors import clashing, integers, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and fewest points of a leaf.
BLOCK, LEAF = 1 << 15, 16


class Tree:
    """A kd-tree over integer points (n, d) as arrays: node i of level l holds points n*i >> l to
    n*(i+1) >> l of the tree's order. low, high and sums have the nodes level by level."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 2

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        """Each node is halved at the median of its box's longest side."""
        n, order = len(points), np.arange(len(points))
        depth = max(0, (n // LEAF).bit_length() - 1)
        for level in range(depth):
            starts = cls.bounds(n, level)[:-1]
            side = (np.maximum.reduceat(points, starts) - np.minimum.reduceat(points, starts)).argmax(axis=1)
            node = np.repeat(np.arange(1 << level), np.diff(cls.bounds(n, level)))
            turn = np.lexsort((points[np.arange(n), side[node]], node))
            points, order = points[turn], order[turn]
        starts = cls.bounds(n, depth)[:-1]
        levels = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts))]
        for _ in range(depth):
            low, high, sums = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
        return cls(points, order, *(np.concatenate(x) for x in zip(*levels, strict=True)))

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return n * np.arange((1 << level) + 1) >> level

    def packed(self) -> dict[str, bytes]:
        narrow = {"points": self.points, "turn": self.order, "low": self.low, "high": self.high}
        return {k: v.astype("<i4").tobytes() for k, v in narrow.items()} | {"sums": self.sums.astype("<i8").tobytes()}

    @classmethod
    def unpacked(cls, x: dict[str, bytes], size: int) -> Tree:
        """size: components of a point."""
        wide = lambda k, kind: np.frombuffer(x[k], kind).astype("i8")
        return cls(*(wide(k, "<i4").reshape(-1, size) if k != "turn" else wide(k, "<i4") for k in ("points", "turn", "low", "high")), wide("sums", "<i8").reshape(-1, size))

    def nearest(self, book: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, int]]:
        """start, end, code, node: runs of points in the tree's order with their nearest entry (of
        equally near ones the lower). A node that has one entry left comes whole, with its number
        and one code; a leaf that has more comes with node -1 and a code for each point."""
        n, nodes, entries = len(self.points), np.zeros(1, int), np.arange(len(book))
        sizes = np.array([len(book)])
        for level in range(self.depth + 1):
            first, bounds = (1 << level) - 1, self.bounds(n, level)
            owner = np.repeat(np.arange(len(nodes)), sizes)
            at = first + nodes[owner]
            c, low, high = book[entries], self.low[at], self.high[at]
            starts = np.cumsum(sizes) - sizes
            far = ((2 * c - low - high) ** 2).sum(axis=1)
            centre = far == np.minimum.reduceat(far, starts)[owner]
            best = np.maximum.reduceat(np.where(centre, len(book) - entries, 0), starts)
            rival = (len(book) - best)[owner]
            z = book[rival]
            worse = ((c - z) * (c + z - 2 * np.where(c > z, high, low))).sum(axis=1)
            keep = (worse < 0) | (worse == 0) & (rival >= entries)
            sizes = np.add.reduceat(keep.astype(int), starts)
            owner, entries = owner[keep], entries[keep]
            starts = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(sizes == 1):
                yield bounds[nodes[i]], bounds[nodes[i] + 1], int(entries[starts[i]]), first + nodes[i]
            open_ = np.flatnonzero(sizes > 1)
            if level == self.depth:
                for i in open_:
                    a, b, own = bounds[nodes[i]], bounds[nodes[i] + 1], entries[starts[i] : starts[i] + sizes[i]]
                    d = ((self.points[a:b, None, :] - book[own]) ** 2).sum(axis=2)
                    yield a, b, own[d.argmin(axis=1)], -1
            elif len(open_):
                lists = [entries[starts[i] : starts[i] + sizes[i]] for i in open_]
                entries = np.concatenate([x for own in lists for x in (own, own)])
                nodes = (2 * nodes[open_, None] + [0, 1]).ravel()
                sizes = np.repeat(sizes[open_], 2)
            else:
                return

    def sums_by_entry(self, book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds the points' counts and sums to those of their nearest entries."""
        for a, b, code, node in self.nearest(book):
            if node >= 0:
                counts[code] += b - a
                sums[code] += self.sums[node]
            else:
                np.add.at(counts, code, 1)
                np.add.at(sums, code, self.points[a:b])

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and squared distance of each point, in the order in which they were given."""
        code = np.empty(len(self.points), int)
        for a, b, own, _ in self.nearest(book):
            code[self.order[a:b]] = own
        back = np.empty_like(self.points)
        back[self.order] = self.points
        return code, ((back - book[code]) ** 2).sum(axis=1)


_PACKED = pa.struct([(k, pa.binary()) for k in ("points", "turn", "low", "high", "sums")])
_TREE = "struct<points:binary,turn:binary,low:binary,high:binary,sums:binary>"


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def forest(vectors: DataFrame, size: int, parts: int = PARTS) -> DataFrame:
    """rows (array of the other columns as structs), trees (one for each part): a row a block. vectors
    has a column `row` and `v` with size components."""
    width = size // parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in _and_none(batches):
            if batch is not None:
                waiting.append(batch)
            if waiting and (batch is None or sum(map(len, waiting)) >= BLOCK):
                table = pa.Table.from_batches(waiting)
                for start in range(0, len(table), BLOCK):
                    own = table.slice(start, BLOCK).combine_chunks()
                    v = own["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, size)
                    rows = own["row"].chunk(0)
                    trees = [Tree.over(v[:, k * width : (k + 1) * width]).packed() for k in range(parts)]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([trees], pa.list_(_PACKED))], ["rows", "trees"])
                waiting = []

    row = vectors.schema["row"].dataType.simpleString()
    return vectors.select("row", "v").mapInArrow(build, f"rows array<{row}>, trees array<{_TREE}>")


def entry_sums(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, at, n, sum: count and, by component, sum of the points nearest to each entry."""
    width = books[0].shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), int) for b in books]
        sums = [np.zeros(b.shape, int) for b in books]
        for batch in batches:
            for x in batch["trees"]:
                for k, tree in enumerate(x.as_py()):
                    Tree.unpacked(tree, width).sums_by_entry(books[k], counts[k], sums[k])
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[k][used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(n[used]), lists], ["part", "entry", "n", "sums"])

    found = trees.select("trees").mapInArrow(count, "part long, entry long, n long, sums array<long>")
    found = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    return found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))


def rounds(trees: DataFrame, books: list[np.ndarray], times: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds; unused entries stay."""
    for _ in range(times):
        new = [b.copy() for b in books]
        for part, entry, at, n, total in entry_sums(trees, books).collect():  # a number of each component of the codebooks at most
            new[part][entry, at] = int(total) // n
        books = new
    return books


def codes(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, code (two hex digits a part), error (squared distance over all parts)."""
    width, row = books[0].shape[1], trees.schema["rows"].dataType.elementType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in zip(batch["rows"], batch["trees"], strict=True):
                found = [Tree.unpacked(tree, width).codes(book) for tree, book in zip(x.as_py(), books, strict=True)]
                text = np.stack([c for c, _ in found], axis=1).astype("u1").tobytes().hex()
                each = 2 * len(books)
                code = [text[i : i + each] for i in range(0, len(text), each)]
                yield pa.RecordBatch.from_arrays([rows.values, pa.array(code), pa.array(sum(e for _, e in found))], ["row", "code", "error"])

    return trees.mapInArrow(assign, f"row {row}, code string, error long")


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, times: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each usable vector.

    Null vectors and those with a null or non-finite component are left out. The entries start as
    the vectors of the smallest vec_ids (rows that repeat one by their components, null ids last), fewer if there
    are fewer. Vectors of another length than the first of these, and such as have components over vectors.LARGEST, have a null code and error,
    as have all vectors if the parts can't be equal; label_error passes over them and is null where a label has no other.
    Repeated rows are rows of their own with equal values; other columns aren't read. An empty
    table gives an empty result.
    """
    kept = clashing(df, [vec_id, vector, label]).toDF("vec_id", "vector", "label").filter(usable("vector"))
    rows = kept.select(F.struct("vec_id", "label").alias("row"), integers("vector", SCALE).alias("v"))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)
    least = [F.col("row.vec_id").asc_nulls_last(), "v"]
    first = rows.filter(fit).orderBy(*least).select(F.size("v")).first()
    size = first[0] if first else 0
    fit &= F.size("v") == size
    start = np.array([r[0] for r in rows.filter(fit).orderBy(*least).limit(entries).select("v").collect()], int).reshape(-1, size or parts)
    rest = rows.filter(~F.coalesce(fit, F.lit(False))).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    told, digest = rest, hashlib.sha256(b"").hexdigest()
    if len(start):
        trees = written(forest(rows.filter(fit), size, parts), "trees")
        books = rounds(trees, np.split(start, parts, axis=1), times)
        told = written(codes(trees, books).unionByName(rest), "codes")
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    told = told.select("row.vec_id", "row.label", "code", "error")
    total = hinted(told.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), 32)
    return told.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds, unrolled, for DuckDB."""
    near = "select vec_id, label, k, p, arg_min({c}.e, ({c2} * 1000 + {c}.e)) as e, min({c2}) as d from parts join {c} using (k) group by all"
    steps = [
        "kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        "parts as materialized (select vec_id, label, k, v[k * (len(v) // 4) + 1 : (k + 1) * (len(v) // 4)] as p from kept, range(4) as t(k))",
        "c0 as materialized (select k, (row_number() over (partition by k order by vec_id) - 1)::bigint as e, p as q from parts where vec_id in (select vec_id from kept order by vec_id limit 256))",
    ]
    for i in range(ROUNDS + 1):
        c = f"c{i}"
        steps.append(f"a{i} as materialized ({near.format(c=c, c2=f'list_sum(list_transform(list_zip(parts.p, {c}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint')})")
        if i < ROUNDS:
            steps.append(f"s{i} as materialized (select k, e, i, sum(p[i])::bigint as s, count(*) as n from a{i}, range(1, 17) as t(i) group by all)")
            steps.append(f"n{i} as materialized (select k, e, list((s - ((s % n) + n) % n) // n order by i) as q from s{i} group by all)")
            steps.append(f"c{i + 1} as materialized (select {c}.k, {c}.e, coalesce(n{i}.q, {c}.q) as q from {c} left join n{i} on {c}.k = n{i}.k and {c}.e = n{i}.e)")
    steps.append(f"told as (select vec_id, label, string_agg(printf('%02x', e), '' order by k) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id, label)")
    digest = f"(select sha256(string_agg(array_to_string(q, ','), ',' order by k, e)) from c{ROUNDS})"
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, {digest} as codebooks_sha256 from told"


SQL = _sql()
