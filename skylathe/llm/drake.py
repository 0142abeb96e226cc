"""Centroid clustering with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its centroid, lower bounds of the distances to
its few next nearest ones, and one bound for all the remaining ones. When centroids move, the bounds
move along by as much. A vector whose upper bound stays below all others keeps its centroid unseen;
one that only some listed centroids may win over is measured against those; where the remaining ones
can't be ruled out, all are measured and the list is made anew. How many bounds are kept adapts from
round to round to how deep the lists were read.

The table of vectors with their bounds is written once a round, together with each task's component
sums, so a round is one pass and one shuffle of CENTROIDS rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written_at
from .vectors import clashing, integers, usable

CENTROIDS, ROUNDS, SCALE, SIZE = 16, 3, 64, 64
#: Bounds come from square roots of exact integers; they are widened by this part so that rounding can't certify an order.
_SLACK = 1e-9


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) of integer arrays."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 53:  # exact in doubles, whatever the order of the sum
        v, c = v.astype("f8"), c.astype("f8")
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype("i8")
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


class Bounds:
    """Bounds of a batch of vectors: own (n), upper (n), ids and lower (n, b) by distance, rest (n)."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, ids: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.own, self.upper, self.ids, self.lower, self.rest = own, upper, ids, lower, rest

    @classmethod
    def measured(cls, v: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """Bounds of all, by distances to all centroids; of equally near ones the smaller number is first."""
        d = distances(v, c)
        order = np.argsort(d, axis=1, kind="stable")
        near = np.sqrt(np.take_along_axis(d, order, axis=1)) * (1 - _SLACK)
        rest = near[:, b + 1] if len(c) > b + 1 else np.full(len(v), np.inf)
        return cls(order[:, 0], np.sqrt(d[np.arange(len(v)), order[:, 0]]) * (1 + _SLACK), order[:, 1 : b + 1], near[:, 1 : b + 1], rest)

    def moved(self, v: np.ndarray, c: np.ndarray, by: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """Bounds after the centroids moved to c by so much, with b of them kept, and the depth to which
        each list was read (-1: not at all; the whole length plus one: all centroids measured)."""
        n, kept = len(v), self.lower.shape[1]
        upper, lower, rest = self.upper + by[self.own], self.lower - by[self.ids], self.rest - by.max(initial=0)
        certain = upper < np.minimum(lower.min(axis=1, initial=np.inf), rest)
        depth = np.full(n, -1)
        open_ = np.flatnonzero(~certain)
        own, ids = self.own.copy(), self.ids.copy()
        if len(open_):
            listed = np.concatenate([own[open_, None], ids[open_]], axis=1)
            exact = np.stack([((v[open_] - c[listed[:, j]]) ** 2).sum(axis=1) for j in range(kept + 1)], axis=1)
            order = np.lexsort((listed, exact), axis=1)
            exact, listed = np.take_along_axis(exact, order, axis=1), np.take_along_axis(listed, order, axis=1)
            root = np.sqrt(exact)
            own[open_], ids[open_] = listed[:, 0], listed[:, 1:]
            upper[open_], lower[open_] = root[:, 0] * (1 + _SLACK), root[:, 1:] * (1 - _SLACK)
            depth[open_] = (order[:, 0] > 0) * order[:, 0]
            far = open_[upper[open_] >= rest[open_]]
            depth[far] = kept + 1
        out = Bounds(own, upper, ids, lower, rest)
        if b < kept:  # fewer are kept: what goes joins the remainder
            out.rest = np.minimum(rest, lower[:, b:].min(axis=1))
            out.ids, out.lower = ids[:, :b], lower[:, :b]
        again = depth > kept
        if again.any():
            new = Bounds.measured(v[again], c, b)
            for name in ("own", "upper", "ids", "lower", "rest"):
                getattr(out, name)[again] = getattr(new, name)
        return out, depth


_STATE = "vec_id {kind}, v array<int>, own int, upper double, ids array<int>, lower array<double>, rest double, distance long, entry int, n long, sums array<long>, total long, depth int"


def _pass(table: DataFrame, kind: str, c: np.ndarray, by: np.ndarray | None, b: int) -> DataFrame:
    """table's vectors with bounds to the centroids c, and rows (entry, n, sums, total, depth) of each task's sums."""
    size = c.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, totals, deepest = np.zeros(len(c), int), np.zeros(c.shape, int), np.zeros(len(c), int), -1
        whole = lambda x, dtype, n: x.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = whole(batch["v"], "i8", n)
            if by is None:
                bounds = Bounds.measured(v, c, b)
            else:
                old = [batch["own"].to_numpy().astype("i8"), batch["upper"].to_numpy(), whole(batch["ids"], "i8", n), whole(batch["lower"], "f8", n), batch["rest"].to_numpy()]
                bounds, depth = Bounds(*old).moved(v, c, by, b)
                read = depth[depth <= old[3].shape[1]]
                deepest = max(deepest, int(read.max(initial=-1)))
            d = ((v - c[bounds.own]) ** 2).sum(axis=1)
            np.add.at(counts, bounds.own, 1)
            np.add.at(sums, bounds.own, v)
            np.add.at(totals, bounds.own, d)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32())]
            state = [batch["vec_id"], batch["v"], pa.array(bounds.own, pa.int32()), pa.array(bounds.upper), lists(bounds.ids, pa.int32()), lists(bounds.lower, pa.float64()), pa.array(bounds.rest), pa.array(d)]
            yield pa.RecordBatch.from_arrays([*state, *none], names)
        used = np.flatnonzero(counts)
        own = [pa.array(used, pa.int32()), pa.array(counts[used]), lists(sums[used].reshape(-1, size), pa.int64()), pa.array(totals[used]), pa.array(np.full(len(used), deepest), pa.int32())]
        kinds = [id_kind, pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), k) for k in kinds), *own], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(table.schema["vec_id"].dataType)
    names = [x.strip().split(" ")[0] for x in _STATE.split(",")]
    return table.mapInArrow(step, _STATE.format(kind=kind))


def clustered(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, times: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: a row for each vector of
    `size` components, none null or non-finite; other rows are left out.

    Centroids start as the vectors of the smallest hashes of vec_id (rows that repeat an id by their
    components, null ids last), fewer if there are fewer vectors. Vectors with components over
    vectors.LARGEST have null in every column but vec_id. Repeated rows are rows of their own with equal values;
    other columns aren't read. An empty table gives an empty result.
    """
    kept = clashing(df, [vec_id, vector]).toDF("vec_id", "vector").filter(usable("vector") & (F.size("vector") == size))
    rows = kept.select("vec_id", integers("vector", SCALE).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    start = rows.filter("v is not null").orderBy(first, "v").limit(centroids).select("v").collect()
    c = np.array([r[0] for r in start], int).reshape(-1, size)
    none = rows.filter("v is null").select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]])
    if not len(c):
        return none
    b = max(1, min(len(c) - 1, centroids // 4)) if len(c) > 1 else 0
    table, path, by = rows.filter("v is not null"), None, None
    for turn in range(times + 1):
        now, new_path = written_at(_pass(table, kind, c, by, b), "bounds")
        if path:
            dropped(df.sparkSession, path)
        table, path = now.filter("entry is null"), new_path
        sums = now.filter("entry is not null").select("entry", "n", "total", "depth", F.posexplode("sums").alias("at", "sum"))
        sums = sums.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.max("depth").alias("depth"))
        found = sums.collect()  # a number of each component of the centroids
        if turn < times:
            new = c.copy()
            for r in found:
                new[r["entry"], r["at"]] = int(r["sum"]) // r["n"]
            by = np.sqrt(((new - c) ** 2).sum(axis=1)) * (1 + _SLACK)
            if turn:  # as many bounds as were read, within an eighth and a quarter of the centroids
                b = min(b, max(1, centroids // 8, max(r["depth"] for r in found)))
            c = new
    totals = {r["entry"]: r["total"] for r in found}
    told = [(e, total, sum(totals.values()), hashlib.sha256(",".join(map(str, c[e].tolist())).encode()).hexdigest()) for e, total in totals.items()]
    totals = df.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = table.select("vec_id", F.col("own").alias("cluster"), "distance").join(F.broadcast(totals), "cluster")  # a row a centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").unionByName(none)


def _sql() -> str:
    """The rounds, unrolled, for DuckDB."""
    d = "list_sum(list_transform(list_zip(kept.v, {c}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    steps = [
        "kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        "c0 as materialized (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as e, v as q from kept qualify row_number() over (order by sha256('1:' || vec_id)) <= 16)",
    ]
    for i in range(ROUNDS + 1):
        c = f"c{i}"
        d2 = d.format(c=c)
        steps.append(f"a{i} as materialized (select vec_id, v, arg_min({c}.e, {d2} * 1000 + {c}.e) as e, min({d2}) as d from kept, {c} group by vec_id, v)")
        if i < ROUNDS:
            steps.append(f"s{i} as materialized (select e, i, sum(v[i])::bigint as s, count(*) as n from a{i}, range(1, 65) as t(i) group by all)")
            steps.append(f"n{i} as materialized (select e, list((s - ((s % n) + n) % n) // n order by i) as q from s{i} group by all)")
            steps.append(f"c{i + 1} as materialized (select {c}.e, coalesce(n{i}.q, {c}.q) as q from {c} left join n{i} using (e))")
    last = f"c{ROUNDS}"
    return f"with {', '.join(steps)} select vec_id, e as cluster, d as distance, (sum(d) over (partition by e))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string({last}.q, ',')) as centroid_sha256 from a{ROUNDS} join {last} using (e)"


SQL = _sql()
