"""Counts and nearest points within a radius, over one tile of the sky with what lies about it.

Points are unit vectors seen from the tile's middle, so distances are chords. Those of the right side lie in
strips, sorted along each, so a count is a difference of positions where a strip is surely inside and only points at
the rim are tried: its cost grows with the root of the density, not with all pairs. What is within SLACK of a
radius or of the nearest is handed back, for the caller to settle by its own formula.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Radians; far above the rounding of unit vectors, far below any real difference.
SLACK = 1e-12
#: Points of the right side in a square as high as a strip.
_SQUARE = 16


def _vectors(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)


def _turned(points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """points from middle, the third axis along it."""
    z = middle / np.linalg.norm(middle)
    x = np.cross(z, np.eye(3)[np.argmin(np.abs(z))])
    x /= np.linalg.norm(x)
    return (points - z) @ np.stack([x, np.cross(z, x), z], axis=1)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and position, of all positions in the ranges [low, high)."""
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Strips:
    """Points (rows of 3) in strips of the second axis, sorted along the first; weight: how many each stands for."""

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        y = points[:, 1]
        self.count = max(1, int(np.sqrt(len(y) / _SQUARE)))
        strip = np.minimum(((y - y.min()) / max(np.ptp(y), 1e-300) * self.count).astype(int), self.count - 1)
        self.order = np.lexsort((points[:, 0], strip))
        self.points, self.weight = points[self.order], weight[self.order]
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])
        self.ends = np.searchsorted(strip[self.order], np.arange(self.count + 1))
        self.area = max(np.ptp(points[:, 0]) * np.ptp(y), 1e-300)

    def _meeting(self, rows: np.ndarray, reach: float):
        """Of each strip: where it begins and ends, and the slice of rows (sorted by the second axis) that it may concern."""
        for a, b in zip(self.ends[:-1], self.ends[1:], strict=True):
            if b > a:
                y = self.points[a:b, 1]
                i, j = np.searchsorted(rows[:, 1], [y.min() - reach, y.max() + reach])
                if j > i:
                    yield a, b, slice(i, j)

    def within(self, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight surely within radius of each row (sorted by the second axis), and the pairs (row, point) in doubt."""
        sure, doubt = np.zeros(len(rows), np.int64), []
        inner, outer = max(radius - SLACK, 0.0), radius + SLACK
        for a, b, part in self._meeting(rows, outer):
            x, y, z = rows[part].T
            xs, ys, zs = self.points[a:b].T
            near = np.maximum(0, np.maximum(ys.min() - y, y - ys.max()))
            far = inner**2 - np.maximum(np.abs(y - ys.min()), np.abs(y - ys.max())) ** 2 - np.maximum(np.abs(z - zs.min()), np.abs(z - zs.max())) ** 2
            wide, narrow = np.sqrt(np.maximum(outer**2 - near**2, 0)), np.sqrt(np.maximum(far, 0))
            l0, r0 = a + np.searchsorted(xs, x - wide), a + np.searchsorted(xs, x + wide, "right")
            l1, r1 = a + np.searchsorted(xs, x - narrow), a + np.searchsorted(xs, x + narrow, "right")
            l1, r1 = np.where(far > 0, l1, l0), np.where(far > 0, r1, l0)
            sure[part] += self.sums[r1] - self.sums[l1]
            for low, high in ((l0, l1), (r1, r0)):
                row, at = _ranges(low, high)
                row += part.start
                d = np.linalg.norm(rows[row] - self.points[at], axis=1)
                inside = d <= inner
                sure += np.bincount(row[inside], self.weight[at[inside]], len(rows)).astype(np.int64)
                rim = ~inside & (d <= outer)
                doubt.append(np.stack([row[rim], at[rim]]))
        row, at = np.concatenate([np.empty((2, 0), int), *doubt], axis=1)
        return sure, row, at

    def nearest(self, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, point): the points nearest to each row, all that are so within SLACK, if within radius (and SLACK).
        The first try reaches as far as two points lie on average; rows without one try twice as far."""
        last, found = radius + 2 * SLACK, [np.empty((2, 0), int)]
        reach, open_ = min(last, np.sqrt(2 * self.area / len(self.points)) + 2 * SLACK), np.arange(len(rows))
        while len(open_):
            own, pairs = rows[open_], []
            for a, b, part in self._meeting(own, reach):
                xs, x = self.points[a:b, 0], own[part, 0]
                row, at = _ranges(a + np.searchsorted(xs, x - reach), a + np.searchsorted(xs, x + reach, "right"))
                pairs.append(np.stack([row + part.start, at]))
            row, at = np.concatenate([np.empty((2, 0), int), *pairs], axis=1)
            d, best = np.linalg.norm(own[row] - self.points[at], axis=1), np.full(len(own), np.inf)
            np.minimum.at(best, row, d)
            done = best <= reach - SLACK
            keep = done[row] & (d <= best[row] + SLACK)
            found.append(np.stack([open_[row[keep]], at[keep]]))
            if reach >= last:
                break
            open_, reach = open_[~done], min(last, 2 * reach)
        row, at = np.concatenate(found, axis=1)
        return row, at


def _listed(rows: int, row: np.ndarray, values: pa.StructArray) -> pa.ListArray:
    """Values as a list of each row; row in ascending order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def matched(left: pa.Table, right: pa.Table, radii: list[float]) -> tuple[list[pa.Array], list[pa.Array]]:
    """For left (ra, dec) and right (ra, dec, name, n; positions in degrees): of each radius (arcsec) the count surely
    within; then lists of (ra, dec, n) in doubt, of each radius, and of (ra, dec, name) that may be the nearest within the first."""
    pos = np.stack([left["ra"].to_numpy(), left["dec"].to_numpy()], axis=1).astype(float).reshape(-1, 2)
    known = np.flatnonzero(np.isfinite(pos).all(axis=1))
    places, place = np.unique(pos[known], axis=0, return_inverse=True)  # rows of one position are counted once
    sure, doubt, near = [np.zeros(len(pos), np.int64) for _ in radii], [np.empty((2, 0), int) for _ in radii], np.empty((2, 0), int)
    if len(known) and right.num_rows:
        there, here = _vectors(right["ra"].to_numpy(), right["dec"].to_numpy()), _vectors(*places.T)
        middle = here.mean(axis=0)
        middle = middle if np.linalg.norm(middle) > 1e-3 else here[0]
        strips, rows = Strips(_turned(there, middle), right["n"].to_numpy()), _turned(here, middle)
        order = np.argsort(rows[:, 1], kind="stable")
        rank = np.argsort(order)[place.ravel()]  # of each known row, its place among the sorted rows
        chords = [2 * np.sin(min(r / 3600, 180.0) * np.pi / 360) for r in radii]

        def spread(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Pairs of sorted places as pairs of left's rows."""
            by = np.argsort(row, kind="stable")
            mine, which = _ranges(np.searchsorted(row[by], rank), np.searchsorted(row[by], rank, "right"))
            return np.stack([known[mine], strips.order[at[by][which]]])

        for k, chord in enumerate(chords):
            counts, row, at = strips.within(rows[order], chord)
            sure[k][known], doubt[k] = counts[rank], spread(row, at)
        near = spread(*strips.nearest(rows[order], chords[0]))

    def lists(pairs: np.ndarray, columns: list[str]) -> pa.ListArray:
        taken = right.select(columns).take(pa.array(pairs[1])).combine_chunks()
        return _listed(len(pos), pairs[0], pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns], columns))

    return [pa.array(s) for s in sure], [*[lists(p, ["ra", "dec", "n"]) for p in doubt], lists(near, ["ra", "dec", "name"])]
