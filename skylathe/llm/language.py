"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position and pools the positions'
probabilities to those of the document. It is trained by backpropagation through time, in numpy, on
windows of a bounded sample of labelled rows. Whole texts are labelled: they are cut into windows
that overlap by WARM bytes on either side, over which the state settles, and many windows go through
the network side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, hinted

#: Hidden units of a direction; bytes of a window and of its overlap to either side.
HIDDEN, WINDOW, WARM = 8, 144, 8
#: Bounds of the training sample: rows of a language, rows of all, and bytes taken of a text.
ROWS, TOTAL, SPAN, LENGTH = 400, 40_000, 1024, 64
STEPS, BATCH, RATE, SEED = 500, 192, 0.02, 5
#: Windows that go through the network at once.
_SIDE_BY_SIDE = 8192
_CLASSES = 256


def held_out(doc_id: Column) -> Column:
    """Rows that are not learnt from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _fold() -> np.ndarray:
    """A-Z as a-z; digits alike; other bytes as they are."""
    table = np.arange(_CLASSES)
    table[65:91] += 32
    table[48:58] = 48
    return table


class Network:
    """Weights: x (direction, byte, 3H) holds the input's part of the gates, u (direction, H, 3H) the
    state's, b the candidate's own bias behind the reset gate, v and c the output. Gates are in the
    order update, reset, candidate."""

    def __init__(self, names: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.names, self.h = names, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, _CLASSES, 3 * hidden)),
            "u": rng.normal(0, 0.3, (2, hidden, 3 * hidden)),
            "b": np.zeros((2, hidden)),
            "v": rng.normal(0, 0.3, (2 * hidden, len(names))),
            "c": np.zeros(len(names)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, data: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """States (step, window, H) of one direction over data (window, step)."""
        h, x, u, b = self.h, self.p["x"][way], self.p["u"][way], self.p["b"][way]
        n, steps = data.shape
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            a = x[data[:, t]]
            s = state @ u
            gates = np.tanh((a[:, : 2 * h] + s[:, : 2 * h]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:, :h], gates[:, h:]
            own = s[:, 2 * h :] + b
            cand = np.tanh(a[:, 2 * h :] + r * own)
            new = cand + z * (state - cand)
            if keep is not None:
                keep.append((t, state, z, r, own, cand))
            out[t] = state = new
        return out

    def labels(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (step, window, language) at every position."""
        h = self.h
        out = self._states(data, 0) @ self.p["v"][:h]
        out += self._states(data, 1) @ self.p["v"][h:]
        out += self.p["c"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def gradients(self, data: np.ndarray, want: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over positions of weight 1, and its gradients, by backpropagation
        through time. want has a language for each window."""
        h, p = self.h, self.p
        kept = ([], [])
        states = [self._states(data, way, kept[way]) for way in (0, 1)]
        both = np.concatenate(states, axis=2)
        out = both @ p["v"] + p["c"]
        out -= out.max(axis=2, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=2, keepdims=True))
        w = weight.T[:, :, None] / max(1.0, float(weight.sum()))
        hit = np.arange(len(self.names)) == want[:, None]
        loss = -float((out * hit * w).sum())
        d_out = ((np.exp(out) - hit) * w).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"] = d_out.sum(axis=(0, 1))
        g["v"] = np.einsum("tnh,tnk->hk", both, d_out)
        d_both = d_out @ p["v"].T
        for way in (0, 1):
            u, carry = p["u"][way], np.zeros((len(data), h), np.float32)
            for t, before, z, r, own, cand in reversed(kept[way]):
                d = d_both[t, :, way * h : way * h + h] + carry
                d_z = d * (before - cand) * z * (1 - z)
                d_cand = d * (1 - z) * (1 - cand * cand)
                d_r = d_cand * own * r * (1 - r)
                d_own = d_cand * r
                d_s = np.concatenate([d_z, d_r, d_own], axis=1)
                np.add.at(g["x"][way], data[:, t], np.concatenate([d_z, d_r, d_cand], axis=1))
                g["u"][way] += before.T @ d_s
                g["b"][way] += d_own.sum(axis=0)
                carry = d * z + d_s @ u.T
        return loss, g


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = SEED, hidden: int = HIDDEN) -> Network | None:
    """A network fitted to windows of the texts by Adam; None without texts."""
    rows = sorted((t, n) for t, n in zip(texts, langs, strict=True) if t)  # the order rows came in plays no part
    if not rows:
        return None
    net, rng = Network(sorted({n for _, n in rows}), hidden, seed), np.random.default_rng(seed)
    by = [[np.frombuffer(t, np.uint8) for t, n in rows if n == name] for name in net.names]
    fold, m, s = _fold(), {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        want = rng.integers(0, len(by), BATCH)  # languages alike, however many rows each has
        data, weight = np.full((BATCH, LENGTH), 32), np.zeros((BATCH, LENGTH), np.float32)
        for i, k in enumerate(want):
            text = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(text) - LENGTH + 1))
            part = text[at : at + LENGTH]
            data[i, : len(part)], weight[i, : len(part)] = fold[part], 1
        _, g = net.gradients(data, want, weight)
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, x in g.items():
            x = x * min(1.0, 1 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            s[k] = 0.999 * s[k] + 0.001 * x * x
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (text, language) over all positions of each text; zeros for an empty one."""
    inner, fold = WINDOW - 2 * WARM, _fold().astype(np.uint8)
    counts = np.array([-(-len(t) // inner) for t in texts], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    # every text gets WARM blanks in front and blanks up to whole windows behind
    starts = np.concatenate(([0], np.cumsum(counts * inner + 2 * WARM)))
    flat = np.full(starts[-1] + WARM, 32, np.uint8)
    for t, at in zip(texts, starts, strict=False):
        flat[at + WARM : at + WARM + len(t)] = np.frombuffer(t, np.uint8)
    flat = fold[flat]
    text = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    sums, own = np.zeros((len(texts), len(net.names))), np.arange(WINDOW)
    for a in range(0, len(text), _SIDE_BY_SIDE):
        rows, at = text[a : a + _SIDE_BY_SIDE], k[a : a + _SIDE_BY_SIDE] * inner
        probs = net.labels(flat[(starts[rows] + at)[:, None] + own])[WARM : WARM + inner]
        inside = (at[None, :] + np.arange(inner)[:, None] < sizes[rows][None, :]).astype(np.float32)
        np.add.at(sums, rows, np.einsum("tnk,tn->nk", probs, inside))
    return sums / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, lang: str, doc_id: str, text: str, rows: int = ROWS) -> list[tuple]:
    """(lang, bytes) of labelled rows of every language, chosen by a hash of doc_id: the first SPAN
    characters from a hashed place of each text. A language has about `rows` of them, fewer where
    there are so many languages that TOTAL rows would be passed, but its first row by that hash always."""
    usable = docs.filter(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull() & (F.length(text) > 0))
    mark = F.pmod(F.xxhash64(F.col(doc_id), F.lit("language")), F.lit(1 << 30))
    counts = usable.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__n"), F.min(mark).alias("__first"))
    counts = checkpointed(counts)
    most = max(1, min(rows, TOTAL // max(1, counts.count())))
    share = counts.withColumn("__share", F.least(F.lit(1.0), most / F.col("__n")) * (1 << 30))
    at = F.pmod(F.xxhash64(F.col(doc_id)), F.greatest(F.length(text) - SPAN, F.lit(0)) + 1).cast("int") + 1
    taken = usable.join(hinted(share, 64), F.col(lang) == F.col("__lang")).filter((mark < F.col("__share")) | (mark == F.col("__first")))
    return [(r[0], r[1].encode("utf-8", "replace")) for r in taken.select(lang, F.substring(F.col(text), at, F.lit(SPAN))).collect()]


def predictions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (its pooled probability).

    Texts that are null or have no letter, and all texts if nothing can be learnt, are `und` with
    score 0. Repeated rows give repeated equal rows, other columns aren't read, and an empty table
    gives an empty result. Equal texts get equal results up to rounding.
    """
    learnt = sample(docs, lang, doc_id, text)
    net = train([t for _, t in learnt], [n for n, _ in learnt])
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    blank = F.coalesce(~F.col("text").rlike(r"\p{L}"), F.lit(True))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    said = rows.withColumn("said", F.when(~blank, F.col("text"))).select("doc_id", "held_out", _predictor(net)(F.col("said")).alias("p"))
    return said.select("doc_id", "held_out", "p.lang_pred", "p.score")


def _predictor(net: Network):
    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            data = [(i, x.encode("utf-8", "replace")) for i, x in enumerate(batch) if x is not None]
            while data:  # as many texts at once as fill the network
                n = size = 0
                while n < len(data) and (not n or size + len(data[n][1]) < _SIDE_BY_SIDE * (WINDOW - 2 * WARM)):
                    size += len(data[n][1])
                    n += 1
                part, data = data[:n], data[n:]
                probs = pooled(net, [t for _, t in part])
                best = probs.argmax(axis=1)
                for (i, _), k, row in zip(part, best, probs, strict=True):
                    names[i], scores[i] = net.names[k], round(min(1.0, float(row[k])), 6)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict
