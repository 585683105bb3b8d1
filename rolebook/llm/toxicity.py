"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased),
pairs of neighbours and pairs that skip one word, hashed into ``1 << BITS`` coordinates;
a text has a feature once, however often it occurs. Training takes the rows one by one; each coordinate has its own
rate, and L1 keeps most weights at exactly zero, so only the others are broadcast.

A null or empty text has no features and gets the score of the bias. Labels: null
ones are left out, contradicting ones count as toxic; repeated rows give repeated rows.
With no labelled row the bias is 0 and every score 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

#: Coordinates of the hashed space: the bound of the weights that are broadcast.
BITS = 20
#: Bounds of the training sample: labelled rows, in the order of a hash of their id,
#: and bytes of one such row (longer rows are not learned from).
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 1 << 15
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 8.0, 0.0

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))

#: Byte -> 0 between words, else the lower-cased byte.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Feature coordinates of runs of texts; keeps the powers of the base."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1), _powers(_UNBASE, 1)

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, row of each word)."""
        if len(data) >= len(self.up):
            n = max(len(data) + 1, X.RUN_BYTES + 1)
            self.up, self.down = _powers(_BASE, n), _powers(_UNBASE, n)
        low = _WORD[data]
        inside = low != 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = inside[first]
        last = at[1:][at[:-1] < at[1:]] - 1
        ends[last] = inside[last]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * self.up[: len(data)], out=sums[1:])
        return _mix((sums[e + 1] - sums[b]) * self.down[b]), np.searchsorted(at, b, side="right") - 1

    def features(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(coordinate, row)] of words, pairs and skipping pairs; rows ascend."""
        h, row = self.words(data, at)
        out = [(h, row)]
        for gap in (1, 2):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                out.append((_mix(h[:-gap] * _M3 + h[gap:] + np.uint64(gap))[same], row[gap:][same]))
        return [((x >> np.uint64(64 - BITS)).astype(np.int64), r) for x, r in out]


@dataclass
class Model:
    """The coordinates whose weight is not zero, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def learn(rows: list[tuple[np.ndarray, float]]) -> Model:
    """FTRL-proximal over (coordinates, label) rows, in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS  # not held back by L1

    def weights(i: np.ndarray) -> np.ndarray:
        pull = np.where(i == bias, 0.0, L1)
        zi = z[i]
        return np.where(np.abs(zi) <= pull, 0.0, -(zi - np.sign(zi) * pull) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y in rows:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    keep = np.flatnonzero(w[:-1])
    return Model(keep, w[keep].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows for whose id (as column ``doc_id``) ``use`` holds. The
    sample, bounded by ``SAMPLE_ROWS`` and ``SAMPLE_BYTES``, is learned in one task,
    as the updates follow one another; only the model comes to the driver."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(use)
    chosen = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    own, h = F.col("text"), F.xxhash64("doc_id", "text")
    rows = X.pairs(docs, id_col, text_col).where("text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    # SAMPLE_ROWS pairs of numbers at most
    rows = rows.join(F.broadcast(chosen), "doc_id")
    # one text an id, however many rows share it
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(h.alias("h"), own.alias("text"))).alias("x")).select("y", "x.text", "x.h")

    def fit(batches):
        hasher, rows = Hasher(), []
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in X.text_runs(batch.column(1)):
                parts = hasher.features(data, at)
                where, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(row, kind="stable")
                for k, own in enumerate(np.split(where[order], np.searchsorted(row[order], np.arange(1, hi - lo)))):
                    rows.append((np.append(np.unique(own), 1 << BITS).astype(np.int32), float(y[lo + k] > 0)))
        m = learn(rows)
        yield pa.RecordBatch.from_arrays([pa.array([m.index.tolist()], pa.list_(pa.int64())), pa.array([m.weight.tolist()], pa.list_(pa.float32())), pa.array([m.bias])], ["i", "w", "b"])

    got = rows.repartition(1).sortWithinPartitions("h", "y").mapInArrow(fit, "i array<long>, w array<float>, b double").collect()
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    return Model(np.array(got[0].i, np.int64), np.array(got[0].w, np.float32), got[0].b)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept: dict = {}

    def columns(batch: pa.RecordBatch) -> list:
        m = sent.value
        if not kept:
            dense = np.zeros(1 << BITS, np.float32)
            dense[m.index] = m.weight
            kept.update(dense=dense, hasher=Hasher())
        out = []
        for lo, hi, data, at in X.text_runs(batch.column(1)):
            hits = []
            for i, row in kept["hasher"].features(data, at):
                own = np.flatnonzero(kept["dense"][i])
                hits.append(row[own] << BITS | i[own])
            once = np.unique(np.concatenate(hits))
            total = m.bias + np.bincount(once >> BITS, weights=kept["dense"][once & ((1 << BITS) - 1)], minlength=hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return [batch.column(0), pa.array(np.concatenate(out))]

    return X.map_batches(X.pairs(df, id_col, text_col), columns, "doc_id long, score double")
