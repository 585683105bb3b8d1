"""FTRL toxicity: features against plain strings, held-out accuracy, odd rows."""

import math
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from rolebook.llm import texts as X
from rolebook.llm import toxicity as T

TEXTS = ["The cat, the CAT sat.", "", "é one", "cat", "a b c d", "...", "the cat sat"]


def test_features():
    """Equal words, pairs and skips share a coordinate; nothing crosses texts."""
    data = np.frombuffer("".join(TEXTS).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in TEXTS)])
    words = [re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for t in TEXTS]
    parts = T.Hasher().features(data, at)
    name = {}
    for gap, (coordinate, row) in enumerate(parts):
        want = [(k, (w[i], w[i + gap])) for k, w in enumerate(words) for i in range(len(w) - gap)]
        assert row.tolist() == [k for k, _ in want]
        for c, (_, pair) in zip(coordinate.tolist(), want, strict=True):
            assert name.setdefault((gap, pair), c) == c
    assert len(set(name.values())) == len(name)


def test_learn():
    rows = [(np.array([k % 7, 100 + k % 2, 1 << T.BITS]), float(k % 2)) for k in range(400)]
    m = T.learn(rows)
    w = dict(zip(m.index.tolist(), m.weight.tolist(), strict=True))
    assert w[101] > 0 > w[100] and not {0, 1, 2, 3, 4, 5, 6} & {i for i, x in w.items() if abs(x) > abs(w[101]) / 2}


def test_rows(spark):
    docs = [(i, f"some word {i % 5} {'vile' if i % 4 == 0 else 'calm'} thing", 9) for i in range(400)]
    docs += [(1000, None, 9), (1001, "", 9), (1002, "vile", 9), (1002, "vile", 9), (None, "vile", 9), (1003, "calm " * 90000 + "vile", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(4, 0), (5, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    out = defaultdict(list)
    for r in T.score(d, T.train(d, marks, F.lit(True))).collect():
        out[r.doc_id].append(r.score)
    assert out[1000] == out[1001] and out[1002][0] == out[1002][1] == out[None][0]
    assert out[1002][0] > 0.5 > out[1][0] and out[1003][0] > out[1001][0] - 1
    assert sum(map(len, out.values())) == len(docs)
    none = T.train(d, marks.limit(0), F.lit(True))
    assert {r.score for r in T.score(d, none).collect()} == {0.5}
    assert T.score(d.limit(0), none).collect() == []


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels, X.crc_mod(F.col("doc_id"), 4) != 2)
    got = T.score(docs, model).join(labels, "doc_id").where(X.crc_mod(F.col("doc_id"), 4) == 2).select("score", "toxic").toPandas()
    hit = got.score >= 0.3
    assert (hit & (got.toxic == 1)).sum() >= 0.9 * hit.sum()
    assert (hit & (got.toxic == 1)).sum() >= 0.8 * (got.toxic == 1).sum()


def test_updates_like_plain():
    """Every coordinate's sums and weights as the update rule gives them one by one."""
    rng = random.Random(4)
    rows = [(np.array([*sorted(rng.sample(range(40), rng.randint(1, 8))), 1 << T.BITS], np.int32), float(rng.random() < 0.5)) for _ in range(60)]
    z, n = {}, {}

    def weight(i):
        pull = 0.0 if i == 1 << T.BITS else T.L1
        zi = z.get(i, 0.0)
        if abs(zi) <= pull:
            return 0.0
        return -(zi - math.copysign(pull, zi)) / ((T.BETA + math.sqrt(n.get(i, 0.0))) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for where, y in rows:
            w = {int(i): weight(int(i)) for i in where}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / T.ALPHA * wi
                n[i] = was + g * g
    model = T.learn(rows)
    want = {i: weight(i) for i in z if i != 1 << T.BITS and weight(i)}
    assert set(model.index.tolist()) == set(want)
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert abs(model.bias - weight(1 << T.BITS)) < 1e-9
