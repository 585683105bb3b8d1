"""Dual-tree Lloyd against plain integers; ties, odd vectors and many labels."""

import hashlib
import math
import random

import numpy as np
import pytest

from rolebook.llm import codebooks as C
from rolebook.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def plain(rows):
    """(rows (vec_id, code, error, label_error), codebook digest) by comparing all pairs."""
    ok = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(ok[0][1]) if ok else 0
    ok = [r for r in ok if len(r[1]) == size]
    at = C.cuts(size)
    cut = [[v[at[p] : at[p + 1]] for p in range(16)] for _, v, _ in ok]
    books = [[c[p] for c in cut[:64]] for p in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, m in mine.items():
                books[p][k] = [sum(col) // len(m) for col in zip(*m, strict=True)]
    out, total = [], {}
    for (i, _, label), c in zip(ok, cut, strict=True):
        best = [nearest(c[p], books[p]) for p in range(16)]
        error = sum(d for d, _ in best)
        total[label] = total.get(label, 0) + error
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), error))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, code, error, total[label]) for i, label, code, error in out], hashlib.sha256(text.encode()).hexdigest()


def vectors(seed, n, size, spread):
    rng = random.Random(seed)
    one = lambda: [float(np.float32(rng.gauss(rng.choice([-1, 0, 2]), spread))) for _ in range(size)]
    rows = [(k * 7 % n, one(), rng.choice([0, 1, None, 5])) for k in range(n)]
    rows += [(n + 1, rows[0][1], 5), (n + 2, rows[0][1], 5), (3, rows[1][1], 0), (3, rows[1][1], 0), (None, one(), 1)]
    rows += [(n + 3, None, 1), (n + 4, [math.nan] * size, 1), (n + 5, [math.inf] + [0.0] * (size - 1), 1), (n + 6, [None] * size, 2)]
    return rows + [(n + 7, [0.0] * (size + 1), 1), (n + 8, [], 1), (n + 9, [0.0] * size, 9)]


@pytest.mark.parametrize(("seed", "n", "size", "spread", "block"), [(1, 300, 64, 0.3, 1 << 19), (2, 200, 32, 0.01, 2000), (3, 20, 16, 1.0, 1 << 19), (4, 150, 40, 0.5, 900), (5, 120, 5, 3.0, 300)])
def test_like_plain(spark, tmp_path, monkeypatch, seed, n, size, spread, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = vectors(seed, n, size, spread)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op13_codebooks"](spark, str(tmp_path)).collect()
    want, books = plain(rows)
    assert {r.codebooks_sha256 for r in got} == {books}
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["grid", "one point", "large"])
def test_assign(kind):
    """Ties go to the lower index, whole nodes are summed alike, large values are exact."""
    rng = np.random.default_rng(1)
    points = {"grid": rng.integers(-3, 4, (700, 3)), "one point": np.zeros((300, 4), np.int64), "large": rng.integers(-(1 << 29), 1 << 29, (500, 4))}[kind].astype(np.int64)
    entries = points[:: max(1, len(points) // 40)][:64]
    code, total, count, work = C.assign(points, entries)
    d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all()
    assert (count == np.bincount(code, minlength=len(entries))).all()
    for k in range(len(entries)):
        assert (total[k] == points[code == k].sum(0)).all()
    if kind == "one point":
        assert work.tolist() == [0, 300 * len(entries)] or work[0] >= 1


def test_pruning_takes_whole_nodes():
    """Well separated clusters are assigned node by node, not row by row."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-100_000, 100_000, (8, 4))
    points = (middle[rng.integers(0, 8, 4000)] + rng.integers(-50, 50, (4000, 4))).astype(np.int64)
    *_, (whole, single) = C.assign(points, middle.astype(np.int64))
    assert whole < 200 and single < 1000  # of 32,000


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(C, "LABELS", 1)
    rows = vectors(6, 100, 16, 1.0)
    out, books = C.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    got = [(r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain(rows)[0], key=repr)
    back = {r.vec_id: r.v for r in C.decode(out, books).collect()}
    near = {r[0]: r[1] for r in rows if r[1] is not None and len(r[1]) == 16}
    error = {r[0]: r[2] for r in got}
    x = back[100 + 9]
    assert sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(near[109], x, strict=True)) == error[109]


def test_empty(spark, tmp_path):
    for rows in ([], [(1, None, 1, "x", 1)], [(1, [], None, "x", 1), (2, [], 3, "x", 1)]):
        out, books = C.compress(spark.createDataFrame(rows, SCHEMA))
        got = sorted((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in out.collect())
        assert got == [(r[0], "00" * 16, 0, 0) for r in rows if r[1] is not None]
        assert C.codebooks_text(books) == ""


def test_huge_values_do_not_fail(spark):
    rows = [(k, [3e38 if k % 2 else -3e38] * 16, k % 3, "x", 1) for k in range(200)]
    out, _ = C.compress(spark.createDataFrame(rows, SCHEMA))
    assert {r.error for r in out.collect()} == {0}
