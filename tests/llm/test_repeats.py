"""Repeat removal against a dictionary of all 200-byte strings; the index; odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rolebook.llm import repeats as R
from rolebook.llm.queries import QUERIES

L = R.LENGTH


def covered(docs):
    """Flags of repeated bytes of each text."""
    seen = Counter(d[i : i + L] for d in docs for i in range(len(d) - L + 1))
    out = []
    for d in docs:
        flag = np.zeros(len(d) + 1, int)
        for i in range(len(d) - L + 1):
            if seen[d[i : i + L]] > 1:
                flag[i] += 1
                flag[i + L if i + L <= len(d) else len(d)] -= 1
        out.append(np.cumsum(flag)[:-1] > 0)
    return out


def digest(doc, flag):
    spans = int((np.diff(np.concatenate([[0], flag.astype(int)])) == 1).sum())
    return len(doc), int(flag.sum()), spans, hashlib.sha256(bytes(b for b, f in zip(doc, flag, strict=True) if not f)).hexdigest()


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_matching(alphabet):
    """Matching statistics against comparing all pairs of places."""
    rng = random.Random(1)
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))).encode() for _ in range(12)] + [b"aaaaaaaaaa"] * 2 + [b""]
    group = np.sort(np.array([rng.randrange(3) for _ in parts]))
    got = R.RunIndex(parts, group).matching()
    places = [(g, p[i:]) for g, p in zip(group, parts, strict=True) for i in range(len(p) + 1)]

    def common(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for i, (g, x) in enumerate(places):
        assert got[i] == max((common(x, y) for j, (k, y) in enumerate(places) if j != i and k == g), default=0), i


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("aeioustré") for _ in range(rng.randint(1, 8))) for _ in range(n))
    passages = [words(rng.randint(30, 90)) for _ in range(6)]
    docs = []
    for _ in range(50):
        parts = [words(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : rng.randint(a, len(p))], words(rng.randint(0, 30))]
        docs.append(rng.choice([" ", "", "\n"]).join(parts))
    docs += [docs[0], docs[1], docs[1] + "x", "a" * 700, "b" * 199, "b" * 200, "c" * 201, "é" * 120, "ab " * 300, "abc" * 90 + words(50) + "abc" * 80, "", None]
    docs += [words(3) + passages[0] * 3, "x" * 40_000 + words(10)]
    return docs


@pytest.mark.parametrize(("seed", "heavy", "batch"), [(1, 5000, 1 << 20), (2, 5000, 2000), (3, 1, 1 << 20), (4, 3, 3000)])
def test_like_plain(spark, tmp_path, monkeypatch, seed, heavy, batch):
    monkeypatch.setattr(R, "HEAVY", heavy)
    monkeypatch.setattr(R, "BATCH", batch)
    docs = corpus(seed)
    rows = list(enumerate(docs)) + [(None, docs[3]), (0, docs[0]), (5, "another text of the same id " * 20)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, h int, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(((i, *digest(d, f)) for (i, _), d, f in zip(rows, raw, covered(raw), strict=True)), key=repr)
    got = QUERIES["op2_repeats"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.remove(df).collect() == []


def test_shared_below_length(spark):
    """Texts share 190 bytes and nothing longer: an index batch holds no repeat."""
    for seed in range(4):
        rng = random.Random(seed)
        noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
        shared = noise(190)
        docs = [noise(60) + shared + noise(60) for _ in range(4)]
        out = R.remove(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(seed + 1)).collect()
        assert all(r.spans == [] and bytes(r.kept) == docs[r.doc_id].encode() for r in out) and len(out) == 4
    assert R.repeated([d.encode() for d in docs], np.zeros(4, int)) == [[], [], [], []]


def test_heavy_shared_below_length(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAVY", 1)
    test_shared_below_length(spark)


def test_clashing_names(spark):
    """Columns named like the operator's own do not matter."""
    shared = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(300))
    rows = [(i, f"{i} {shared} {i}", 1, "k", 2, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int, z string, m int, lo int")
    assert all(sum(s["end"] - s["start"] for s in r.spans) >= 300 for r in R.remove(df).collect())
