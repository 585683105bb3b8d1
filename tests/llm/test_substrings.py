"""Passages of earlier documents against a dictionary of all windows; the tree; odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from rolebook.llm import substrings as S
from rolebook.llm.queries import QUERIES

L = S.LENGTH


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows):
    """(doc_id, n_words, n_removed, digest) of each row."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - L + 1):
            if i is not None:
                x = tuple(w[k : k + L])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - L + 1):
            if i is not None and least[tuple(w[k : k + L])] < i:
                gone.update(range(k, k + L))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["a", "b", "é", "the", "x" * 90, "ü.", "日本"]) + str(rng.randrange(9)) for _ in range(n)]
    passages = [some(rng.randint(40, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += p[a : rng.randint(a, len(p))] + some(rng.randint(0, 30))
        rows.append((i * 7 % 60, rng.choice([" ", "\n", " \t\x0b"]).join(parts)))
    rows += [(100, "go " * 300), (99, "go " * 49), (101, "go " * 50), (102, "\x1f go " * 60), (103, "a b " * 200), (104, "a b " * 60)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (200, rows[3][1] + " end"), (None, rows[1][1]), (None, rows[1][1]), (-5, rows[2][1])]
    return rows + [(300, ""), (301, None), (302, " \n"), (303, " ".join(passages[0] * 30)), (304, "y" * 60_000)]


@pytest.mark.parametrize(("seed", "heavy", "batch"), [(1, 1 << 18, 1 << 18), (2, 1 << 18, 500), (3, 1, 1 << 18), (4, 400, 300)])
def test_like_plain(spark, tmp_path, monkeypatch, seed, heavy, batch):
    monkeypatch.setattr(S, "HEAVY", heavy)
    monkeypatch.setattr(S, "BATCH", batch)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, h int, spans string, low int")
    df.repartition(seed).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_substrings"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain(rows), key=repr)


def test_tree():
    """Nodes hold the suffixes that share a window, and no other; depth is what they share."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 400).astype(np.uint64)
    parts = [base[a : a + n] for a, n in ((0, 84), (10, 70), (0, 60), (200, 80), (215, 60), (330, 50))] + [np.zeros(84, np.uint64)] * 2
    tree = S.SubTree(parts)
    windows = {}
    for k, p in enumerate(parts):
        for i in range(len(p) - L + 1):
            windows.setdefault(p[i : i + L].tobytes(), set()).add((k, i))
    nodes = [set(zip(tree.part[f : z + 1].tolist(), tree.start[f : z + 1].tolist(), strict=True)) for f, z in zip(tree.first, tree.last, strict=True)]
    assert sorted(map(sorted, nodes)) == sorted(map(sorted, windows.values()))
    for node, depth in zip(nodes, tree.depth, strict=True):
        tails = [parts[k][i:] for k, i in node]
        n = min(map(len, tails))
        same = np.cumprod([len({int(t[j]) for t in tails}) == 1 for j in range(n)]).sum()
        assert depth == (0 if len(node) == 1 else min(same, 63))


def test_long_text(spark):
    """A text longer than a run of texts and than a chunk of hashed bytes."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, "before " + long[1000:90_000] + " after"), (3, long)]
    out = S.remove(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect())
    assert got == sorted(plain(rows))


def test_other_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    out = S.remove(spark.createDataFrame([("b", text), ("a", text), ("ab", text + " z")], "name string, body string"), "name", "body")
    assert sorted((r.doc_id, r.n_words, r.kept) for r in out.collect()) == [("a", 60, text), ("ab", 61, "z"), ("b", 60, "")]
    assert S.remove(spark.createDataFrame([], "doc_id long, text string")).collect() == []
