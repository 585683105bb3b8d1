"""SimHash links and components against all pairs; odd rows."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rolebook.llm import simhash as S


def plain_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    words = [w for w in t.split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(codes):
    """Union of all pairs at distance 4 or less; the least index names a component."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered(rng, centres, each, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("text", ["", None, "a", "A b\tC\x0bd", "é É ß one two three", " \n", "a\xa0b c", "x " * 70_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shape", [(300, 1, 0), (20, 30, 2), (5, 120, 5), (1, 500, 8), (1, 1, 0)])
def test_index(shape):
    """One bucket holds everything: its labels are the components."""
    codes = clustered(random.Random(3), *shape)
    a = np.array(codes, np.uint64)
    a = a[np.argsort(S.gray_rank(a))]
    label = S.Index(np.zeros(len(a), np.int64), a).join()
    want = plain_components([int(x) for x in a])
    groups = lambda x: {frozenset(np.flatnonzero(np.array(x) == k).tolist()) for k in set(x)}
    assert groups(label.tolist()) == groups(want)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_links(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    codes = clustered(random.Random(5), 40, 12, 5) + [0, 1, 3, 7, 15, 31, 63, (1 << 64) - 1]
    codes = list(dict.fromkeys(codes))
    df = spark.createDataFrame([(as_long(c),) for c in codes], "fp long")
    roots = {r.node: r.root for r in S.connected(S.links(df)).collect()}
    want = plain_components(codes)
    got = defaultdict(set)
    for i, c in enumerate(codes):
        got[roots.get(as_long(c), as_long(c))].add(i)
    groups = defaultdict(set)
    for i, k in enumerate(want):
        groups[k].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    bases = [words(rng.randint(1, 200)) for _ in range(25)]
    rows = [(i, rng.choice(bases) + rng.choice(["", "", " x", " tail here", " A1 B2"])) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, bases[0]), (903, bases[0]), (None, bases[1]), (904, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, 5, "r") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = S.components(df).collect()
    codes = [plain_fingerprint(t) for _, t in rows]
    least = defaultdict(lambda: 10**9)
    comp = plain_components(codes)
    for (i, _), k in zip(rows, comp, strict=True):
        least[k] = min(least[k], 10**9 if i is None else i)
    want = sorted(((i, as_long(c), least[k]) for (i, _), c, k in zip(rows, codes, comp, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=repr) == want
    kept = S.one_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({least[k] for k in comp}, key=repr)


def test_one_each_by_component(spark):
    """Two texts of one id are judged apart; rows without an id take part, after all others."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "a completely different text about something else entirely here"
    rows = [(1, a), (1, b), (2, a), (None, b), (None, "only here and nowhere else in this table of rows"), (None, "only here and nowhere else in this table of rows"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "k", 1, "x") for i, t in rows], "doc_id long, text string, _keep string, fp int, key string")
    kept = S.one_each(df)
    assert kept.columns == df.columns
    want = [(1, a), (1, b), (7, None), (None, "only here and nowhere else in this table of rows")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert S.one_each(df.limit(0)).collect() == []
    assert S.components(df.limit(0)).collect() == []
