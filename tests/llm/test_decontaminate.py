"""Winnowed hits against all windows compared one by one; odd rows and items."""

import random
import re

import pytest

from rolebook.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, items):
    w, hit, named = low(text), set(), set()
    for item, t in items:
        iw = low(t)
        m = min(13, len(iw))
        own = {tuple(iw[s : s + m]) for s in range(len(iw) - m + 1)} if m else set()
        for s in range(len(w) - m + 1):
            if tuple(w[s : s + m]) in own:
                hit |= set(range(s, s + m))
                named.add(str(item))
    return len(w), len(hit), sorted(named)


def corpus(seed, vocabulary, short):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(rng.randint(13, 40)))) for i in range(8)]
    if short:
        items += [(20 + n, ", ".join(words(n))) for n in (1, 2, 5, 12)]
    docs = []
    for i in range(60):
        body = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            t = low(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(t) - 5))
            part = t[a : a + rng.randint(5, 30)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "zz"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, rng.choice([" ", "\n", ", "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in body)))
    return docs, items


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, w string, item int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.report(d, b).collect()), key=repr)
    want = sorted(((i is None, i, *plain(t, items)) for i, t in docs), key=repr)
    assert got == want
    bad = [(i, n, h) for _, i, n, h, _ in want if h > 0 and 20 * h >= n]
    kept = D.keep_clean(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - len(bad)


@pytest.mark.parametrize("vocabulary", [[f"w{i}é" for i in range(400)], ["a", "b", "c"], ["x"]], ids=["many", "three", "one"])
@pytest.mark.parametrize("short", [False, True])
def test_like_plain(spark, vocabulary, short):
    check(spark, *corpus(7, vocabulary, short))


def test_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    check(spark, *corpus(8, [f"w{i}" for i in range(60)], True))


def test_odd_rows(spark):
    base = " ".join(f"p{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, base), (3, base), (3, "other words"), (None, base), (4, "... !!"), (5, "q " * 60_000 + base), (6, base + " " + base)]
    items = [(1, base), (1, "other"), (2, None), (3, ""), (10, base), (9, base)]
    check(spark, docs, items)
    check(spark, docs, [])
    check(spark, [], items)


def test_no_python(spark):
    docs, items = corpus(9, ["a", "b"], True)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = D.report(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
