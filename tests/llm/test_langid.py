"""PPM code lengths against a dictionary version; held-out accuracy; odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolebook.llm import langid as L
from rolebook.llm import texts as X

TRAIN = [("a", "the cat sat on the mat the end"), ("a", "on the mat"), ("b", "le chat est là, le chat dort"), ("b", "é"), ("a", "")]


def plain_counts(rows, names):
    out = Counter()
    for lang, text in rows:
        codes = [256] * L.ORDER + list(text.encode())
        for i in range(L.ORDER, len(codes)):
            gram = sum(codes[i - k] << (9 * k) for k in range(L.ORDER + 1))
            out[names.index(lang), gram] += 1
    return out


def plain_bits(rows, names, text, lang):
    """Code length by walking dictionaries, byte by byte."""
    seen = {b for _, t in rows for b in t.encode()}
    counts, totals = defaultdict(Counter), Counter()
    for of, t in rows:
        codes = [256] * L.ORDER + list(t.encode())
        for i in range(L.ORDER, len(codes)):
            for k in range(L.ORDER + 1):
                context = tuple(codes[i - k : i])
                counts[of, context][codes[i]] += 1
                totals[context] += 1

    def chance(context, b):
        """Probability of each byte class after the context."""
        if context and totals[context] < L.LEAST:
            return chance(context[1:], b)
        own = counts[lang, context]
        below = (lambda x: chance(context[1:], x)) if context else (lambda x: 1 / 256)
        if not own:
            return below(b)
        n, d = sum(own.values()), len(own)
        if own[b]:
            return own[b] / (n + d)
        left = sum(below(x) for x in {*seen, -1} if not own[x])
        return d / (n + d) * below(b) / max(left, 1e-9)

    codes = [256] * L.ORDER + list(text.encode())
    total = 0.0
    for i in range(L.ORDER, len(codes)):
        context = [c if c in seen else -1 for c in codes[i - L.ORDER : i]]
        # the start of a text and unseen bytes are one symbol
        context = tuple(256 if c == -1 else c for c in context)
        total -= math.log2(chance(context, codes[i] if codes[i] in seen else -1))
    return total


def test_code_lengths():
    names = ["a", "b"]
    c = plain_counts(TRAIN, names)
    model = L.build(names, *(np.array(x, np.int64) for x in zip(*((k[0], k[1], n) for k, n in c.items()), strict=True)))
    texts = ["the mat", "", "x", "là le chat", "the zebra chat \x00\xff", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = model.code_lengths(data, at)
    for i, t in enumerate(texts):
        for j, lang in enumerate(names):
            assert got[i, j] == pytest.approx(plain_bits(TRAIN, names, t, lang), rel=1e-4, abs=1e-4), (t, lang)


def test_rows(spark):
    rows = [(i, t, lang, 7) for i, (lang, t) in enumerate(TRAIN * 3)]
    rows += [(100, None, "a", 7), (101, "", None, 7), (102, "12 34!", "b", 7), (103, "the cat", None, 7), (103, "the cat", None, 7), (None, "le chat", None, 7), (105, "the mat " * 9000, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = L.identify(df, F.lit(True))
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.lang_pred, r.score))
        assert 0 <= r.score <= 1
    assert [x[0] for x in got[100] + got[101] + got[102]] == ["und"] * 3
    assert [x[0] for x in got[103]] == ["a", "a"] and got[None][0][0] == "b" and got[105][0][0] == "a"
    assert len(got) == 15 + 6
    empty = L.identify(df.limit(0), F.lit(True))
    assert empty.collect() == []
    assert {r.lang_pred for r in L.identify(df, F.lit(False)).collect()} == {"und"}


def test_counts(spark):
    names = ["a", "b"]
    df = spark.createDataFrame([(names.index(x), t) for x, t in TRAIN], "lang long, text string")
    got = {(r.lang, r.gram): r.n for r in L.fit_counts(df, names).collect()}
    assert got == dict(plain_counts(TRAIN, names))


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.identify(docs, X.crc_mod(F.col("doc_id"), 3) != 1)
    held = out.join(docs, "doc_id").where(X.crc_mod(F.col("doc_id"), 3) == 1)
    right, n = held.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * n


def test_many_languages_and_long_texts(spark):
    rng = np.random.default_rng(7)
    signs = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = [["".join(rng.choice(signs, 5)) for _ in range(6)] for _ in range(70)]
    rows = [(k * 100 + i, " ".join(rng.choice(words[k], 12)), f"l{k:02}") for k in range(70) for i in range(6 if k < 69 else 3)]
    # a language with long texts only
    rows += [(9000 + i, "zyxwv utsrq ponml " * 5000, "long") for i in range(2)]
    held = [(20_000 + k, " ".join(rng.choice(words[k], 8)), f"l{k:02}") for k in range(70)] + [(30_000, "utsrq zyxwv ponml", "long")]
    df = spark.createDataFrame(rows + held, "doc_id long, text string, lang string")
    model = L.train(df, F.col("doc_id") < 20_000)
    assert len(model.languages) == 71 and len(list(model.blocks())) == 9
    got = {r.doc_id: r for r in L.predict(df, model).collect()}
    assert [got[i].lang_pred for i, _, _ in held] == [x for _, _, x in held]
    # one block gives the same order of code lengths for the languages of a block
    whole = L.build(model.languages, model.lang, model.gram, model.n)
    assert [m.bits.shape[1] for m in model.blocks()] == [whole.bits.shape[1]] * 9


def test_clashing_names(spark):
    """Columns named like the operator's own do not matter."""
    rows = [(i, "the of and to that " * 5 if i % 2 else "der und die das nicht " * 5, "en" if i % 2 else "de", "x", 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, n int, place int")
    got = {r.doc_id: r.lang_pred for r in L.identify(df, F.lit(True)).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(40)}
    model = L.train(df, F.lit(True))
    assert L.label(df, model).columns[:6] == df.columns
