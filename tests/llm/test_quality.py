"""Quality measures and verdicts against plain Python; the order of rules; odd rows."""

import re
from collections import Counter

from rolebook.llm import quality as Q

BLANK = "\x20\x09-\x0d"


def plain(text):
    t = text or ""
    w = re.findall(f"[^{BLANK}]+", t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    places = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(f"[^{BLANK}]", x)]
    n, chars, symbols, dups = len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(places) > 50 * n
    upper, letters = len(re.findall("[A-Z]", t)), sum(c.isalpha() for c in t)
    bad = 10 * symbols > n or 100 * dups > 40 * len(lines) or 2 * chars < 5 * n or chars > 12 * n or 100 * upper > 40 * chars or 100 * letters < 60 * chars
    return (n, chars, symbols, dups, len(places), base, not (base or bad))


GOOD = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
TEXTS = [
    GOOD, "", None, "one", "a b c a b c", "é\x0bü\x0c\r\n \n x", GOOD + " #*" * 20, GOOD.upper(), "\n".join(["same line here"] * 30 + [GOOD]),
    "1 2 " * 60, " ".join(str(i) for i in range(100)), GOOD + "\n" + GOOD, GOOD + " " + " ".join(GOOD.split()[:40]), "x" * 300_000, "ab " * 30_000,
    " ".join(f"w{i}é\xa0漢字" for i in range(60)), "a\nb\n\n \na\n" * 3 + GOOD, "�|<>" * 20,
]


def test_like_plain(spark):
    rows = [(i, t, 5, [1]) for i, t in enumerate(TEXTS)] + [(None, GOOD, 5, [1]), (0, GOOD, 5, [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, _words array<int>")
    names = ("word_chars", "n_symbols", "n_dup_lines")
    got = Q.cascade(df, measures=names).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(GOOD if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want, r.doc_id
    assert Q.cascade(df.limit(0)).collect() == []


def test_order(spark):
    df = spark.createDataFrame([(i, GOOD + " #" * (99 if i % 2 else 0)) for i in range(60)], "doc_id long, text string")
    never = Q.Rule("never", lambda m: m("n_words") < 0)
    order = [r.name for r, _, _ in Q.ordered(df, (never, *Q.RULES))]
    assert order[0] == "symbols" and set(order) == {"never", *(r.name for r in Q.RULES)}
    for rules in (Q.RULES, Q.RULES[::-1]):
        kept = {r.doc_id: r.kept for r in Q.cascade(df, rules).collect()}
        assert kept == {i: i % 2 == 0 for i in range(60)}


def test_no_python(spark):
    df = spark.createDataFrame([(1, GOOD)], "doc_id long, text string")
    plan = Q.cascade(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
