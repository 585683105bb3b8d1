"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by measures of it. On a bounded sample each rule's cost (time) and
selectivity (share rejected) are estimated; rules then run in the order of rejections per
cost, and a text's first rejection ends its cascade. The order changes the work, never
the verdict.

Null texts read as empty: no words, which fails the base rules. Words are runs of
characters other than space and the ASCII controls tab to carriage return. Repeated rows
give repeated rows.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

#: Different rows on which costs and selectivities are estimated, chosen by a hash of id and
#: text; how often each is judged in a run, and runs of which the fastest counts.
SAMPLE_ROWS, REPEAT, RUNS = 2000, 8, 2

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _words() -> Column:
    return F.regexp_extract_all("_text", F.lit(WORD), 0)


def _without(pattern: str) -> Column:
    """Characters left when the pattern's matches are taken out."""
    return F.length(F.regexp_replace("_text", pattern, "")).cast("long")


def _lines() -> Column:
    return F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))


def _windows() -> Column:
    """Hash of each three words in a row."""
    words = F.col("_words")
    three = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(three, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _repeat_words() -> tuple[Column, Column]:
    """(windows in order, words inside repeated ones, from ``_placed``). Words inside windows found twice or more: the windows are put in order with
    their places; equal neighbours are repeats. Only texts that have one pay for it."""
    w = F.col("_windows")
    placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        marked = F.transform(s, lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"]))
        return F.filter(marked, lambda i: i.isNotNull())

    covered = F.flatten(F.transform(places(F.col("_placed")), lambda i: F.array(i, i + 1, i + 2)))
    return placed, F.size(F.array_distinct(covered)).cast("long")


#: Measure -> expression over ``_text`` and ``_words``.
MEASURES = {
    "n_words": lambda: F.size("_words").cast("long"),
    "word_chars": lambda: _without(BLANK),
    "n_symbols": lambda: _without(r"[^#*$%&|<>]+"),
    "n_lines": lambda: F.size(_lines()).cast("long"),
    "n_dup_lines": lambda: (F.size(_lines()) - F.size(F.array_distinct(_lines()))).cast("long"),
    "n_upper": lambda: _without(r"[^A-Z]+"),
    "n_letters": lambda: _without(r"\P{L}+"),
}


@dataclass(frozen=True)
class Rule:
    """``reject`` takes a function from a measure's name to its Column."""

    name: str
    reject: object


RULES = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("dup_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    Rule("word_length", lambda m: (2 * m("word_chars") < 5 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("upper", lambda m: 100 * m("n_upper") > 40 * m("word_chars")),
    Rule("letters", lambda m: 100 * m("n_letters") < 60 * m("word_chars")),
)
BASE = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)


def prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return df.withColumn("_words", _words())


def measured(df: DataFrame, names: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the named measures, n_repeat_words, and the text for further rules."""
    placed, repeats = _repeat_words()
    df = prepared(df, id_col, text_col).withColumn("_windows", _windows())
    df = df.select("doc_id", "_text", "_words", "_windows", *(MEASURES[n]().alias(n) for n in names))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    return df.withColumn("n_repeat_words", F.when(F.col("_placed").isNotNull(), repeats).otherwise(F.lit(0).cast("long"))).drop("_windows", "_placed")


def _measure(have: list[str]):
    """A measure's column where the frame has it, else its expression, which is then
    only evaluated by the rules that come to it."""
    return lambda name: F.col(name) if name in have else MEASURES[name]()


def ordered(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), the most rejections per second first; ties and
    rules that reject nothing by cost, then name. A rule's seconds are those of judging the sample
    several times over less those of a rule that looks at nothing: what a job takes to start, to
    compile and to read is in both."""
    pairs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = prepared(X.sample(pairs, SAMPLE_ROWS), "doc_id", "text").persist()
    rows = sample.count()
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

    def run(reject: Column) -> tuple[float, int]:
        # the copy's number is in the condition, so that each copy is judged
        judged = F.sum((reject & (F.col("_again") > 0)).cast("int")).alias("n")
        best = math.inf
        for _ in range(RUNS):
            began = time.perf_counter()
            hits = many.agg(judged).first().n or 0
            best = min(best, time.perf_counter() - began)
        return best, hits

    empty, _ = run(F.col("_again") < 0)
    out = []
    for rule in rules:
        took, hits = run(rule.reject(_measure([])))
        out.append((rule, max(took - empty, 1e-4), hits / REPEAT / max(rows, 1)))
    sample.unpersist()
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def verdict(rules: list[Rule], have: list[str]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not
    evaluated after it."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(_measure(have)), F.lit(rule.name)).otherwise(out)
    return out


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the named measures, n_repeat_words, base_failed, failed_rule, kept):
    base rules first, then the others in their estimated order."""
    names = tuple(dict.fromkeys(("n_words", *measures)))
    found = measured(df, names, id_col, text_col)
    have = [*names, "n_repeat_words"]
    order = [r for r, _, _ in ordered(df, rules, id_col, text_col)]
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | rule.reject(_measure(have))
    found = found.withColumn("base_failed", failed)
    first = F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(order, have))
    return found.select("doc_id", *have, "base_failed", first.alias("failed_rule"), first.isNull().alias("kept"))
