"""The best matches of each name against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from rolebook.operators import companies as C


def every_pair(queries, companies, k, floor=30):
    q, c = C.name_forms(queries, "query", "query"), C.name_forms(companies, "company", "company")
    pairs = q.crossJoin(c).select("query", "company", C._pair_score().alias("score")).filter(F.col("score") >= floor)
    out = {}
    for r in pairs.collect():
        out.setdefault(r.query, []).append((-r.score, r.company))
    return {(x, c, -s) for x, rows in out.items() for s, c in sorted(rows)[:k]}


def names(rng, n, words):
    made = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(n)}
    return [x + rng.choice(["", "", " Ltd", " GmbH"]) for x in sorted(made)]


@pytest.mark.parametrize(("seed", "k", "floor"), [(1, 3, 30), (2, 1, 30), (3, 8, 55), (4, 200, 30)])
def test_best_names_like_every_pair(spark, monkeypatch, seed, k, floor):
    """Short keys, keys inside others, long keys, and one word in nearly every name."""
    monkeypatch.setattr(C, "SPREAD", 5)
    rng = random.Random(seed)
    words = ["red", "hat", "Sap", "ab", "x1", "global", "systems", "deutschland", "ra", "tech", "solutionsinternational", "a", "ü", *["group"] * 6]
    c = spark.createDataFrame([(x,) for x in names(rng, 130, words)] + [("",), ("!!",), (None,)], "company string")
    q = spark.createDataFrame([(x,) for x in names(rng, 60, words)] + [("sap",), ("group",), ("zzz",), (None,), ("solutionsinternationalgroup x",)], "query string")
    got = {(r.query, r.company, r.score) for r in C.best_names(q, c, k, floor).collect()}
    assert got == every_pair(q, c, k, floor)


def test_a_word_in_every_name_makes_few_pairs(spark):
    """Rows that meet grow with the names, not with their square."""
    c = spark.range(3000).select(F.concat(F.lit("alpha n"), "id").alias("company"))
    q = c.select(F.col("company").alias("query"))
    out = C.best_names(q, c, 2)
    assert out.count() == 6000
    assert out.filter("query = company AND score = 100").count() == 3000


def test_no_names(spark):
    none = spark.createDataFrame([], "company string")
    some = spark.createDataFrame([("a b",)], "company string")
    for q, c in ((none, some), (some, none)):
        assert C.best_names(q.withColumnRenamed("company", "query"), c, 3).collect() == []
