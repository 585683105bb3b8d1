"""Query tables, as-of lookups, deep pages and table comparison against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rolebook.operators import filters, joins, limits, lookup, shortlists


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_query_table_like_one_by_one(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shortlists, "BROADCAST_SKILLS", broadcast)
    rng = random.Random(1)
    words = ["Python", "go", "c++", "of the", "Ärzte", "日本", "remote", "x"]
    posts = [(f"p{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice([None, "Pune remote", ""]), rng.sample(["Go", "ml"], rng.randint(0, 2)) or None) for i in range(60)]
    df = spark.createDataFrame(posts, "id string, title string, location string, tags array<string>")
    asked = [(i, " ".join(rng.choice([*words, "pyth", "++", "absent", "e"]) for _ in range(rng.randint(1, 3))), rng.choice(["words", "phrase"])) for i in range(40)]
    asked += [(100, "", "words"), (101, None, "phrase"), (102, " \t", "words"), (103, "go  GO\tx", "words"), (103, "go  GO\tx", "words")]
    q = spark.createDataFrame(asked, "query_id int, query string, kind string")
    got = {(r.query_id, r.id) for r in lookup.match_query_table(df, q, ["title", "location"], "tags").collect()}
    want = set()
    one = df.withColumn("all", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("location", F.lit("")), F.coalesce(F.array_join("tags", " "), F.lit(""))))
    for i, text, kind in asked:
        if text and text.strip():
            rows = filters.match_phrase(one, text, ["all"]) if kind == "phrase" else filters.match_all_words(one, text, ["all"])
            want |= {(i, r.id) for r in rows.select("id").collect()}
    assert got == want


def test_cache_asof_like_plain(spark):
    """Bounds of the window, days before 1970, one company with most rows, nulls."""
    rng = random.Random(2)
    day = lambda: dt.date(1969, 12, 1) + dt.timedelta(days=rng.randrange(120))
    cache = [(rng.choice(["hot", "hot", "a", "b"]), day(), rng.choice("xyz")) for _ in range(150)] + [(None, day(), "n"), ("a", None, "n"), ("b", dt.date(1970, 1, 1), None)]
    asked = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "none", None]), day() if i % 20 else None) for i in range(200)]
    got = joins.cache_lookup_asof(
        spark.createDataFrame(asked, "n int, company string, day date"), spark.createDataFrame(cache, "company string, fetched_date date, value string"), ttl_days=30
    )
    rows = {r.n: (r.fetched_date, r.value, r.hit) for r in got.collect()}
    assert len(rows) == 200 == got.count()
    for n, company, on in asked:
        fits = [(d, v or "") for c, d, v in cache if c == company and c and d and on and 0 <= (on - d).days <= 30]
        best = max(fits, default=None)
        assert rows[n] == ((best[0], best[1] or None, True) if best else (None, None, False)), n


def test_pages(spark):
    """Every page equals offset and limit; ties keep one order; pages read few ranges."""
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    pages = limits.Pages(df, ["a", "id"], 13)
    want = [(r.a, r.id) for r in df.orderBy("a", "id").collect()]
    assert pages.total == 1000
    for number, size in ((1, 10), (37, 10), (100, 10), (101, 10), (3, 333), (4, 333), (0, 5)):
        lo = (max(1, number) - 1) * size
        got = pages.page(number, size).collect()
        assert [(r.a, r.id) for r in got] == want[lo : lo + size] and [r.row_no for r in got] == list(range(lo + 1, lo + 1 + len(got)))
    ties = limits.Pages(df, ["a"], 5)
    seen = [r.id for n in range(1, 12) for r in ties.page(n, 100).collect()]
    assert sorted(seen) == list(range(1000))
    assert limits.Pages(df.limit(0), ["a"], 3).page(1, 10).collect() == []


def test_reconcile_tables(spark):
    schema = "k int, g string, v double, w string"
    rows = [(i, "x", i / 2, None if i % 5 else "w") for i in range(400)]
    a = spark.createDataFrame([*rows, (None, "x", 1.0, "n"), (7, None, 1.0, None)], schema)
    b_rows = [(k, g, v + (k == 11), "new" if k == 12 else w) for k, g, v, w in rows if k not in (5, 6)] + [(900, "x", 1.0, "w"), (None, "x", 1.0, "n"), (7, None, 1.0, "")]
    b = spark.createDataFrame([*b_rows, (20, "x", 10.0, None)], schema)
    got = {(r.what, r.key, r.column, r.expected, r.actual) for r in joins.reconcile_tables(a, b, ["k", "g"]).collect()}
    key = lambda k, g="x": f'{{"k":{k},"g":"{g}"}}'
    assert got == {
        ("missing", key(5), None, None, None), ("missing", key(6), None, None, None), ("extra", key(900), None, None, None),
        ("differs", key(11), "v", "5.5", "6.5"), ("differs", key(12), "w", None, "new"), ("differs", '{"k":7}', "w", None, ""), ("repeated", key(20), None, "1", "2"),
    }
    assert joins.reconcile_tables(a, a, ["k", "g"]).collect() == []
    other = joins.reconcile_tables(a, a.withColumn("v", F.col("v").cast("string")).drop("w").withColumn("z", F.lit(1)), ["k", "g"])
    assert {(r.what, r.column) for r in other.collect()} == {("other type", "v"), ("missing column", "w"), ("extra column", "z")}
    with pytest.raises(ValueError, match="key columns"):
        joins.reconcile_tables(a, b.drop("k"), ["k", "g"])
