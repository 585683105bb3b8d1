import random

from pyspark.sql import functions as F

from rolebook.operators import dedupe as D
from rolebook.operators import limits as L

SCHEMA = "id string, title string, company string, location string, url string, pool_no int, pos long"


def rows(*specs):
    return [(i, t, "Acme", loc, url, pool, pos) for i, t, loc, url, pool, pos in specs]


def test_interleave(spark):
    df = spark.createDataFrame(rows(("a1", "t", "x", "", 0, 0), ("a2", "t", "x", "", 0, 5), ("a3", "t", "x", "", 0, 9), ("b1", "t", "x", "", 1, 2)), SCHEMA)
    got = D.interleave(df).orderBy(*D.round_robin_order()).collect()
    assert [r.id for r in got] == ["a1", "b1", "a2", "a3"]


def test_pool_rank_across_spans(spark):
    """Positions are the same whether a pool fits one span or many."""
    rng = random.Random(7)
    data = [(f"{p}-{x}", "t", "c", "l", "u", p, x) for p in range(3) for x in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for p in range(3):
        for i, x in enumerate(sorted(r[6] for r in data if r[5] == p), 1):
            want[f"{p}-{x}"] = i
    for span in (7, 1000, 1 << 18):
        assert {r.id: r.pool_rank for r in D.pool_rank(df, span=span).collect()} == want


def test_merge_first_seen_wins(spark):
    df = spark.createDataFrame(
        rows(
            ("a1", "t", "x", "https://e.com/1", 0, 0), ("a2", "t", "x", "https://e.com/2?utm_source=z", 0, 1),
            ("b1", "t", "x", "https://e.com/2", 1, 0), ("b2", "t", "x", "https://e.com/1#f", 1, 1),
        ),
        SCHEMA,
    )
    ranked = D.interleave(df)
    merged = D.merge_pools(ranked)
    assert {r.id: r.copies for r in merged.collect()} == {"a1": 2, "b1": 2}
    assert D.duplicate_count(merged).first().duplicates == 2
    again = D.merge_pools(merged.drop("copies", "dedupe_key"))
    assert {r.id for r in again.collect()} == {"a1", "b1"}
    assert again.agg(F.max("copies")).first()[0] == 1


def test_interleave_keeps_every_row(spark):
    df = spark.range(500).select(
        F.col("id").cast("string"), F.lit("t").alias("title"), F.lit("c").alias("company"), F.lit("l").alias("location"),
        F.concat(F.lit("https://e.com/"), "id").alias("url"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("pool_no"), F.col("id").alias("pos"),
    )
    assert D.interleave(df).select("id").distinct().count() == 500


def collapse(spark, *specs):
    return D.collapse_spread(spark.createDataFrame(rows(*specs), SCHEMA), ["pos", "id"]).orderBy("pos").collect()


def test_collapse_spread(spark):
    got = collapse(spark, ("1", "SDE", "Bengaluru", "https://x.com/jobs/9f8e7d6c5b4a", 0, 0), ("2", "SDE", "Pune", "https://x.com/jobs/9f8e7d6c5b4a?ref=x", 0, 1))
    assert [(r.id, r.location, r.group_size) for r in got] == [("1", "Bengaluru (+1 cities: Pune)", 2)]


def test_collapse_same_city_has_no_note(spark):
    got = collapse(spark, ("1", "SDE", "Pune", "https://x.com/a", 0, 0), ("2", "sde", "Pune", "https://x.com/b", 0, 1))
    assert [(r.id, r.location) for r in got] == [("1", "Pune")]


def test_collapse_ignores_date_segments(spark):
    got = collapse(spark, ("1", "A", "Pune", "https://x.com/archive/2026-10-05/post-a", 0, 0), ("2", "B", "Pune", "https://x.com/archive/2026-10-05/post-b", 0, 1))
    assert len(got) == 2


def test_collapse_city_order_and_null(spark):
    specs = [(str(i), "SDE", loc, "https://x.com/abcdef0123", 0, i) for i, loc in enumerate([None, "Pune", "Goa", "Pune", "Agra"])]
    got = collapse(spark, *specs)
    assert [(r.location, r.group_size) for r in got] == [(" (+3 cities: Pune, Goa, Agra)", 5)]


def test_hot_company_stays_whole(spark):
    """A third of all rows in one company collapse without losing a city."""
    df = spark.range(3000).select(
        F.col("id").cast("string"), F.lit("SDE").alias("title"),
        F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("c"), "id")).alias("company"),
        F.concat(F.lit("city"), F.col("id") % 21).alias("location"), F.lit("").alias("url"), F.lit(0).alias("pool_no"), F.col("id").alias("pos"),
    )
    out = D.collapse_spread(df, ["pos", "id"])
    assert out.agg(F.sum("group_size")).first()[0] == 3000
    hot = out.filter(F.col("company") == "Hot").first()
    assert hot.group_size == 1000 and "+6 cities" in hot.location


def test_limits(spark):
    df = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("string").alias("portal"), F.col("id").alias("pool_no"))
    top, meta = L.limit_with_meta(df, ["pos"], 10)
    assert top.count() == 10 and tuple(meta.first()) == (100, True)
    every, meta = L.limit_with_meta(df, ["pos"], 0)
    assert every.count() == 100 and not meta.first().truncated
    second, meta = L.page(df, ["pos"], 2, 30)
    assert [r.pos for r in second.collect()] == list(range(30, 60)) and meta.first().truncated
    last, meta = L.page(df, ["pos"], 4, 30)
    assert last.count() == 10 and not meta.first().truncated
    assert [L.source_cap(x) for x in (0, 5, 20, 500)] == [50, 30, 60, 200]
    assert L.cap_per_source(df, 5).groupBy("portal").count().agg(F.max("count")).first()[0] == 30


def test_row_budget_takes_whole_sources(spark):
    df = spark.createDataFrame([(p, i) for p, n in ((0, 4), (1, 4), (2, 4)) for i in range(n)], "pool_no int, pos int")
    kept, notes = L.row_budget(df, 5)
    assert kept.count() == 8
    assert {r.pool_no: r.note for r in notes.collect()} == {0: None, 1: None, 2: "row budget 5 reached"}
    assert L.row_budget(df, 0)[0].count() == 12


def test_diff_sets(spark):
    a = spark.createDataFrame([("x", "ctc"), ("x", "bond")], "l string, g string")
    b = spark.createDataFrame([("x", "Compensation"), ("x", "stale")], "l string, g string")
    assert {(r.g, r.side) for r in D.diff_sets(a, b, ["l"], "g").collect()} == {("bond", "missing"), ("stale", "extra")}


def test_rows_without_pool_or_position_stay(spark):
    """They come last in their pool, and a null pool is one of its own."""
    specs = [("a", "t", "x", "u1", 0, 3), ("b", "t", "x", "u2", 0, None), ("c", "t", "x", "u3", None, 1), ("d", "t", "x", "u4", None, None), ("e", "t", "x", "u5", 0, 0)]
    df = spark.createDataFrame(rows(*specs) + rows(*[(f"z{i}", "t", "x", "u", 7, None) for i in range(50)]), SCHEMA)
    got = D.interleave(df).collect()
    assert {r.id: (r.pool_no, r.pool_rank) for r in got if r.pool_no != 7} == {"e": (0, 1), "a": (0, 2), "b": (0, 3), "c": (None, 1), "d": (None, 2)}
    assert sorted(r.pool_rank for r in got if r.pool_no == 7) == list(range(1, 51))


def test_merge_null_pool_beside_the_last_number(spark):
    specs = [("a", "t", "x", "https://e.com/1", None, 0), ("b", "t", "x", "https://e.com/2", 65535, 0), ("c", "t", "x", "https://e.com/1", 3, 0)]
    merged = D.merge_pools(D.interleave(spark.createDataFrame(rows(*specs), SCHEMA)))
    assert {r.id: r.copies for r in merged.collect()} == {"b": 1, "c": 2}


def test_collapse_repeated_order_columns(spark):
    got = collapse(spark, ("1", "SDE", "Pune", "https://x.com/a1b2c3d4e5", 0, 0), ("1", "SDE", "Goa", "https://x.com/a1b2c3d4e5", 0, 0), ("1", "SDE", "Goa", "https://x.com/a1b2c3d4e5", 0, 0))
    assert len(got) == 1 and got[0].group_size == 3 and "+1 cities" in got[0].location


def test_keys_first_change_nothing_and_spare_the_texts(spark, capsys):
    """Keys added before rows are dealt out: the same rows, and no shuffle carries the titles."""
    rng = random.Random(5)
    url = lambda: rng.choice([None, "", f"https://e.com/{rng.randrange(9)}", f"https://e.com/jobs/1000000{rng.randrange(4)}"])
    data = [
        (f"r{i}", rng.choice([None, "Dev", "dev", "long title " * 20, "Long title " * 20 + "x"]), rng.choice(["Acme", "acme", None]), rng.choice([None, "Pune", "Remote", ""]), url(), rng.choice([0, 1, None]), i if i % 9 else None)
        for i in range(200)
    ]
    df = spark.createDataFrame(data, SCHEMA)

    def merged(d):
        return D.merge_pools(D.interleave(d))

    def whole(d):
        return D.collapse_spread(merged(d).drop("copies", "dedupe_key"))

    early, late = merged(D.with_keys(df)), merged(df)
    assert sorted(early.select(late.columns).collect(), key=str) == sorted(late.collect(), key=str)
    out = whole(D.with_keys(df))
    assert set(out.columns) == {*df.columns, "pool_rank", "group_size"}
    assert sorted(out.select(sorted(out.columns)).collect(), key=str) == sorted(whole(df).select(sorted(out.columns)).collect(), key=str)
    wide = df.withColumn("title", F.repeat(F.coalesce("title", F.lit("none")), 2))
    whole(D.with_keys(wide)).select("id", "company", "location").explain("formatted")
    plan = capsys.readouterr().out
    shuffles = [part.splitlines()[1] for part in plan.split("\n\n") if " Exchange" in part.splitlines()[0] and part.startswith("(")]
    assert len(shuffles) >= 5 and not any("title" in x for x in shuffles)
