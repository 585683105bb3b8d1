"""Shortlists of a candidate table against ranking every pair."""

import random

import pytest
from pyspark.sql import functions as F

from rolebook.operators import gates, joins, scoring, shortlists

AS_OF = "2024-04-30"


def test_like_every_pair(spark):
    rng = random.Random(2)
    words = ["python", "data", "go", "rust", "lead", "a", "ml"]
    posts = [
        (f"p{i}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice(["Pune", "Remote", "Bangalore", "", None]), f"2024-0{rng.randint(2, 4)}-{rng.randint(10, 28)}" if i % 5 else None)
        for i in range(120)
    ]
    cands = [
        (f"c{i}", rng.choice(["student", "experienced"]), rng.sample(words, rng.randint(0, 5)), rng.sample(["Pune", "remote", "Bengaluru"], rng.randint(0, 2)))
        for i in range(30)
    ]
    p = spark.createDataFrame(posts, "id string, pos long, title string, location string, posted_date string").withColumn("posted_date", F.to_date("posted_date"))
    c = spark.createDataFrame(cands, "candidate_id string, stage string, skills array<string>, locations array<string>")
    got = {}
    for r in joins.shortlist_per_candidate(p, c, AS_OF, 4).collect():
        got.setdefault(r.candidate_id, set()).add((r.id, r.score))
    few = [scoring.Candidate(i, s, tuple(k), tuple(w)) for i, s, k, w in cands]
    rows = scoring.rank_all(joins.pair(p.withColumn("description", F.lit("")), few), F.col("cand"), AS_OF)
    want = {}
    for r in rows.filter("pass").select("cand.candidate_id", "id", "pos", "score").collect():
        want.setdefault(r.candidate_id, []).append((-r.score, r.pos, r.id))
    assert got == {k: {(i, -s) for s, _, i in sorted(v)[:4]} for k, v in want.items()}


def test_null_skills_and_places(spark):
    """No skills score half of their part; no places accept any."""
    p = spark.createDataFrame([("x", 1, "python lead", "Pune", None), ("y", 2, "other", None, None)], "id string, pos long, title string, location string, posted_date date")
    c = spark.createDataFrame(
        [("n", "student", None, ["Pune"]), ("w", "student", ["python"], None), ("e", "student", [None], [None]), ("m", "student", [], [])],
        "candidate_id string, stage string, skills array<string>, locations array<string>",
    )
    got = {}
    for r in joins.shortlist_per_candidate(p, c, AS_OF, 5).collect():
        got.setdefault(r.candidate_id, {})[r.id] = r.score
    assert got["n"].keys() == {"x"} and got["w"].keys() == {"x", "y"}
    assert got["e"] == got["m"] and got["m"].keys() == {"x", "y"} and got["n"]["x"] == got["m"]["x"]
    assert got["w"]["x"] > got["w"]["y"] and None not in [s for v in got.values() for s in v.values()]


def text_rows(rng, n):
    words = ["python", "data", "go", "rust", "lead", "c++", "ml", "of the", "Ärzte", "日本"]
    tails = ["", ". 2025 batch only.", ". Monthly stipend of INR 9000.", ". Rs 30000 per month.", ". Fluent German.", ". 2026 batch welcome."]
    return [
        (
            f"p{i}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) if i % 9 else None, rng.choice(["Pune", "Remote", "Bangalore", "", None]),
            f"2024-0{rng.randint(3, 4)}-{rng.randint(10, 28)}" if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) + rng.choice(tails) if i % 13 else None,
        )
        for i in range(n)
    ], words


@pytest.mark.parametrize(("seed", "top", "broadcast"), [(1, 4, 200_000), (2, 1, 0), (3, 60, 200_000)])
def test_texts_like_every_pair(spark, monkeypatch, seed, top, broadcast):
    """Index, floors and levels lose nothing: as gating and scoring every pair with its text."""
    monkeypatch.setattr(shortlists, "BROADCAST_SKILLS", broadcast)
    rng = random.Random(seed)
    posts, words = text_rows(rng, 150)
    known = [*words, "pyth", "a", "e of", "++", "absent", "GO", " "]
    cands = [
        (f"c{i}", rng.choice(["student", "fresher", "experienced"]), [rng.choice(known) for _ in range(rng.randint(0, 6))], rng.sample(["Pune", "remote", "Bengaluru"], rng.randint(0, 2)), rng.choice([None, 2025, 2026, 0]), rng.choice([None, 20000.0]))
        for i in range(40)
    ]
    p = spark.createDataFrame(posts, "id string, pos long, title string, location string, posted_date string, description string").withColumn("posted_date", F.to_date("posted_date"))
    c = spark.createDataFrame(cands, "candidate_id string, stage string, skills array<string>, locations array<string>, grad_year int, stipend_floor double")
    got = {}
    for r in shortlists.shortlist_per_candidate_text(p, c, AS_OF, top).collect():
        got.setdefault(r.candidate_id, set()).add((r.id, r.score))
    few = [scoring.Candidate(i, s, tuple(k), tuple(w), y, f) for i, s, k, w, y, f in cands]
    texts = p.withColumn("title", F.coalesce("title", F.lit("")))
    rows = scoring.rank_all(joins.pair(gates.with_text_facts(texts), few), F.col("cand"), AS_OF, with_text=True)
    want = {}
    for r in rows.filter("pass").select("cand.candidate_id", "id", "pos", "score").collect():
        want.setdefault(r.candidate_id, []).append((-r.score, r.pos, r.id))
    assert got == {k: {(i, -s) for s, _, i in sorted(v)[:top]} for k, v in want.items()}


def test_texts_odd_candidates(spark):
    p = spark.createDataFrame([("x", 1, "python lead", "Pune", None, "go"), ("y", 2, None, None, None, None)], "id string, pos long, title string, location string, posted_date date, description string")
    c = spark.createDataFrame(
        [("n", "student", None, ["Pune"]), ("w", "student", ["python", None], None), ("m", "student", [], []), ("m", "student", [], []), (None, "fresher", ["go"], ["nowhere"])],
        "candidate_id string, stage string, skills array<string>, locations array<string>",
    )
    got = sorted((r.candidate_id, r.id, r.score) for r in shortlists.shortlist_per_candidate_text(p, c, AS_OF, 5).collect())
    assert [(i, j) for i, j, _ in got] == [("m", "x"), ("m", "x"), ("m", "y"), ("m", "y"), ("n", "x"), ("w", "x"), ("w", "y")]
    assert shortlists.shortlist_per_candidate_text(p.limit(0), c, AS_OF, 5).collect() == []
    assert shortlists.shortlist_per_candidate_text(p, c.limit(0), AS_OF, 5).collect() == []


def test_parts(column):
    """Every skill's look-up part is among the parts of a text that contains it."""
    text = "c++ Dev-ops of the Ärzte 日本 x".lower()
    skills = [text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)]
    parts = set(column(lambda d: shortlists.parts_of(F.col("t")), [(text,)], "t string")[0])
    assert set(column(lambda d: shortlists.look_up(F.col("s")), [(s,) for s in skills], "s string")) <= parts
