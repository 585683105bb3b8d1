import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolebook.operators import scoring as S

AS_OF = "2026-10-10"
SCHEMA = "id string, title string, company string, location string, posted_date date, url string, pos int, description string"


def test_rank_keeps_reasons(spark):
    day = dt.date(2026, 10, 9)
    rows = [
        ("1", "Python Backend Intern", "A", "Bengaluru", day, "u", 1, ""),
        ("2", "Python Intern", "A", "Mumbai", day, "u", 2, ""),
        ("3", "Python Intern", "A", "Bengaluru", dt.date(2026, 1, 1), "u", 3, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cand = S.Candidate("s", "student", ("python", "backend"), ("Bengaluru",), 2026, 20000.0)
    ranked, rejected = S.rank_shortlist(df, cand.as_struct(), AS_OF)
    assert [r.id for r in ranked.collect()] == ["1"]
    got = {r.id: r.reasons for r in rejected.collect()}
    assert got == {"2": ['location: location "Mumbai" outside accepted set'], "3": ["stale: posted 282d ago (> 30d window)"]}
    best = ranked.first()
    assert (best.score, best.verdict) == (100, "strong fit")
    assert best.strengths == ['matches skill "python" per posting text', 'matches skill "backend" per posting text']


def test_ranked_and_rejected_make_the_input(spark):
    rows = [(str(i), "t", "c", "Pune" if i % 2 else None, dt.date(2026, 10, 1), "u", i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    cand = S.Candidate("s", "fresher", ("go",), ("Pune",))
    ranked, rejected = S.rank_shortlist(df, cand.as_struct(), AS_OF, with_text=True)
    assert ranked.count() + rejected.count() == 20
    top = S.shortlist(df, cand.as_struct(), AS_OF, 3)
    assert [r.pos for r in top.collect()] == [1, 3, 5]


def test_overall_score(spark):
    dims = "struct<technical:double,experience:double,behavioral:double,career:double>"
    df = spark.createDataFrame([((80.0, 70.0, 60.0, 90.0),), ((None, 1.0, 1.0, 1.0),), ((0.5, 0.5, 0.5, 0.5),)], f"s {dims}")
    got = df.select(S.overall_score(F.col("s")).alias("v"), S.missing_dimension(F.col("s")).alias("e")).collect()
    assert [r.v for r in got] == [78, None, 1]
    assert got[1].e == "missing or non-numeric score 'technical'"


def test_bands(column):
    rows = [(75,), (74,), (45,), (30,), (0,), (None,)]
    assert column(lambda d: S.band(F.col("s")), rows, "s int") == ["Strong Fit", "Good Fit", "Moderate Fit", "Weak Fit", "Poor Fit", None]


def test_history_keeps_five(spark):
    h = [(i, "Weak Fit", "2026-01-01") for i in range(5)]
    df = spark.createDataFrame([(h, 50, "x", "2026-02-01"), (h, None, None, None)], "h array<struct<score:int,verdict:string,date:string>>, s int, v string, d string")
    got = df.select(S.push_history("h", F.col("s"), F.col("v"), F.col("d")).alias("o")).collect()
    assert [e.score for e in got[0].o] == [1, 2, 3, 4, 50]
    assert [e.score for e in got[1].o] == [0, 1, 2, 3, 4]


def test_movement(column):
    rows = [(None, 50), (50, 54), (50, 58), (59, 60)]
    assert column(lambda d: S.movement(F.col("a"), F.col("b")), rows, "a int, b int") == [None, "noise", "drift", "band"]


def test_no_skills_is_half(column):
    got = column(lambda d: S.title_match(F.col("t"), F.array().cast("array<string>")), [("x",)], "t string")
    assert got == [0.5]


def test_unknown_stage_is_refused():
    with pytest.raises(ValueError):
        S.Candidate(stage="senior")
