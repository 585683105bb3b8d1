import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import gates as G
from rolebook.operators import scoring as S

AS_OF = "2026-10-10"
STUDENT = S.Candidate("s", "student", ("python", "backend"), ("Bengaluru",), 2026, 20000.0)


def gate_of(spark, rows, cand, name, as_of=AS_OF, max_age=30):
    """(verdict, note) of one gate for (description, location, age) rows."""
    day = dt.date.fromisoformat(as_of)
    data = [
        (i, f"id{i}", "T", loc, None if age is None else day - dt.timedelta(days=age), desc)
        for i, (desc, loc, age) in enumerate(rows)
    ]
    df = spark.createDataFrame(data, "pos int, id string, title string, location string, posted_date date, description string")
    out = G.run_gates(G.with_text_facts(df), cand.as_struct(), as_of, max_age)
    picked = F.filter("gates", lambda g: g["gate"] == name)[0]
    got = out.select("pos", picked.alias("g")).orderBy("pos").collect()
    return [(r.g.verdict, r.g.note) for r in got]


def verdicts(spark, descriptions, cand, name):
    return [v for v, _ in gate_of(spark, [(d, "Bengaluru", 1) for d in descriptions], cand, name)]


def test_stale(spark):
    got = gate_of(spark, [("x", "Bengaluru", a) for a in (2, 90, None, 30)], STUDENT, "stale")
    assert [v for v, _ in got] == ["PASS", "FAIL", "FLAG", "PASS"]
    assert got[1][1] == "posted 90d ago (> 30d window)"


def test_location(spark):
    places = ["Bengaluru", "Mumbai", "Bangalore", None]
    got = gate_of(spark, [("x", p, 1) for p in places], STUDENT, "location")
    assert [v for v, _ in got] == ["PASS", "FAIL", "PASS", "FAIL"]
    assert got[3][1] == "location unstated (source gave none)"
    anywhere = S.Candidate("s", "student", (), ())
    assert [v for v, _ in gate_of(spark, [("x", p, 1) for p in places], anywhere, "location")] == ["PASS"] * 4
    remote = S.Candidate("s", "student", (), ("Remote",))
    assert [v for v, _ in gate_of(spark, [("x", p, 1) for p in ("Remote, EU", "Pune")], remote, "location")] == ["PASS", "FAIL"]


def test_language(spark):
    got = gate_of(
        spark,
        [(d, "Bengaluru", 1) for d in ("must be fluent Hindi", "fluent English", "fluent English required, German essential", "Fluent in English", "Fluent in Dutch")],
        STUDENT, "language",
    )
    assert [v for v, _ in got] == ["FAIL", "PASS", "FAIL", "PASS", "FAIL"]
    assert got[0][1] == 'requires working language: "fluent Hindi"'


def test_strict_language_reads_the_next_word(spark):
    df = spark.createDataFrame([("Fluent in English",)], "description string").withColumn("location", F.lit("x"))
    strict = G.with_text_facts(df, strict=True).select("facts.language").first()[0]
    loose = G.with_text_facts(df).select("facts.language").first()[0]
    assert (strict, loose) == ("Fluent in", None)


def test_batch(spark):
    texts = [
        "2025 batch only", "2024/2025 batch preferred", "class of 2026 welcome",
        "Only 30 engineers work here. We hire 2025 batch grads.",
        "A team of only 30 people; our stack was rewritten in 2020.",
        "Batch of 2024 or 2025.\nonly on weekdays", "only\nfor the 2025 batch",
    ]
    assert verdicts(spark, texts, STUDENT, "batch") == ["FAIL", "FLAG", "PASS", "FLAG", "PASS", "FLAG", "FAIL"]
    got = gate_of(spark, [("2024/2025 batch preferred", "x", 1)], STUDENT, "batch")
    # Every year of the matched span counts, not just the first.
    assert got[0][1] == "mentions batches 2024/2025 (candidate: 2026)"
    old = S.Candidate("e", "experienced", (), (), 2026)
    assert verdicts(spark, texts, old, "batch") == ["PASS"] * len(texts)


def brute_batch(text, year):
    """The rule read character by character, for comparison."""
    near = re.compile(
        rf"\b20\d{{2}}\b[^.;!?|\n]{{0,30}}?\b(?:{vocab.BATCH_TERM})\b|\b(?:{vocab.BATCH_TERM})\b[^.;!?|\n]{{0,30}}?\b20\d{{2}}\b", re.I | re.A
    )
    years, exclusive = set(), False
    for m in near.finditer(text):
        years |= {int(y) for y in re.findall(r"\b20\d{2}\b", m.group(0))}
        start = max((text.rfind(c, 0, m.start()) for c in ".;!?"), default=-1) + 1
        ends = [i for i in (text.find(c, m.start()) for c in ".;!?\n") if i >= 0]
        sentence = text[start : (min(ends) + 1) if ends else len(text)]
        exclusive |= bool(re.search(rf"\b(?:{vocab.BATCH_ONLY})\b", sentence, re.I))
    if not years or year in years:
        return "PASS"
    return "FAIL" if exclusive else "FLAG"


def test_batch_matches_brute_force(spark):
    bits = ["2025 batch", "only", "class of 2024", "2026 graduates", "exclusively", "we like tea", "passing out 2023", "fresher"]
    seps = [" ", ". ", "\n", "; ", ", "]
    texts = [bits[i % 8] + seps[j] + bits[(i * 3 + j) % 8] + seps[(i + j) % 5] + bits[(i + 2 * j + 1) % 8] for i in range(8) for j in range(5)]
    assert verdicts(spark, texts, STUDENT, "batch") == [brute_batch(t, 2026) for t in texts]


def test_stipend(spark):
    texts = ["₹15000 per month", "₹30000 per month", "interviews at 3 p.m.", "monthly stipend of 5,000", "Rs. 25,000/month", "monthly visits to 5 offices"]
    assert verdicts(spark, texts, STUDENT, "stipend") == ["FAIL", "PASS", "FLAG", "FAIL", "PASS", "FLAG"]
    got = gate_of(spark, [("₹15000 per month", "x", 1)], STUDENT, "stipend")
    assert got[0][1] == "stipend 15000 < floor 20000/month"


def test_ctc(spark):
    cand = S.Candidate("e", "experienced", (), (), ctc_floor=12.0)
    texts = ["8 LPA", "20 LPA", "8,00,000 per annum", "20,00,000 per annum", "3 p.a.", "8-12 LPA"]
    got = gate_of(spark, [(t, "x", 1) for t in texts], cand, "ctc")
    assert [v for v, _ in got] == ["FLAG", "PASS", "FLAG", "PASS", "FLAG", "PASS"]
    assert got[0][1] == "CTC ~8.0 LPA < floor 12 LPA"
    assert got[4][1] == "no CTC stated"


def test_bond_is_one_table_safe_line(spark):
    got = gate_of(spark, [("A 2 year service agreement\nwith | pay", "x", 1), ("bond of two years", "x", 1), ("James Bond", "x", 1)], STUDENT, "bond")
    assert got[0] == ("FLAG", 'bond terms: "service agreement with \\| pay"')
    assert [v for v, _ in got] == ["FLAG", "FLAG", "PASS"]


def test_blank_text_is_not_evaluated(spark):
    for name in ("language", "batch", "stipend", "bond"):
        got = gate_of(spark, [(" \n", "Bengaluru", 1)], STUDENT, name)
        assert got == [("PASS", vocab.NOT_EVALUATED_NOTE)]


def test_policy_scope(spark):
    df = spark.range(1).select(
        F.array(
            *[
                F.struct(F.lit(g).alias("gate"), F.lit(v).alias("verdict"), F.lit("").alias("note"))
                for g, v in (("ctc", "FLAG"), ("bond", "FAIL"), ("stale", "FAIL"), ("notice", "FAIL"), ("residency", "FAIL"))
            ]
        ).alias("gates")
    )
    def run(stage, market):
        r = G.apply_gate_policy(df, F.lit(stage), F.lit(market)).first()
        return {(g.gate, g.verdict) for g in r.policy_gates}, r.policy_pass, r.hard_stop
    got = run("experienced", "us")
    assert got == ({("compensation", "FLAG"), ("notice-period", "FLAG"), ("eligibility", "FAIL")}, False, True)
    assert ("bond", "FLAG") in run("student", "india")[0]


def test_tables_are_sound():
    for weights in vocab.STAGE_WEIGHTS.values():
        assert sum(weights) == pytest.approx(1)
    for weights in vocab.FACTOR_WEIGHTS.values():
        assert sum(weights) == pytest.approx(1)
    floors = [f for _, f in vocab.BANDS]
    assert floors == sorted(floors, reverse=True) and floors[-1] == 0
    assert len(vocab.GATE_POLICY) == 9


def test_staleness_flag_never_vetoes(column):
    rows = [(dt.date(2026, 9, 1),), (dt.date(2026, 10, 1),), (None,)]
    assert column(lambda d: G.staleness_flag("p", AS_OF), rows, "p date") == ["posted 39 days ago", None, None]
