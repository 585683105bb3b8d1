"""No document vanishes: unusable ones are rows with a reason."""

import json

import pytest
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import state
from rolebook.sources import documents, feeds, tables

BROKEN = ["{oops", '{"jobs": "x"}', "5", '"text"', "null", None]


def payloads(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "payload string")


@pytest.mark.parametrize("portal", [p for p in feeds.FEEDS if p != "weworkremotely"])
def test_feeds_quarantine_documents(spark, portal):
    df = payloads(spark, BROKEN).withColumns({"slug": F.lit("s"), "company": F.lit("c")})
    good, bad = feeds.split_feed(feeds.FEEDS[portal].map(df, as_of="2026-10-10"))
    assert good.count() == 0
    reasons = [r.reject_reason for r in bad.select("reject_reason").collect()]
    assert len(reasons) == len(BROKEN) and all(reasons)


def test_seen(spark):
    good, bad = tables.parse_seen(payloads(spark, ['{"k": {"title": "t"}}', '{"seen": 5}', "[1]", *BROKEN]))
    assert [r.key for r in good.collect()] == ["k"]
    lone = [r.error for r in bad.where("key IS NULL").collect()]
    assert len(lone) == 2 + 5 and "seen must be an object, got bigint" in lone
    assert [r.key for r in bad.where("key IS NOT NULL").collect()] == ["jobs"]


def test_seen_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({f"k{i}": {"title": "t" * 50}}) + "\n" for i in range(5000)))
    good, bad = tables.read_seen_json(spark, str(tmp_path), lines=True)
    assert (good.count(), bad.count()) == (5000, 0)


def test_too_large(spark, monkeypatch):
    """Where a document cannot be parsed, its size is named as the reason."""
    monkeypatch.setattr(documents, "LARGEST", 3)
    _, bad = tables.parse_seen(payloads(spark, ["{oops"]))
    assert "too large" in bad.first().error


def test_oversize_store(spark, tmp_path):
    """70 MB in one document: a row with the reason, not nothing."""
    entry = '{"title": "' + "t" * 980 + '"}'
    with open(tmp_path / "store.json", "w") as f:
        f.write('{"seen": {' + ",".join(f'"k{i}": {entry}' for i in range(70_000)) + "}}")
    good, bad = tables.read_seen_json(spark, str(tmp_path))
    assert [r.error for r in bad.select("error").collect()] == ["document is too large to parse: land one entry a line"]
    assert good.select("key").count() == 0


def test_scores_and_batches(spark):
    good, bad = tables.parse_scores(payloads(spark, ['{"results": 5}', '{"results": [{"key": "a", "scores": {}}]}', *BROKEN]))
    assert [(r.n, r.key) for r in good.collect()] == [(0, "a")]
    assert bad.count() == 1 + len(BROKEN) and bad.where("key = 'document'").count() == 1 + len(BROKEN)
    good, bad = tables.parse_batch_refs(payloads(spark, ['[{"ref": "x"}, {}]', *BROKEN]))
    assert good.count() == 1 and bad.count() == 1 + len(BROKEN)
    assert {r.ref for r in bad.collect()} == {"entry#1", "document"}


def test_salary(spark):
    docs = ['{"companies": "x"}', '{"metadata": 5, "companies": []}', "[1]", *BROKEN]
    out = tables.salary_issues(payloads(spark, docs))
    assert out.where("pos IS NULL").count() == 3 + 5
    rows = tables.parse_salary_data(payloads(spark, ['{"companies": [{"company": "A", "city": "P", "senior": {"count": 3, "index": 9}}, {"company": "B"}]}']))
    got = {(r.company, r.category, r["count"], r["index"]) for r in rows.collect()}
    assert got == {("A", "senior", 3.0, "9"), ("B", None, None, None)}


def test_tracker_headers(spark, tmp_path):
    old, new = vocab.TRACKER_COLUMNS[:13], vocab.TRACKER_COLUMNS
    (tmp_path / "a.csv").write_text(",".join(old) + "\n" + ",".join(["2024-01-01", "A", *[""] * 11]) + "\n")
    (tmp_path / "b.csv").write_text(",".join(new) + "\n" + ",".join(["2024-01-02", "B", *[""] * 11, "2024-09-09"]) + "\n2024-01-03,C\n")
    got = {(r.company, r.deadline) for r in tables.read_tracker(spark, str(tmp_path)).collect()}
    assert got == {("A", None), ("B", "2024-09-09"), ("C", None)}
    assert tables.tracker_issues(spark, str(tmp_path)).collect() == []


def test_tracker_foreign_headers(spark, tmp_path):
    """Columns are read by name; what cannot be read is told, not guessed."""
    files = {
        "swapped": "company,date,role,x\nAcme,2024-01-01,SDE,9\n",
        "wide": "date,company,role\n2024-01-02,Beta,\"a, b\nc\",extra\n2024-01-03,Gamma,SDE\n",
        "firm": "date,firm\n2024-01-01,A\n",
        "bare": "2024-01-01,A,B\n2024-01-02,C,D\n",
        "twice": "company,role,company\nA,B,C\n",
        "bom": "\ufeffcompany, role\nDelta,QA\n",
        "only": "company,role,y\n",
        "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {(r.company, r.date, r.role) for r in tables.read_tracker(spark, str(tmp_path)).collect()}
    assert got == {("Acme", "2024-01-01", "SDE"), ("Beta", "2024-01-02", "a, b\nc"), ("Gamma", "2024-01-03", "SDE"), ("Delta", None, "QA")}
    issues = {(r.file.rsplit("/", 1)[1], r.error, r.lines) for r in tables.tracker_issues(spark, str(tmp_path)).collect()}
    none = "no header with company and role"
    assert issues == {
        ("swapped.csv", "column is not read: x", 1), ("wide.csv", "line is longer than its header", 1), ("firm.csv", none, 2),
        ("bare.csv", none, 2), ("twice.csv", "header names a column twice", 2), ("only.csv", "column is not read: y", 0),
    }


SEEN = (
    "key string, status string, location string, rank_score int, rank_verdict string, rank_date date, rank_history "
    "array<struct<score:int,verdict:string,date:string>>, location_verdict string, language_gate string, language_note string, "
    "deadline string, strengths array<string>, gaps array<string>"
)
RESULT = (
    "n int, key string, status string, scores struct<technical:double,experience:double,behavioral:double,career:double>, location_verdict string, "
    "language_gate string, language_note string, deadline string, strengths array<string>, gaps array<string>"
)


def test_repeated_results(spark):
    """Each result pushes the score before it; the store keeps its size."""
    seen = spark.createDataFrame([(f"k{i}", "new", None, None, None, None, None, None, None, None, None, None, None) for i in range(50)], SEEN)
    dims = lambda x: (x, x, x, x)
    rows = [(1, "k0", None, dims(90.0), None, "FAIL", "note", None, None, None), (0, "k0", None, dims(50.0), None, None, None, "2024-09-09", ["s"], None)]
    rows += [(2, "k0", None, dims(70.0), None, "PASS", None, None, None, None), (3, "k0", "expired", dims(None), None, None, None, None, None, None)]
    out, errors = state.apply_scores(seen, spark.createDataFrame(rows, RESULT), "2024-05-01")
    assert out.count() == 50 and errors.count() == 0
    r = out.where("key = 'k0'").first()
    assert (r.status, r.rank_score, r.deadline, r.language_gate, r.language_note, r.strengths) == ("expired", 70, "2024-09-09", "PASS", None, ["s"])
    assert [(h.score, h.date) for h in r.rank_history] == [(50, "2024-05-01"), (90, "2024-05-01")]
    plain = spark.createDataFrame(rows[:2], RESULT).drop("n")
    out, errors = state.apply_scores(seen, plain, "2024-05-01")
    assert out.count() == 50 and errors.count() == 1 and out.where("outcome IS NOT NULL").count() == 0


def test_one_decimal(column):
    from rolebook.operators.gates import one_decimal

    values = [1.15, 1.25, 0.05, 2.5, 9.95, 12.0, 0.0, 123456.75, 1.35, 0.25]
    from decimal import ROUND_HALF_UP, Decimal

    want = [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
    assert column(lambda df: one_decimal(F.col("x")), [(v,) for v in values], "x double") == want


def test_store_versions(spark, tmp_path):
    from rolebook.sources import sinks

    root = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "new"), ("b", "ranked")], "key string, status string")
    sinks.write_seen(df, root, 4)
    sinks.write_seen(sinks.read_seen(spark, root).where("key = 'a'"), root, 4)
    assert [r.key for r in sinks.read_seen(spark, root).collect()] == ["a"]
    with pytest.raises(ValueError, match="older"):
        sinks.write_seen(df, root, 3)


def test_policies_of_one_host(spark):
    from rolebook.operators.robots import policy_table

    rows = [("A.com", 500, None), ("a.com", 200, "User-agent: *\nDisallow: /x\n"), ("a.COM", 404, None)]
    out = policy_table(spark.createDataFrame(rows, "host string, http_status int, body string")).collect()
    assert [(r.host, r.state) for r in out] == [("a.com", "rules")]
