import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from rolebook.operators import evaluation, packs, reports, state
from rolebook.sources import sinks
from rolebook.streaming import ingest, keyed

AS_OF = "2026-10-10"
H = "array<struct<score:int,verdict:string,date:string>>"
SEEN = (
    f"key string, title string, company string, location string, url string, portal string, first_seen date, posted_date string, status string, "
    f"rank_score int, rank_verdict string, rank_date date, rank_history {H}, location_verdict string, language_gate string, language_note string, "
    "deadline string, strengths array<string>, gaps array<string>"
)
FIELDS = [f.split()[0] for f in SEEN.replace(H, "H").split(", ")]
RESULT = (
    "key string, status string, scores struct<technical:double,experience:double,behavioral:double,career:double>, location_verdict string, "
    "language_gate string, language_note string, deadline string, strengths array<string>, gaps array<string>"
)


def store(spark, *entries):
    return spark.createDataFrame([tuple(e.get(f) for f in FIELDS) for e in entries], SEEN)


def results(spark, *entries):
    names = ["key", "status", "scores", "location_verdict", "language_gate", "language_note", "deadline", "strengths", "gaps"]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], RESULT)


FULL = (80.0, 70.0, 60.0, 90.0)


def applied(spark, entry, result):
    out, errors = state.apply_scores(store(spark, entry), results(spark, result), AS_OF)
    return out.first(), [tuple(r) for r in errors.collect()]


def test_apply_scores(spark):
    row, errors = applied(spark, {"key": "k", "status": "new", "deadline": "2026-12-01"}, {"key": "k", "scores": FULL, "strengths": ["a", "b", "c", "d"]})
    assert errors == []
    assert (row.status, row.rank_score, row.rank_verdict, row.rank_date, row.location_verdict) == ("ranked", 78, "Strong Fit", dt.date(2026, 10, 10), "PASS")
    assert (row.deadline, row.strengths, row.rank_history, row.outcome, row.prev_score) == ("2026-12-01", ["a", "b", "c"], None, "ranked", None)


def test_absence_is_no_correction(spark):
    stored = {"key": "k", "status": "ranked", "language_gate": "FAIL", "language_note": "n", "deadline": "2026-12-01", "gaps": ["g"], "location_verdict": "FLAG"}
    row, _ = applied(spark, stored, {"key": "k", "scores": FULL})
    assert (row.language_gate, row.language_note, row.deadline, row.gaps, row.location_verdict) == ("FAIL", "n", "2026-12-01", ["g"], "FLAG")
    row, _ = applied(spark, stored, {"key": "k", "scores": FULL, "language_gate": "PASS", "deadline": "2026-11-01", "gaps": []})
    assert (row.language_gate, row.language_note, row.deadline, row.gaps) == ("PASS", None, "2026-11-01", [])
    row, _ = applied(spark, stored, {"key": "k", "scores": FULL, "language_gate": "FAIL"})
    assert row.language_note == "n"


def test_legacy_location_verdict_moves(spark):
    row, _ = applied(spark, {"key": "k", "status": "new", "location": "FAIL"}, {"key": "k", "scores": FULL})
    assert (row.location, row.location_verdict) == (None, "FAIL")
    m = state.migrate_seen(store(spark, {"key": "a", "location": "PASS"}, {"key": "b", "location": "Pune"}, {"key": "c", "location": "FAIL", "location_verdict": "PASS"}))
    assert {r.key: (r.location, r.location_verdict) for r in m.collect()} == {"a": (None, "PASS"), "b": ("Pune", None), "c": (None, "PASS")}
    with pytest.raises(ValueError):
        state.migrate_seen(m, version=99)


def test_rescore_keeps_history(spark):
    first = {"key": "k", "status": "ranked", "rank_score": 50, "rank_verdict": "Moderate Fit", "rank_date": dt.date(2026, 9, 1)}
    row, _ = applied(spark, first, {"key": "k", "scores": FULL})
    assert [tuple(h) for h in row.rank_history] == [(50, "Moderate Fit", "2026-09-01")]
    assert row.prev_score == 50


def test_bad_results_change_nothing(spark):
    s = store(spark, {"key": "k", "status": "new"}, {"key": "x", "status": "ranked"})
    r = results(spark, {"key": "k", "scores": (None, 1.0, 1.0, 1.0)}, {"key": "gone", "scores": FULL}, {"key": "x", "status": "expired"})
    out, errors = state.apply_scores(s, r, AS_OF)
    assert {x.key: (x.status, x.outcome) for x in out.collect()} == {"k": ("new", None), "x": ("expired", "expired")}
    assert {e.key: e.error for e in errors.collect()} == {"k": "missing or non-numeric score 'technical'", "gone": "no such key in the seen store"}


def test_applying_twice_changes_history_only(spark):
    s, r = store(spark, {"key": "k", "status": "new", "deadline": "2026-12-01"}), results(spark, {"key": "k", "scores": FULL, "gaps": ["g"]})
    once, _ = state.apply_scores(s, r, AS_OF)
    once = once.drop("outcome", "prev_score")
    twice, _ = state.apply_scores(once, r, AS_OF)
    a, b = once.first().asDict(), twice.drop("outcome", "prev_score").first().asDict()
    assert {k: v for k, v in a.items() if k != "rank_history"} == {k: v for k, v in b.items() if k != "rank_history"}
    assert len(b["rank_history"]) == 1


def test_sweep(spark):
    deadlines = {"a": "2026-10-09", "b": "2026-10-17", "c": None, "d": "ASAP", "e": "2026-10-18", "f": "2026-10-10", "x": "2026-01-01"}
    s = store(spark, *[{"key": k, "status": "ranked", "deadline": d} for k, d in deadlines.items()], {"key": "n", "status": "new", "deadline": "2026-01-01"})
    out = state.sweep(s, AS_OF, exclude=["x"])
    assert {r.key: r.sweep for r in out.collect()} == {"a": "expired", "b": "closing", "c": "ok", "d": "unparseable", "e": "ok", "f": "closing"}
    after = {r.key: r.status for r in state.apply_sweep(s, AS_OF, exclude=["x"]).collect()}
    assert after == {**dict.fromkeys("bcdefx", "ranked"), "a": "expired", "n": "new"}


def test_store_reads_only_the_partitions_it_needs(spark, tmp_path):
    from rolebook.sources import sinks

    root = str(tmp_path / "store")
    sinks.write_seen(store(spark, {"key": "a", "status": "ranked"}, {"key": "b", "status": "skipped"}, {"key": "c", "status": "new"}), root, 1)
    seen = sinks.read_seen(spark, root)
    swept = state.sweep(seen, AS_OF)._jdf.queryExecution().executedPlan().toString()
    dropped = state.compact(seen, AS_OF)[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in swept and "= ranked)]" in swept
    assert "PartitionFilters: [status" in dropped and "IN (skipped,expired)]" in dropped


def test_compact(spark):
    old, new = "2026-01-01", "2026-10-01"
    cases = {
        "drop1": ("skipped", None, old), "drop2": ("expired", "2026-02-01", old), "drop3": ("skipped", "ASAP", old),
        "edge": ("skipped", None, "2026-07-12"), "open": ("skipped", "2026-10-10", old), "recent": ("skipped", None, new),
        "undated": ("expired", None, None), "ranked": ("ranked", None, old), "kept": ("skipped", None, old), "none": (None, None, old),
    }
    s = store(spark, *[{"key": k, "status": st, "deadline": d, "posted_date": p} for k, (st, d, p) in cases.items()])
    kept, dropped = state.compact(s, AS_OF, exclude=["kept"])
    assert {r.key for r in dropped.collect()} == {"drop1", "drop2", "drop3", "edge"}
    assert kept.count() + dropped.count() == len(cases)


def test_select_candidates(spark):
    s = store(
        spark, {"key": "1", "status": "new", "title": "Go Dev", "company": "A", "first_seen": dt.date(2026, 1, 2)},
        {"key": "2", "status": "new", "title": "SDE", "company": "B", "gaps": ["golang"], "first_seen": dt.date(2026, 1, 1)},
        {"key": "3", "status": "ranked", "title": "go", "company": "C"}, {"key": "4", "status": "new", "title": "go", "company": "Acme"},
        {"key": "5", "status": "skipped", "title": "go", "company": "D"},
    )
    t = spark.createDataFrame([("ACME", "Go")], "company string, role string")
    chosen, report = state.select_candidates(s, t, focus="GO", limit=1)
    assert [r.key for r in chosen.collect()] == ["2"]
    assert report.first().asDict() == {"eligible": 2, "deferred": 1, "excluded_by_tracker": 1, "total_entries": 5}
    chosen, report = state.select_candidates(s, t, limit=0, everything=True)
    assert {r.key for r in chosen.collect()} == {"1", "2", "3"} and report.first().deferred == 0


# --- tracker ----------------------------------------------------------------------


def tracker(spark, *rows):
    return spark.createDataFrame([(i, s, dt.date.fromisoformat(d)) for i, s, d in rows], "application_id long, status string, date date")


def test_followups_and_stale(spark):
    t = tracker(spark, (1, "applied", "2026-10-03"), (2, "drafted", "2026-01-01"), (3, "rejected", "2026-01-01"), (4, "applied", "2026-10-04"), (5, "applied", "2026-01-01"), (6, "mystery", "2026-09-01"))
    act = spark.createDataFrame([(5, dt.date(2026, 9, 1), "followup"), (5, dt.date(2026, 9, 5), "followup")], "application_id long, at date, kind string")
    assert {r.application_id for r in state.followups_due(t, act, AS_OF).collect()} == {1, 6}
    assert {r.application_id for r in state.stale_applications(t, act, AS_OF).collect()} == {5, 6}


def test_advance_status(spark):
    t = tracker(spark, (1, "drafted", "2026-01-01"), (2, "interview", "2026-01-01"), (3, "rejected", "2026-01-01"), (4, "applied", "2026-01-01"), (5, "no response", "2026-06-01"))
    day = dt.date(2026, 2, 1)
    msgs = [
        (1, day, "We received your application"), (2, day, "thank you for applying"), (3, day, "Application received"),
        (4, day, "You are SHORTLISTED"), (4, day, "your application was viewed"), (5, day, "application received"),
    ]
    out = state.advance_status(t, spark.createDataFrame(msgs, "application_id long, at date, text string"))
    got = sorted((r.application_id, r.status, str(r.date), r.change) for r in out.collect() if r.change or r.application_id in (2, 5))
    assert got == [
        (1, "applied", "2026-02-01", "advanced"), (2, "interview", "2026-01-01", None), (3, "applied", "2026-02-01", "reapplied"),
        (4, "interview", "2026-01-01", "advanced"), (5, "no_response", "2026-06-01", None),
    ]
    assert out.count() == 6


def test_funnel_reads_history(spark):
    e = spark.createDataFrame([(1, "applied"), (1, "interview"), (1, "rejected"), (2, "drafted"), (3, "offer declined"), (4, "applied")], "application_id long, stage string")
    assert {r.stage: r.applications for r in reports.funnel(e).collect()} == {"applied": 3, "interview": 2, "offer": 1, "hired": 0}


def test_rejection_rate(spark):
    statuses = ["rejected", "no response", "offer_declined", "withdrawn", "hired", "interview", "offer", "drafted"]
    r = reports.rejection_rate(spark.createDataFrame([(s,) for s in statuses], "status string")).first()
    assert (r.rejected, r.closed, r.rate) == (2, 5, 0.4)


def test_status_buckets_have_a_catch_all(spark):
    t = spark.createDataFrame([("no response",), ("no_response",), ("ghosted",), ("drafted",), (None,)], "status string")
    assert {r.bucket: (r.applications, r.unrecognised) for r in reports.status_buckets(t).collect()} == {"Rejected/Closed": (4, 2), "Drafted": (1, 0)}
    assert {r.status for r in reports.unrecognised_statuses(t).collect()} == {"ghosted", None}


def test_gap_heatmap_never_reads_blank_as_zero(spark):
    merged = spark.createDataFrame(
        [(True, "80", None, ["go"], "inferred"), (True, "", 60, ["go"], "recorded"), (True, "n/a", None, ["sql"], "inferred"), (False, None, 44, ["sql"], "recorded"), (False, None, 45, ["Go"], "recorded")],
        "tracked boolean, fit_rating string, rank_score int, gaps array<string>, provenance string",
    )
    got = {r.gap: (round(r.weight, 6), r.postings, r.recorded) for r in reports.gap_heatmap(merged).collect()}
    assert got == {"go": (1.15, 3, 2)}
    assert reports.gap_coverage(merged).first().asDict() == {"tracked": 2, "ranked": 1, "skipped": 1}


def test_salary_vs_baseline(spark):
    df = spark.createDataFrame([("110", 100.0), ("95.5", 100.0), ("n/a", 100.0), (None, 100.0), ("5", 0.0)], "index string, baseline double")
    got = [(r.index_shown, r.difference) for r in reports.salary_vs_baseline(df).collect()]
    assert got == [("110.0", "+10.0%"), ("95.5", "-4.5%"), ("n/a", None), ("N/A", None), ("5.0", None)]


def test_source_notes_show_dead_sources(spark):
    p = spark.createDataFrame([("a",), ("a",)], "portal string")
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "portal string")
    errors = spark.createDataFrame([("b", "timeout")], "portal string, error string")
    notes = reports.source_notes(p, sources, errors, 2)
    assert {r.portal: (r.ok, r.rows, r.truncated) for r in notes.collect()} == {"a": (True, 2, True), "b": (False, 0, False), "c": (True, 0, False)}
    assert [r.line for r in reports.health_lines(notes).collect()] == ["health: b — error: timeout"]
    said = reports.status_lines(notes, skipped=["x", "y"], fallback=["z"]).orderBy("position", "line")
    assert [r.line for r in said.collect()] == ["skipped: x, y", "fallback: z", "health: b — error: timeout"]
    assert reports.status_lines(notes).count() == 1


# --- packs ------------------------------------------------------------------------

PROFILE = {
    "name": "Asha", "email": "a@x.org", "summary": "Builder.", "skills": ["sql", "Python"],
    "experience": [{"role": "Dev", "company": "Acme", "period": "2024", "bullets": [{"text": f"b{i}"} for i in range(5)] + [{"text": "Python tools"}]}],
    "education": [{"degree": "BTech", "school": "IIT", "year": "2026"}],
}


def test_packs(spark):
    df = spark.createDataFrame([("1", "Python Engineer", "Beta", "python engineer kubernetes with kubernetes"), ("2", "", "Z", "")], "id string, title string, company string, description string")
    profile = F.from_json(F.lit(json.dumps(PROFILE)), packs.PROFILE_SCHEMA)
    rows = {r.id: r for r in packs.build_packs(packs.with_keyword_gaps(df, profile["skills"]), profile).collect()}
    assert (rows["1"].covered, rows["1"].missing) == (["python"], ["engineer", "kubernetes"])
    pack = rows["1"].pack
    assert [t.source for t in pack.traces] == ["experience[0].bullets[5]", "experience[0].bullets[0]", "experience[0].bullets[1]", "experience[0].bullets[2]"]
    assert pack.pitch == "Applying for Python Engineer at Beta: my strongest matches are python. Builder."
    assert "## Skills\nPython, sql\n" in pack.resume and "- BTech, IIT (2026)" in pack.resume
    assert rows["2"].pack.gaps == [] and "growth fit" in rows["2"].pack.pitch
    long = F.from_json(F.lit(json.dumps(dict(PROFILE, summary="s" * 900))), packs.PROFILE_SCHEMA)
    assert len(packs.build_packs(packs.with_keyword_gaps(df, long["skills"]), long).first().pack.pitch) == 600


def test_title_words_weigh_four(spark):
    df = spark.createDataFrame([("1", "rust", "java java java java java scala scala scala scala")], "id string, title string, description string")
    got = packs.keyword_gaps(df, F.array(F.lit("zzz"))).first()
    assert got.missing == ["java", "rust", "scala"]


def test_profile_issues(spark):
    docs = [PROFILE, dict(PROFILE, name=" "), {k: v for k, v in PROFILE.items() if k != "skills"}, dict(PROFILE, education=[{"degree": "x"}])]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "n int, j string")
    p = df.select("n", F.from_json("j", packs.PROFILE_SCHEMA).alias("p")).select("n", "p.*")
    assert [r.issue for r in packs.profile_issues(p).orderBy("n").collect()] == [None, "name is missing", "skills must be text", "education is incomplete"]


# --- evaluation -------------------------------------------------------------------


def test_evaluate_gates(spark):
    def g(v):
        return [("stale", v, "n")]

    gated = spark.createDataFrame([("1", g("FAIL"), False), ("2", g("PASS"), True), ("3", g("FLAG"), True), ("4", g("FLAG"), True)], "id string, gates array<struct<gate:string,verdict:string,note:string>>, pass boolean")
    labels = spark.createDataFrame([("1", "KEEP"), ("2", "REJECT"), ("3", "KEEP_WITH_FLAG"), ("4", "KEEP")], "id string, label string")
    r = {x.gate: x for x in evaluation.evaluate_gates(gated, labels).collect()}["all"]
    assert (round(r.false_reject_rate, 4), r.false_accept_rate, r.flag_precision) == (0.3333, 1.0, 0.5)


def test_rank_stability(spark):
    a = spark.createDataFrame([(str(i), i * 10) for i in range(10)], "id string, score int")
    same = evaluation.rank_stability(a, a, k=3).first()
    assert (round(same.spearman, 9), same.top_k_overlap, same.band_churn, same.score_sigma) == (1.0, 3, 0, 0.0)
    flipped = evaluation.rank_stability(a, a.withColumn("score", 90 - F.col("score")), k=3).first()
    assert round(flipped.spearman, 9) == -1.0 and flipped.top_k_overlap == 0


# --- stream -----------------------------------------------------------------------


def landed(spark, *rows):
    data = [(i, "t", "c", "Pune", None, url, "p", None, dt.datetime(2026, 10, day)) for i, url, day in rows]
    return spark.createDataFrame(data, ingest.LANDED_SCHEMA)


def test_stream_stores_each_posting_once(spark, tmp_path):
    src, out = (str(tmp_path / n) for n in ("in", "out"))
    landed(spark, ("a", "https://e.com/1", 1), ("b", "https://e.com/1?ref=x", 1), ("c", "https://e.com/2", 1)).write.parquet(src)
    ingest.stream_ingest(spark, src, out).awaitTermination()
    assert {r.key: r.status for r in ingest.read_table(spark, out).collect()} == {"https://e.com/1": "new", "https://e.com/2": "new"}
    # Much later the same posting comes again: past the watermark, known to the table.
    landed(spark, ("d", "https://e.com/1#x", 30), ("e", "https://e.com/3", 30)).write.mode("append").parquet(src)
    ingest.stream_ingest(spark, src, out).awaitTermination()
    rows = ingest.read_table(spark, out).collect()
    assert sorted(r.key for r in rows) == ["https://e.com/1", "https://e.com/2", "https://e.com/3"]
    assert {r.key: str(r.first_seen) for r in rows}["https://e.com/1"] == "2026-10-01"


def test_replayed_batch_writes_the_same_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.create_table(spark, out)
    batch = ingest.keyed(landed(spark, ("a", "https://e.com/1", 1), ("b", "https://e.com/2", 2)))
    for batch_id in (0, 0, 1):
        ingest.upsert_batch(batch, batch_id, out)
    assert sorted((r.key, r.ingest_batch) for r in ingest.read_table(spark, out).collect()) == [("https://e.com/1", 0), ("https://e.com/2", 0)]


def keyed_rows(spark, *rows):
    """(id, url, day seen, day landed, deadline, score) rows of the keyed stream."""
    data = [(i, "t", "c", "Pune", None, url, "p", due, score, None, dt.datetime(2026, 10, seen), dt.datetime(2026, 10, land)) for i, url, seen, land, due, score in rows]
    return spark.createDataFrame(data, keyed.LANDED_SCHEMA)


def test_keyed_stream(spark, tmp_path):
    """New, seen earlier, ranked, expired; replays and repeated scores change nothing."""
    src, out = (str(tmp_path / n) for n in ("in", "out"))
    u = "https://e.com/"

    def run(*rows):
        keyed_rows(spark, *rows).write.mode("append").parquet(src)
        keyed.run(spark, src, out).awaitTermination()
        return {r.key[-1]: (r.id, r.status, r.score, r.first_seen.day, r.deadline) for r in keyed.entries(spark, out).collect()}

    first = (("a", u + "1", 5, 5, "2026-10-08", None), ("b", u + "1?ref=x", 6, 6, None, None), ("c", u + "2", 5, 5, "soon", None), ("d", u + "3", 5, 5, "2026-10-06", None))
    assert run(*first) == {"1": ("a", "new", None, 5, "2026-10-08"), "2": ("c", "new", None, 5, "soon"), "3": ("d", "new", None, 5, "2026-10-06")}
    got = run(("old", u + "2", 1, 7, None, None), ("s", u + "1", 7, 7, None, 80), ("t", u + "2", 7, 7, None, 50), ("x", u + "9", 7, 7, None, 50))
    assert got == {"1": ("a", "ranked", 80, 5, "2026-10-08"), "2": ("old", "ranked", 50, 1, "soon"), "3": ("d", "new", None, 5, "2026-10-06")}
    again = run(*first, ("s", u + "1", 7, 8, None, 80))
    assert again == got
    assert run(("z", u + "5", 9, 9, None, None))["1"] == ("a", "expired", 80, 5, "2026-10-08")
    late = run(("y", u + "3", 9, 9, None, 30))  # scored after its deadline: expires as soon as the clock is read
    assert late["3"][:3] == ("d", "expired", 30) and late["2"][1] == "ranked"
    log = [(r.key[-1], r.change) for r in keyed.history(spark, out).orderBy("batch", "key", "version").collect()]
    assert sorted(log) == [("1", "expired"), ("1", "new"), ("1", "ranked"), ("2", "new"), ("2", "ranked"), ("2", "seen earlier"), ("3", "expired"), ("3", "new"), ("3", "ranked"), ("5", "new"), ("9", "unknown key")]


def test_store_reads_write_nothing_and_writers_do_not_overtake(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="never written"):
        sinks.read_seen(spark, root)
    assert not os.path.exists(root)
    df = spark.createDataFrame([("a", "new")], "key string, status string")
    sinks.write_seen(df, root, 1)
    before = sorted(str(x) for x in tmp_path.rglob("*"))
    assert sinks.read_seen(spark, root).count() == 1 and sinks.current_version(spark, root) == 1
    assert sorted(str(x) for x in tmp_path.rglob("*")) == before
    numbers = sinks._numbers(spark, root)
    # a second writer that looked before the first one entered
    monkeypatch.setattr(sinks, "_numbers", lambda *_: numbers[:-1])
    monkeypatch.setattr(sinks, "ledger", lambda *_: [])
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.write_seen(df.union(df), root, 1)
    monkeypatch.undo()
    assert sinks.read_seen(spark, root).count() == 1
    (tmp_path / "store" / "ledger" / "entry-0000000001.json").write_text("")  # a writer lost between creating and writing
    assert sinks.read_seen(spark, root).count() == 1
    sinks.write_seen(df.union(df), root, 2)
    assert sinks.read_seen(spark, root).count() == 2 and sinks.read_seen(spark, root, 1).count() == 1


def test_delta_store(spark, tmp_path):
    """Deltas stand in for their keys, the last one counts, folding changes nothing that is read."""
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="never written"):
        sinks.write_delta(store(spark, {"key": "a", "status": "new"}), root)
    sinks.write_seen(store(spark, *[{"key": f"k{i}", "status": "new" if i % 2 else "ranked", "title": "t"} for i in range(40)]), root, 1)
    size = lambda: sum(x.stat().st_size for x in (tmp_path / "store" / "data").rglob("*.parquet"))
    whole = size()
    sinks.write_delta(store(spark, {"key": "k1", "status": "skipped"}, {"key": "new", "status": "new"}), root)
    sinks.write_delta(store(spark, {"key": "k1", "status": "ranked", "title": "last"}), root)
    assert size() < 4 * whole
    rows = {r.key: (r.status, r.title) for r in sinks.read_seen(spark, root).collect()}
    assert len(rows) == 41 and rows["k1"] == ("ranked", "last") and rows["new"] == ("new", None) and rows["k3"] == ("new", "t")
    assert sinks.read_seen(spark, root).filter("status = 'ranked'").count() == 21
    # written but never named: a writer lost half-way
    store(spark, {"key": "k5", "status": "expired"}).write.parquet(f"{root}/data/delta-lost")
    assert {r.key: (r.status, r.title) for r in sinks.read_seen(spark, root).collect()} == rows
    assert not sinks.fold(spark, root, share=0.5) and sinks.fold(spark, root, share=0.01)
    assert {r.key: (r.status, r.title) for r in sinks.read_seen(spark, root).collect()} == rows
    assert not sinks.fold(spark, root, share=0.01) and sinks.current_version(spark, root) == 1
