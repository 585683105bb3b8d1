import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolebook import schemas, vocab
from rolebook.sources import feeds, sinks, tables


def payloads(spark, *docs, **context):
    df = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "payload string")
    return df.withColumns({k: F.lit(v) for k, v in context.items()})


def mapped(spark, portal, *docs, **context):
    kw = {"as_of": "2026-10-10"}
    return [r.asDict() for r in feeds.FEEDS[portal].map(payloads(spark, *docs, **context), **kw).collect()]


def test_greenhouse(spark):
    rows = mapped(
        spark, "greenhouse",
        {"jobs": [
            {"id": 5, "title": " SDE ", "absolute_url": "https://g/5", "location": {"name": " Pune "}, "updated_at": "2026-10-01T10:00:00-04:00", "content": "&lt;p&gt;hi&lt;/p&gt;"},
            {"id": 6, "absolute_url": "https://g/6", "location": {"name": " "}},
        ]},
        slug="acme", company="Acme",
    )
    assert (rows[0]["id"], rows[0]["title"], rows[0]["location"], rows[0]["posted_date"], rows[0]["description"]) == (
        "greenhouse:acme:5", "SDE", "Pune", dt.date(2026, 10, 1), "hi",
    )
    assert (rows[1]["title"], rows[1]["location"], rows[1]["posted_date"]) == ("Untitled", None, None)


def test_lever(spark):
    item = {
        "id": "x", "text": "Dev", "hostedUrl": "https://l/x", "categories": {"location": ""}, "createdAt": 1760000000000,
        "description": "<b>Body</b>", "lists": [{"text": "Must", "content": "<li>a</li>"}, {"text": "Nice", "content": "b"}],
    }
    row = mapped(spark, "lever", [item], slug="acme", company="Acme")[0]
    assert (row["location"], row["posted_date"]) == (None, dt.date(2025, 10, 9))
    assert row["description"] == "Body\n\nMust\na\n\nNice\nb"
    long = dict(item, description="d" * 5000, lists=[{"text": "t", "content": "c" * 5000}])
    df = payloads(spark, [long], slug="acme", company="Acme")
    assert len(feeds.map_lever(df, chars=vocab.DETAIL_CHARS).first().description) == 4000
    assert len(feeds.map_lever(df).first().description) > 10000


def test_smartrecruiters(spark):
    rows = mapped(
        spark, "smartrecruiters",
        {"content": [
            {"id": "1", "name": "A", "location": {"city": "Pune", "country": "in"}, "releasedDate": "2026-10-01T00:00:00Z"},
            {"id": "2", "name": "B", "location": {"city": "", "country": "in"}}, {"id": "3", "name": "C"},
        ], "totalFound": 3},
        slug="Fresh works", company="Freshworks",
    )
    assert [r["location"] for r in rows] == ["Pune, in", "in", None]
    assert rows[0]["url"] == "https://jobs.smartrecruiters.com/Fresh%20works/1"
    a = {"jobAd": {"sections": [{"title": "Z", "text": "<p>1</p>"}, {"title": "", "text": ""}]}}
    b = {"jobAd": {"sections": {"z": {"title": "Z", "text": "1"}, "a": {"title": "A", "text": "2"}}}}
    got = payloads(spark, a, b, {"jobAd": {}}).select(feeds.smartrecruiters_description(F.col("payload")).alias("d")).collect()
    assert [r.d for r in got] == ["Z\n1", "Z\n1\n\nA\n2", ""]


def test_amazon(spark):
    rows = mapped(
        spark, "amazon",
        {"jobs": [
            {"id": 7, "title": "SDE", "location": "Hyderabad", "posting_date": "October 5, 2026", "job_path": "/en/jobs/7/sde", "description": "a<br/>b", "qualifications": "c"},
            {"id": "8", "title": "X"},
        ]},
    )
    assert (rows[0]["id"], rows[0]["url"], rows[0]["posted_date"], rows[0]["description"]) == (
        "amazon:7", "https://www.amazon.jobs/en/jobs/7/sde", dt.date(2026, 10, 5), "a b c",
    )
    assert (rows[1]["url"], rows[1]["company"], rows[1]["location"]) == ("https://www.amazon.jobs/en/jobs/8", "Amazon", None)


def test_workday(spark):
    rows = mapped(
        spark, "workday",
        {"jobPostings": [{"title": "A", "externalPath": "/job/x", "postedOn": "Posted 5 Days Ago"}, {"bulletinId": "B1", "title": "B"}, {"postedOn": "Posted Today"}]},
        slug="acme/Ext/5", company="Acme",
    )
    assert [r["id"] for r in rows] == ["workday:acme:/job/x", "workday:acme:B1", "workday:acme:untitled"]
    assert [r["posted_date"] for r in rows] == [dt.date(2026, 10, 5), None, None]
    assert rows[2]["title"] == "Untitled"


def test_remoteok(spark):
    rows = mapped(
        spark, "remoteok",
        [
            {"last_updated": 1, "legal": "x"},
            {"slug": "lead-1137796", "id": "1137796", "date": "2026-11-13T08:00:21+00:00", "company": "Fuku", "position": "Lead", "tags": ["web3"], "location": "Paris", "salary_min": 0, "salary_max": 0, "url": ""},
            {"id": 5, "position": "Dev", "url": 77}, {"id": 6, "position": "Dev", "company": "", "url": " https://r/6 ", "location": " ", "date": "garbage", "salary_min": 50000},
        ],
    )
    assert [r["reject_reason"] for r in rows] == ["no-id", None, "no-url", None]
    assert (rows[1]["url"], rows[1]["salary"], rows[1]["tags"]) == ("https://remoteok.com/remote-jobs/lead-1137796", None, ["web3"])
    assert (rows[3]["company"], rows[3]["location"], rows[3]["posted_date"], rows[3]["url"], rows[3]["salary"]) == (
        "Unknown", None, None, "https://r/6", "From $50,000 / year",
    )


def test_remotive(spark):
    rows = mapped(
        spark, "remotive",
        {"jobs": [
            {"id": 1, "title": "R &amp; D", "company_name": "A&#39;s ", "publication_date": "2026-10-01T00:00:00", "candidate_required_location": ""},
            {"id": 0, "title": "x"}, {"id": 2, "title": ""}, {"id": 3, "title": "Y", "publication_date": "yesterday-ish", "url": "https://r/3"},
        ]},
    )
    assert [r["reject_reason"] for r in rows] == [None, "no-id", "no-title", None]
    assert (rows[0]["title"], rows[0]["company"], rows[0]["location"], rows[0]["url"]) == ("R & D", "A's", None, "https://remotive.com/remote-jobs/1")
    assert (rows[3]["posted_date"], rows[3]["company"]) == (None, "Unknown")


def test_freehire(spark):
    rows = mapped(
        spark, "freehire",
        {"data": [
            {"public_slug": "p", "id": 8, "title": "R", "company": 777, "url": "https://f/8", "posted_at": "2026-10-01", "enrichment": {"salary_min": 10, "salary_max": 20, "salary_currency": "EUR", "seniority": "senior"}, "skills": ["go"], "description": "<p>a</p>"},
            {"id": 9, "title": "S", "url": "https://f/9", "enrichment": {}}, {"title": " ", "url": "x"}, {"title": "T"},
        ]},
    )
    assert [r["reject_reason"] for r in rows] == [None, None, "no-title", "no-url"]
    assert (rows[0]["id"], rows[0]["company"], rows[0]["salary"], rows[0]["seniority"], rows[0]["description"]) == ("freehire:p", "777", "EUR 10–20", "senior", "a")
    assert (rows[1]["id"], rows[1]["salary"], rows[1]["company"], rows[1]["skills"]) == ("freehire:9", None, "Unknown", [])


def test_arbeitnow(spark):
    rows = mapped(
        spark, "arbeitnow",
        {"data": [{"slug": "a", "url": "https://a/1", "remote": True, "created_at": 1760000000}, {"slug": "b", "url": "https://a/2", "location": "Berlin", "created_at": "2026-10-01T01:00:00"}, {"url": "x"}, {"slug": "c", "url": "y", "created_at": "1760000000"}]},
    )
    assert [r["reject_reason"] for r in rows] == [None, None, "no-slug", None]
    assert (rows[3]["posted_date"], rows[3]["description"]) == (None, None)
    assert [(r["location"], r["posted_date"]) for r in rows[:2]] == [("Remote", dt.date(2025, 10, 9)), ("Berlin", dt.date(2026, 10, 1))]


def test_unstop(spark):
    item = {"id": 7, "title": 12345, "location": 99, "start_date": "soon"}
    rows = mapped(spark, "unstop", {"data": {"data": [item]}}, {"opportunities": [{"id": 8, "name": "N", "locations": ["X", "Y"], "organisation": {"name": "Org "}}]}, {"surprise": [1]})
    assert rows[2]["reject_reason"].startswith("no list at")
    assert [(r["title"], r["location"], r["company"], r["url"]) for r in rows[:2]] == [
        ("12345", "99", "Unstop", "https://unstop.com/o/7"), ("N", "X", "Org", "https://unstop.com/o/8"),
    ]


RSS = """<rss xmlns:dc="x"><channel><title>Feed</title>
<item><title>Acme: Senior Dev</title><link>https://w/1</link><guid>g1</guid><pubDate>Mon, 05 Oct 2026 10:00:00 +0000</pubDate></item>
<item><title>Dev</title><dc:creator>Beta</dc:creator><location>EU</location><link>https://w/2</link></item>
<item><title>Only: </title><link>https://w/3</link></item>
<item><title>No link</title></item></channel></rss>"""


def test_wwr(spark, tmp_path):
    rows = mapped(spark, "weworkremotely", RSS)
    want = [("weworkremotely:g1", "Senior Dev", "Acme", None), ("weworkremotely:https://w/2", "Dev", "Beta", "EU"), ("weworkremotely:https://w/3", "Only:", "Unknown", None)]
    assert [(r["id"], r["title"], r["company"], r["location"]) for r in rows[:3]] == want
    assert rows[3]["reject_reason"] == "no-link" and rows[0]["posted_date"] == dt.date(2026, 10, 5)
    (tmp_path / "feed.xml").write_text(RSS)
    good, bad = feeds.read_wwr_rss(spark, str(tmp_path))
    assert sorted((r.id, r.title, r.company, r.location) for r in good.collect()) == sorted(want)
    assert bad.count() == 1


def test_read_feed_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "position": "A", "slug": "a"}, {"legal": "x"}]))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = feeds.read_remoteok(spark, str(tmp_path))
    assert [r.title for r in good.collect()] == ["A"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["document is not valid JSON", "no-id"]
    notes = feeds.payload_notes(feeds.read_payloads(spark, str(tmp_path)), "remoteok")
    assert sorted((r.ok, r.rows) for r in notes.collect()) == [(False, 0), (True, 2)]


def test_jsonld(spark):
    def script(o):
        return f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>'

    post = {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "O"}, "datePosted": "2026-01-01", "description": "<p>d</p>", "baseSalary": {"currency": "USD", "value": {"minValue": 1, "maxValue": 2}}}
    html = [script("{bad") + script({"@type": "Organization"}) + script(post) + script(dict(post, title="second")), "<title>x</title>"]
    got = feeds.extract_jsonld(spark.createDataFrame([(h,) for h in html], "html string")).collect()
    assert tuple(got[0].posting) == ("T", "O", "2026-01-01", "USD1 - USD2", "d")
    assert got[1].posting is None


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("company,board,slug,region,category\nAcme,lever,acme,,\nBeta,workday,beta/Ext/5,global,gcc\n")
    reg = tables.read_registry(spark, str(tmp_path / "r.csv"))
    assert [(r.company, r.region, r.category) for r in reg.collect()] == [("Acme", "india", "startup"), ("Beta", "global", "gcc")]
    assert [r.company for r in tables.resolve_targets(reg, company="ACME").collect()] == ["Acme"]
    assert [r.company for r in tables.resolve_targets(reg, board="workday", region="global").collect()] == ["Beta"]
    bad = spark.createDataFrame([("A", "levr", "a", None, None)], tables.REGISTRY_SCHEMA)
    with pytest.raises(Exception, match="unknown board: levr"):
        tables.check_registry(bad).collect()


def test_seen_json(spark):
    good, bad = tables.parse_seen(
        payloads(
            spark,
            {"schemaVersion": 1, "seen": {"k1": {"title": "A", "rank_score": 50, "mine": {"x": 1}, "rank_history": [{"score": 4, "verdict": "v", "date": "d"}], "deadline": "ASAP"}, "k2": "oops"}},
            {"k3": {"title": "B", "gaps": ["g"]}, "k4": 5},
        )
    )
    rows = {r.key: r for r in good.collect()}
    assert rows["k1"].rank_score == 50 and rows["k1"].extra == {"mine": '{"x":1}'} and rows["k1"].deadline == "ASAP"
    assert rows["k1"].rank_history[0].score == 4 and rows["k3"].gaps == ["g"]
    assert {r.key for r in bad.collect()} == {"k2", "k4"}
    assert tables.first_bad_keys(bad, 1).count() == 1


def test_tracker_legacy_header(spark, tmp_path):
    cols = vocab.TRACKER_COLUMNS[:-1]
    (tmp_path / "t.csv").write_text(",".join(cols) + "\n" + ",".join(["2026-01-01", '"Acme, Inc"'] + ["x"] * 11) + "\n")
    t = tables.read_tracker(spark, str(tmp_path / "t.csv"))
    assert t.columns == list(vocab.TRACKER_COLUMNS)
    assert (t.first().company, t.first().deadline) == ("Acme, Inc", None)


def sheet(spark, *rows):
    cells = [("s", r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "sheet string, row long, col int, value string")


def test_unpivot_salary(spark):
    df = sheet(
        spark,
        ["Responses by employer, 1234 answers"], [],
        ["Employer", "City", "Dev count", "Dev index", "Head count", "Employee ID", "Bonus 2025", "Notes"],
        ["Acme", "Pune", "12", "101,5", "7.0", "99", "1.234", "hello"], ["", "x", "1", "1", "1", "1", "1", "1"], ["Beta", None, "n/a", "", "3", "1", "5", "6"],
    )
    got = {(r.company, r.city, r.category): (r["count"], r["index"]) for r in tables.unpivot_salary(df).collect()}
    assert got == {
        ("Acme", "Pune", "dev"): (12.0, 101.5), ("Acme", "Pune", "head_count"): (7.0, None),
        ("Beta", "", "head_count"): (3.0, None), ("Beta", "", "bonus_2025"): (None, 5.0), ("Beta", "", "notes"): (None, 6.0),
    }


def test_unpivot_falls_back_to_any_company_cell(spark):
    df = sheet(spark, ["Title"], ["Company", "Base pay 2025"], ["Acme", "10"])
    assert [(r.company, r.category, r["index"]) for r in tables.unpivot_salary(df).collect()] == [("Acme", "base_pay_2025", 10.0)]
    assert tables.unpivot_salary(sheet(spark, ["a", "b"], ["c", "d"])).count() == 0


@pytest.mark.parametrize("bound", [100_000, 0])
def test_unpivot_never_hands_out_the_cells(spark, monkeypatch, bound):
    """Few headers go to every task, many meet the cells in a shuffle; the cells themselves stay dealt out."""
    monkeypatch.setattr(tables, "BROADCAST_ROLES", bound, raising=False)
    n = F.col("id")
    values = F.array(F.concat(F.lit("c"), n), n.cast("string"))
    cells = spark.range(3000).select((n % 3).cast("string").alias("sheet"), (n + 20).alias("row"), F.posexplode(values).alias("col", "value"))
    heads = F.array(F.lit("Company"), F.lit("Pay"))
    heads = spark.range(3).select(n.cast("string").alias("sheet"), F.lit(1).cast("long").alias("row"), F.posexplode(heads).alias("col", "value"))
    out = tables.unpivot_salary(cells.union(heads))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (bound > 0)
    assert out.count() == 3000
    assert out.agg(F.sum("index")).first()[0] == sum(range(3000))


def test_companies_without_figures_and_late_headers(spark):
    df = sheet(spark, *[["note"]] * 10, ["Company", "City", "Pay"], ["Acme", "Pune", "n/a"], ["Beta", "", "10"], ["Gamma"])
    got = sorted((r.company, r.city, r.category, r["index"]) for r in tables.unpivot_salary(df, depth=11).collect())
    assert got == [("Acme", "Pune", None, None), ("Beta", "", "pay", 10.0), ("Gamma", "", None, None)]
    assert tables.unpivot_salary(df).count() == 0
    assert [tuple(r) for r in tables.sheet_issues(df).collect()] == [("s", "no header in the first 10 rows")]
    assert tables.sheet_issues(df, depth=11).count() == 0
    bare = sheet(spark, ["Company", "City"], ["Acme", "Pune"])
    assert [(r.company, r.category) for r in tables.unpivot_salary(bare).collect()] == [("Acme", None)]
    assert [tuple(r) for r in tables.sheet_issues(bare).collect()] == [("s", "no salary data columns")]


def test_salary_data(spark):
    p = payloads(spark, {"metadata": {"index_baseline": 50}, "companies": [{"company": "A", "city": "P", "categories": {"eng": {"count": 3, "index": "12.5"}, "ops": {"index": 7}}}]})
    got = sorted((r.category, r["count"], r["index"], r.baseline) for r in tables.parse_salary_data(p).collect())
    assert got == [("eng", 3.0, "12.5", 50.0), ("ops", None, "7", 50.0)]
    bad = payloads(spark, {"companies": [{"company": ""}, 5, {"company": "A", "city": 3, "categories": {"e": 1, "f": {"count": "x"}, "g": {"index": [1]}}}]})
    errors = sorted((r.pos, r.error) for r in tables.salary_issues(bad).collect())
    assert errors == [
        (0, "company must be a non-empty string"), (1, "entry must be an object"), (2, "categories.e must be an object"),
        (2, "categories.f.count must be a number"), (2, "categories.g.index must be a number or string"), (2, "city must be a string when provided"),
    ]


def test_batch_refs_and_scores(spark):
    good, bad = tables.parse_batch_refs(payloads(spark, [{"ref": "https://x", "description": "d"}, {"ref": " "}, 5, {"description": "e"}]))
    assert [(r.ref, r.description) for r in good.collect()] == [("https://x", "d")]
    assert [r.ref for r in bad.orderBy("entry_no").collect()] == [" ", "entry#2", "entry#3"]
    good, bad = tables.parse_scores(payloads(spark, {"results": [{"key": "k", "scores": {"technical": 5, "experience": "6"}, "language_gate": "FAIL"}, "x", {"key": "m", "scores": [1]}, {"key": "n"}]}))
    rows = {r.key: r for r in good.collect()}
    assert rows["k"].scores.technical == 5.0 and rows["k"].scores.experience is None and rows["n"].scores.technical is None
    assert {r.key: r.error for r in bad.collect()} == {"results[1]": "scoring object must be an object, got string", "m": "scores must be an object, got array"}


def test_seen_sink_swaps_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("a", "new"), ("b", "ranked")], "key string, status string")
    sinks.write_seen(one, root, 1)
    sinks.write_seen(sinks.read_seen(spark, root).filter("key = 'a'"), root, 2)
    sinks.write_seen(one.filter("key = 'a'"), root, 2)
    assert [r.key for r in sinks.read_seen(spark, root).collect()] == ["a"]
    assert sinks.read_seen(spark, root, 1).count() == 2
    # Written but never named by the ledger: not current.
    one.write.parquet(f"{root}/data/version=3")
    assert sinks.current_version(spark, root) == 2


def test_render(spark):
    df = spark.createDataFrame([("1", "A|B\nC", "Co", None, None, "u", "p", "adapter")], "id string, title string, company string, location string, posted_date date, url string, portal string, source string")
    line = lambda fmt: sinks.render(df, fmt).first().line
    assert line("table") == "A\\|B C | Co | unspecified | undated | u"
    assert line("plain") == "A|B\nC — Co (unspecified, undated)\nu"
    assert json.loads(line("json"))["location"] is None
    with pytest.raises(ValueError):
        sinks.render(df, "yaml")


def test_contract(spark):
    rows = schemas.contract_df(spark)
    assert rows.filter("shape = 'tracker'").count() == 14
    df = spark.createDataFrame([("1", "t", "c", "u", "p", "adapter")], "id string, title string, company string, url string, portal string, source string")
    assert schemas.conform(df, "posting").columns == [f.name for f in schemas.POSTING]
    with pytest.raises(ValueError, match="url: missing"):
        schemas.conform(df.drop("url"), "posting")
    with pytest.raises(ValueError, match="title: int, not string"):
        schemas.conform(df.withColumn("title", F.lit(1)), "posting")


def test_envelope_count(spark):
    p = payloads(spark, {"meta": {"count": 1}, "results": [1]}, {"meta": {"count": 2}, "results": [1]}, {"results": []})
    assert feeds.envelope_issues(p).count() == 2


def test_scratch_goes_to_the_named_folder(spark):
    from rolebook.session import scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(named + "/x-")
