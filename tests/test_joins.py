import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import companies as C
from rolebook.operators import filters, joins, robots
from rolebook.operators import scoring as S

# --- a plain pairwise matcher, to compare the joins with --------------------------


def forms(name):
    import re

    low = name.lower().strip()
    for p in vocab.COMPANY_NOISE:
        low = re.sub(p.replace("(?U)", ""), "", low)
    return re.sub("[^a-z0-9]", "", low), {w for w in re.findall("[a-z0-9]+", low) if len(w) > 1}


def pair_score(query, name):
    (q, qw), (n, nw) = forms(query), forms(name)
    if not q or not n:
        return 0
    if q == n:
        return 100
    shared = qw & nw
    if q in n and not (len(q) <= 4 and len(q) / len(n) < 0.5 and not shared):
        return 80 + int(10 * len(q) / len(n))
    if n in q and not (len(n) <= 4 and len(n) / len(q) < 0.5):
        return 80 + int(10 * len(n) / len(q))
    if n in q and shared:
        return 75
    if not shared:
        return 0
    return 70 if len(qw) == 1 else int(30 + 40 * len(shared) / len(qw))


def run_match(spark, queries, names, **kw):
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    c = spark.createDataFrame([(x, "Pune") for x in names], "company string, city string")
    return {(r.query, r.company): r.score for r in C.match_companies(q, c, **kw).collect()}


def test_company_match_cases(spark):
    got = run_match(spark, ["Acme", "Infosys", "Red Hat"], ["Acme Pvt Ltd", "acme", "Infosys BPM", "Red Hat India", "Hat Shop", "Zed"])
    assert got[("Acme", "Acme Pvt Ltd")] == 100 and got[("Acme", "acme")] == 100
    assert got[("Infosys", "Infosys BPM")] >= 80
    assert got[("Red Hat", "Red Hat India")] == 100
    assert got[("Red Hat", "Hat Shop")] == 50
    assert not any(name == "Zed" for _, name in got)


def test_company_match_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["red", "hat", "tata", "ibm", "go", "a", "systems", "data", "lab", "labs", "inc", "india", "3m", "x1", "techno", "technology"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", " Ltd", " (UK)", ", sub"]) for _ in range(120)})
    queries = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)})
    names += ["internationalbusinessmachines one", "internationalbusinessmachinestwo", "internationalbusinessXx", "theinternationalbusinessmachinestwoco"]
    queries += ["internationalbusinessmachines", "internationalbusinessmachinestwo", "internationalbusiness", "x"]
    want = {(q, n): s for q in queries for n in names if (s := pair_score(q, n)) >= 30}
    assert run_match(spark, queries, names) == want


def test_city_filter(spark):
    q = spark.createDataFrame([("Acme",)], "query string")
    c = spark.createDataFrame([("Acme", "Köln"), ("Acme", "Pune"), ("Acme", None)], "company string, city string")
    assert [r.city for r in C.match_companies(q, c, city="koln").collect()] == ["Köln"]


def test_exclude_tracked(spark):
    p = spark.createDataFrame([("k1", "Acme, Inc", "SDE II"), ("k2", "Acme", "SDE"), ("k3", "", "x")], "key string, company string, title string")
    t = spark.createDataFrame([("ACME INC", "sde-ii"), ("", "x")], "company string, role string")
    assert {r.key for r in joins.exclude_tracked(p, t).collect()} == {"k2", "k3"}
    assert {r.key for r in joins.mark_tracked(p, t).filter("tracked").collect()} == {"k1"}


def test_only_new(spark):
    p = spark.createDataFrame([("a",), ("b",)], "dedupe_key string")
    s = spark.createDataFrame([("a",), ("a",), ("c",)], "key string")
    assert [r.dedupe_key for r in joins.only_new(p, s).collect()] == ["b"]


def test_resolve_refs(spark):
    posts = spark.createDataFrame(
        [("123", "dev-1", "https://r.com/remote-jobs/dev-5123", 1), ("9", "x", "https://r.com/remote-jobs/x-77", 2), ("8", "y", "https://r.com/remote-jobs/y-77", 3)],
        "id string, slug string, url string, pos long",
    )
    refs = spark.createDataFrame([("123",), ("dev-1",), ("https://r.com/remote-jobs/y-77",), ("5123",), ("77",), ("zzz",)], "ref string")
    got = {r.ref: (r.posting_id, r.how) for r in joins.resolve_refs(refs, posts).collect()}
    assert got == {
        "123": ("123", "exact"), "dev-1": ("123", "exact"), "https://r.com/remote-jobs/y-77": ("8", "exact"),
        "5123": ("123", "tail"), "77": (None, None), "zzz": (None, None),
    }


def test_pair(spark):
    posts = spark.createDataFrame([(str(i), "Pune") for i in range(30)], "id string, location string")
    cands = [S.Candidate(f"c{i}", "student", (), ("Bangalore",)) for i in range(4)]
    out = joins.pair(posts, cands)
    assert out.count() == 120 and out.first().cand.accept == ["bengaluru"]


def test_candidate_reach_equals_gates(spark):
    places = ["Bangalore, IN", "Remote", None, "New Delhi / Gurgaon", "", "Greater Mumbai Metropolitan Region West"]
    wants = [[], ["Bengaluru"], ["remote", "Delhi"], ["gurugram", "delhi"], ["Paris"], [""], ["Greater Bombay Metropolitan Region"], ["mumbai metropolitan region east"]]
    day = dt.date(2026, 10, 10)
    posts = spark.createDataFrame(
        [(i, places[i % 6], None if i % 7 == 0 else day - dt.timedelta(days=i)) for i in range(60)], "id int, location string, posted_date date"
    )
    table = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(wants)], "candidate_id string, locations array<string>")
    got = {r.candidate_id: r.passed for r in joins.candidate_reach(posts, table, day).collect()}
    cands = [S.Candidate(f"c{i}", "student", (), tuple(w)) for i, w in enumerate(wants)]
    gated = S.gated(joins.pair(posts, cands), F.col("cand"), day, with_text=False)
    want = {r.candidate_id: r.n for r in gated.groupBy("cand.candidate_id").agg(F.count_if("pass").alias("n")).collect()}
    assert got == want


def test_cache_lookup(spark):
    day = dt.date
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "company string")
    cache = spark.createDataFrame(
        [("a", day(2026, 1, 1), "old"), ("a", day(2026, 1, 9), "new"), ("b", day(2025, 12, 1), "stale"), ("c", day(2026, 2, 1), "future")],
        "company string, fetched_date date, value string",
    )
    got = {r.company: (r.value, r.hit) for r in joins.cache_lookup(wanted, cache, "2026-01-10").collect()}
    assert got == {"a": ("new", True), "b": (None, False), "c": (None, False)}


def test_reconcile_and_ratchet(spark):
    e = spark.createDataFrame([("s", "t", 0.3), ("s", "u", 0.7), ("f", "t", 1.0)], "stage string, dim string, w double")
    a = spark.createDataFrame([("s", "t", 0.3 + 1e-12), ("s", "u", 0.6), ("x", "t", 1.0)], "stage string, dim string, w double")
    diffs = joins.reconcile(e, a, ["stage", "dim"], "w")
    assert {r.detail for r in diffs.collect()} == {"differs: s/u", "missing: f/t", "extra: x/t"}
    classed, patterns = joins.ratchet(diffs, ["differs: s", "gone"])
    assert {r.detail for r in classed.filter("known IS NULL").collect()} == {"missing: f/t", "extra: x/t"}
    assert {r.pattern: r.resolved for r in patterns.collect()} == {"differs: s": False, "gone": True}


def test_gap_sources(spark):
    t = spark.createDataFrame(
        [("Acme", "SDE", "80", dt.date(2026, 1, 1), 1, ["go"]), ("Beta", "Dev", "", dt.date(2026, 1, 1), 2, ["sql"])],
        "company string, role string, fit_rating string, date date, application_id long, inferred array<string>",
    )
    r = spark.createDataFrame([("k", "ACME", "sde", 60, ["rust"]), ("m", "Zeta", "x", 50, [])], "key string, company string, title string, rank_score int, gaps array<string>")
    got = {x.company: (x.gaps, x.provenance, x.tracked) for x in joins.merge_gap_sources(t, r).collect()}
    assert got == {"acme": (["rust"], "recorded", True), "beta": (["sql"], "inferred", True), "zeta": ([], "inferred", False)}


# --- crawl policies ---------------------------------------------------------------

POLICIES = [
    ("tie.com", 200, "User-agent: *\nDisallow: /a\nAllow: /a"),
    ("long.com", 200, "User-agent: *\nDisallow: /a\nAllow: /a/b"),
    ("wild.com", 200, "User-agent: *\nDisallow: /*.pdf$\nDisallow: /foo%20bar"),
    ("orphan.com", 200, "Disallow: /\nUser-agent: bot\nDisallow:"),
    ("html.com", 200, "<html>nope</html>"),
    ("none.com", 404, None),
    ("empty.com", 200, " \n"),
    ("err.com", 500, "User-agent: *"),
    ("stack.com", 200, "User-agent: bot\n\nUser-agent: *\nDisallow: /x # note\nUser-agent: other\nDisallow: /"),
    ("meta.com", 200, "User-agent: *\nDisallow: /a.b(c)\nDisallow: /q?x=1+1"),
]


@pytest.mark.parametrize("agent", ["*", "bot"])
def test_robots(spark, agent):
    cases = {
        "https://tie.com/a/x": "disallowed", "https://long.com/a/b/c": "allowed", "https://long.com/a/c": "disallowed",
        "https://wild.com/d/x.pdf": "disallowed", "https://wild.com/x.pdfs": "allowed", "https://wild.com/foo%20bar": "disallowed",
        "https://orphan.com/x": "allowed" if agent == "bot" else "disallowed",
        "https://html.com/": "unconfirmed", "https://none.com/": "allowed", "https://empty.com/z": "allowed",
        "https://err.com/": "unconfirmed", "https://unknown.com/": "unconfirmed",
        "https://stack.com/x/y": "disallowed", "https://stack.com/z": "allowed",
        "https://meta.com/a.b(c)": "disallowed", "https://meta.com/aXb(c)": "allowed", "https://meta.com/q?x=1+1": "disallowed",
    }
    urls = spark.createDataFrame([(u,) for u in cases], "url string")
    policies = spark.createDataFrame(POLICIES, "host string, http_status int, body string")
    got = {r.url: r.robots for r in robots.robots_filter(urls, policies, agents=(agent,)).collect()}
    assert got == cases


# --- filters ----------------------------------------------------------------------


def test_stage_filter_null_location_never_matches(spark):
    df = spark.createDataFrame(
        [("1", "SDE Intern", "Pune", None), ("2", "SDE", None, None), ("3", "Trainee", "Remote", dt.date(2026, 1, 1))],
        "id string, title string, location string, posted_date date",
    )
    ids = lambda **kw: [r.id for r in filters.stage_filter(df, "2026-03-01", **kw).collect()]
    assert ids(location="ul") == []
    assert ids(location="pun") == ["1"]
    assert ids(stage="remote-global") == ["3"]
    assert ids(stage="student") == ["1", "3"]
    assert ids(stage="student", kind="jobs") == ["1", "2", "3"]
    assert ids(max_age=30) == ["1", "2"]


def test_split_valid_is_a_partition(spark):
    df = spark.range(50).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id")))
    good, bad = filters.split_valid(df, [("no-x", F.col("x").isNotNull()), ("small", F.col("x") > 10)])
    assert good.count() + bad.count() == 50
    assert {r.reject_reason for r in bad.collect()} == {"no-x", "small"}


def test_location_policies(spark):
    df = spark.createDataFrame([("1", "Worldwide"), ("2", None), ("3", "Paris")], "id string, location string")
    ids = lambda *a, **k: [r.id for r in filters.match_location(df, *a, **k).collect()]
    assert ids("paris") == ["1", "2", "3"] and ids("rome") == ["1", "2"] and ids(" Any ") == ["1", "2", "3"]
    assert ids("paris", policy="remotive") == ["3"]


def test_words_and_phrases(spark):
    df = spark.createDataFrame([("1", "Go dev", "Acme", ["remote"]), ("2", "dev", None, [])], "id string, title string, company string, tags array<string>")
    ids = lambda out: [r.id for r in out.collect()]
    assert ids(filters.match_all_words(df, "remote GO", ["title", "company"], "tags")) == ["1"]
    assert ids(filters.match_all_words(df, " ", ["title"])) == ["1", "2"]
    assert ids(filters.match_phrase(df, "dev acme", ["title", "company"])) == ["1"]
    assert ids(filters.match_any_column(df, "dev acme", ["title", "company"])) == []


def test_text_hygiene(spark):
    good = "Jane jane@x.org +91 98765 43210 Experience Education Skills"
    cases = {
        good: [], good.replace("jane@x.org", ""): ["no-email"], good + " \\cventry{": ["leaked-macro"],
        good + " �": ["replacement-chars"], good + " (cid:12)": ["cid-markers"], good + " \\item [x": ["leaked-item-bracket"],
        "jane@x.org +91 98765 43210 Skills": ["few-sections"], "Experience Skills a@b.co": ["no-phone"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r.issues for r in filters.text_hygiene(df).collect()}
    assert got == cases
    needs = filters.text_hygiene(df, min_chars=40, required=["Jane  jane@x.org"])
    row = {r.text: r.issues for r in needs.collect()}
    assert row[good] == [] and "too-short" in row["Experience Skills a@b.co"]
    assert "missing: Jane jane@x.org" in row["Experience Skills a@b.co"]


@pytest.mark.parametrize("agents", [("*",), ("ClaimBot", "*"), ("other",)])
def test_robots_many_like_in_row(spark, agents):
    """Rules as a table give what rules in the row give, also on a host with thousands of them."""
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("abc/.?=%20*$") for _ in range(rng.randint(0, 5)))
    bodies = []
    for _ in range(25):
        lines = [rng.choice([f"User-agent: {rng.choice(['*', 'claimbot', 'other'])}", f"Disallow: /{part()}", f"Allow: /{part()}", f"Disallow: {part()}", "# x", "Disallow:"]) for _ in range(rng.randint(1, 14))]
        bodies.append("\n".join(lines))
    bodies += ["User-agent: *\n" + "\n".join(f"{'Allow' if i % 3 else 'Disallow'}: /p{i}{'*' if i % 5 == 0 else ''}" for i in range(3000)), "", "<html>"]
    hosts = [(f"H{i}.com", rng.choice([200, 200, 200, 404, 500]) if i < 25 else 200, b) for i, b in enumerate(bodies)]
    policies = spark.createDataFrame(hosts, "host string, http_status int, body string")
    urls = [(f"https://h{rng.randrange(30)}.com/{part()}{part()}",) for _ in range(300)] + [(f"https://h25.com/p{i}7/x",) for i in range(0, 600, 7)]
    df = spark.createDataFrame([*urls, urls[0], (None,), ("not a url",)], "url string")
    rows = lambda f: sorted((r.url or "", r.robots) for r in f(df, policies, agents).collect())
    assert rows(robots.robots_filter_many) == rows(robots.robots_filter)
