import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions import dates, money, names, text, urls
from rolebook.operators.scoring import canon_place

D = dt.date


def test_normalize_url(column):
    cases = {
        "https://x.com/jobs/abc-123?utm_source=x#frag": "https://x.com/jobs/abc-123",
        "https://x.com/jobs/abc-123": "https://x.com/jobs/abc-123",
        "HTTPS://X.com:443/Jobs/": "https://x.com/Jobs",
        "https://x.com/a?b=2&ref=q&a=1": "https://x.com/a?b=2&a=1",
        "https://x.com/a?page&source=z": "https://x.com/a?page=",
        "https://x.com?utm_term=1": "https://x.com",
        "Not A URL/#x": "not a url",
        "  ": "",
    }
    got = column(lambda d: urls.normalize_url("u"), [(u,) for u in cases], "u string")
    assert got == list(cases.values())


def test_dedupe_key(column):
    rows = [
        ("https://e.com/abc-123?utm_source=x#frag", "Example", "SDE", "Pune"),
        ("https://e.com/abc-123", "Example", "SDE", "Pune"),
        ("", "Example ", "SDE  Intern", "Bengaluru"),
        (None, "Example", "SDE", None),
    ]
    got = column(lambda d: urls.dedupe_key("u", "c", "t", "l"), rows, "u string, c string, t string, l string")
    assert got == ["https://e.com/abc-123", "https://e.com/abc-123", "example|sde intern|bengaluru", "example|sde|"]


def test_req_id(column):
    cases = {
        "https://x.com/jobs/9f8e7d6c5b4a?ref=x": "9f8e7d6c5b4a",
        "https://x.com/archive/2026-10-05/post-a": None,
        "https://x.com/20261005/ABCDEF0123": "abcdef0123",
        "https://x.com/jobs/1137796": None,
        "https://x.com/remote-jobs/global-lead-fuku-1137796": "-1137796",
        "jobs/12345678?x=87654321": "12345678",
    }
    got = column(lambda d: urls.req_id("u"), [(u,) for u in cases], "u string")
    assert got == list(cases.values())


def test_detect_board(column):
    rows = [
        ("https://boards.greenhouse.io/acme/jobs/1",), ("https://jobs.lever.co/acme",),
        ("https://acme.wd5.myworkdayjobs.com/en-US/Site/job/X",), ("https://acme.myworkdayjobs.com/Site",),
        ("https://www.amazon.jobs/en",), ("https://jobs.smartrecruiters.com/Acme",), ("acme",), ("https://x.com",),
    ]
    got = [tuple(r) for r in column(lambda d: urls.detect_board("u"), rows, "u string")]
    assert got == [
        ("greenhouse", "acme"), ("lever", "acme"), ("workday", "acme/Site/5"), ("workday", "acme/Site/3"),
        ("amazon", None), ("smartrecruiters", None), ("unknown", None), ("unknown", None),
    ]


def test_refs(column):
    got = column(lambda d: urls.numeric_ref("u", "remoteok"), [("https://remoteok.com/remote-jobs/dev-5123",), ("123",), ("abc",)], "u string")
    assert got == ["5123", "123", "abc"]
    got = column(lambda d: urls.freehire_slug("u"), [("https://freehire.me/jobs/abc-1?x=1",), ("abc-1",), ("a b",)], "u string")
    assert got == ["abc-1", "abc-1", None]
    got = column(
        lambda d: urls.workday_path("u", "s"),
        [("https://a.wd3.myworkdayjobs.com/en-US/Ext/job/X", "Ext"), ("job/X", "Ext"), ("/job/X", "Ext")], "u string, s string",
    )
    assert got == ["/job/X", "/job/X", "/job/X"]


def test_dates(column):
    got = column(lambda d: dates.iso_date("t"), [("2026-10-01T00:00:00Z",), ("soon",), (None,), ("2026-13-40",)], "t string")
    assert got == [D(2026, 10, 1), None, None, None]
    got = column(lambda d: dates.strict_iso("t"), [(" 2026-10-01 ",), ("ASAP",), ("2026-02-30",), ("2026-10-01T00:00",)], "t string")
    assert got == [D(2026, 10, 1), None, None, None]
    rows = [("Mon, 05 Oct 2026 10:00:00 +0000",), ("October 5, 2026",), ("2026-10-05T23:00:00Z",), ("5 Oct 2026",), ("nope",), ("Mon, 05 Oct 2026 10:00:00 GMT",)]
    got = column(lambda d: dates.lenient_date("t"), rows, "t string")
    assert got == [D(2026, 10, 5)] * 4 + [None, D(2026, 10, 5)]
    rows = [("Posted 5 Days Ago",), ("2026-01-02T00:00",), ("Posted 30+ Days Ago",), ("Posted Today",), (None,)]
    got = column(lambda d: dates.relative_date("t", "2026-10-10"), rows, "t string")
    assert got == [D(2026, 10, 5), D(2026, 1, 2), None, None, None]
    got = column(lambda d: dates.epoch_or_iso_date("t"), [("1760000000",), ("2026-10-05T01:02",), ("x",)], "t string")
    assert got == [D(2025, 10, 9), D(2026, 10, 5), None]
    got = column(lambda d: dates.epoch_date(F.col("n"), "ms"), [(1760000000000,), (-1,)], "n bigint")
    assert got == [D(2025, 10, 9), D(1969, 12, 31)]


def test_age_keeps_null_and_future(column):
    rows = [(D(2026, 1, 1),), (None,), (D(2026, 1, 12),)]
    assert column(lambda d: dates.age_days("p", "2026-01-10"), rows, "p date") == [9, None, -2]
    assert column(lambda d: dates.is_stale("p", 5, "2026-01-10"), rows, "p date") == [True, True, False]
    assert column(lambda d: dates.is_stale("p", 5, "2026-01-10", False), rows, "p date") == [True, False, False]


def test_strip_html(column):
    rows = [("&lt;div&gt;a&amp;nbsp;b&lt;/div&gt;",), ("<script>x<y</script>t &quot;q&quot;",), ("<p>a</p><p>b</p>",)]
    assert column(lambda d: text.strip_html("h"), rows, "h string") == ["a b", 't "q"', "a b"]


def test_html_to_text(column):
    rows = [
        ("<p>One<br/>two</p><ul><li>a</li><li>b</li></ul>",), ("<h2>Head</h2>x",), ("&#8364;5 &#x1F600; &#1114112;|",),
        ("a   \n\n\n\n\nb",), ("",), ("&#38;#39;",),
    ]
    got = column(lambda d: text.html_to_text("h"), rows, "h string")
    assert got == ["One\ntwo\n\n• a\n• b", "Head\nx", "€5 😀 |", "a\n\nb", "", "&#39;"]


def test_html_to_prose_blank_is_null(column):
    got = column(lambda d: text.html_to_prose("h"), [("<div>a  b</div><div>c</div>",), ("<p>a</p><p>b</p>",), ("<br> ",), (None,)], "h string")
    assert got == ["a b\nc", "a\nb", None, None]


def test_status(column):
    rows = [("No Response",), (" offer declined ",), ("applied",), ("ghosted",), (None,)]
    assert column(lambda d: text.canon_status("s"), rows, "s string") == ["no_response", "offer_declined", "applied", "ghosted", None]
    assert column(lambda d: text.is_open(F.col("s")), rows, "s string") == [False, False, True, True, True]


def test_location_aliases_agree(column):
    places = ["Bangalore", "Bangalore / Bangalore", "New Delhi", "Gurgaon, Bombay", "Pune"]
    got = column(lambda d: text.canon_location("p"), [(p,) for p in places], "p string")
    assert got == [canon_place(p) for p in places]
    assert got == ["bengaluru", "bengaluru / bangalore", "delhi", "gurugram, mumbai", "pune"]


def test_error_info(column):
    got = [tuple(r) for r in column(lambda d: text.error_info("c"), [("FETCH_ERROR",), ("missing-arg",), ("zzz",)], "c string")]
    assert got == [("fetch-error", True, True), ("missing-arg", True, False), ("zzz", False, False)]
    assert len({c[0] for c in vocab.ERROR_CODES}) == len(vocab.ERROR_CODES)


def test_money(column):
    rows = [(50000.0, 90000.0), (50000.0, 50000.0), (0.0, 90000.0), (50000.0, None), (0.0, 0.0), (None, None)]
    got = column(lambda d: money.format_salary("a", "b"), rows, "a double, b double")
    assert got == ["$50,000 - $90,000 / year", "$50,000 / year", "Up to $90,000 / year", "From $50,000 / year", None, None]
    got = column(lambda d: money.parse_salary("t"), [("$50,000 - 60,000",), ("80k",), ("great",), (",",)], "t string")
    assert got == [50000.0, 80000.0, None, None]
    rows = [("1.234,56",), ("1,234.56",), ("1,234",), ("12,5",), ("1 234",), ("n/a",), ("1.234",), ("7",), ("",), ("\u00a01\u00a0234,5\t",)]
    got = column(lambda d: money.parse_locale_number("t"), rows, "t string")
    assert got == [1234.56, 1234.56, None, 12.5, 1234.0, None, None, 7.0, None, 1234.5]


def test_half_up(column):
    rows = [(0.5,), (1.5,), (2.4999,), (-0.5,)]
    assert column(lambda d: money.half_up(F.col("x")), rows, "x double") == [1, 2, 2, 0]


def test_company_names(column):
    rows = [("Acme Pvt. Ltd.",), ("Acme Technologies (India), Mumbai",), ("Tata Group Holding",), ("Infosys LLP",), ("Ltdx Inc",)]
    assert column(lambda d: names.company_key("n"), rows, "n string") == ["acme", "acme", "tata", "infosys", "ltdx"]
    assert column(lambda d: names.core_words("n"), [("Red Hat Pvt Ltd",), ("A B",)], "n string") == [["red", "hat"], []]
    # A key holds only a-z0-9, so spelling it in English changes nothing.
    assert column(lambda d: names.anglicize(names.company_key("n")), [("Mølle",)], "n string") == ["mlle"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a=1", "ref=2", "utm_source=x", "b", "c=%20", "source=q"]), max_size=5), st.sampled_from(["", "/", "/x", "/x/"]))
def test_normalize_url_is_idempotent(column, params, path):
    url = "https://h.com" + path + ("?" + "&".join(params) if params else "")
    once = column(lambda d: urls.normalize_url("u"), [(url,)], "u string")[0]
    assert column(lambda d: urls.normalize_url("u"), [(once,)], "u string")[0] == once
    assert "utm_source" not in once and "ref=" not in once
