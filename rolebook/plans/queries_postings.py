"""Registered queries: scalars, filters, pools, limits over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions import dates, names, text, urls
from rolebook.operators import dedupe, filters
from rolebook.plans import bindings as B
from rolebook.plans.registry import query

# SQL twins of the URL scalars, as expressions over a column ``url``.
SQL_AUTH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+', 0))"
SQL_PATH = (
    "CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' "
    "ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END"
)
SQL_QUERY = (
    "array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '\\?([^#]*)', 1), ''), '&'), "
    "lambda p: p <> '' AND NOT list_contains(['" + "','".join(vocab.TRACKING_PARAMS) + "'], split_part(p, '=', 1))), '&')"
)
SQL_NORM = (
    f"regexp_replace({SQL_AUTH} || {SQL_PATH} || CASE WHEN {SQL_QUERY} <> '' THEN '?' || {SQL_QUERY} ELSE '' END, '/$', '')"
)
SQL_REQ = (
    "(SELECT lower(regexp_extract(seg, '(?i)[0-9a-f-]{8,}', 0)) FROM (SELECT unnest(string_split("
    + SQL_PATH
    + ", '/')) AS seg, generate_subscripts(string_split("
    + SQL_PATH
    + ", '/'), 1) AS i) WHERE NOT regexp_matches(seg, '\\d{4}-\\d{2}-\\d{2}') AND regexp_matches(seg, '(?i)[0-9a-f-]{8,}') "
    "AND NOT regexp_matches(regexp_extract(seg, '(?i)[0-9a-f-]{8,}', 0), "
    "'^(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])$') ORDER BY i LIMIT 1)"
)


@query("normalize_url", f"WITH {B.PG2_SQL} SELECT id, {SQL_NORM} AS norm_url FROM pg2")
def normalize_url(spark, sf):
    pages = B.page_postings(spark, sf)
    both = dedupe.union_pools(pages, B.mirror_postings(pages))
    return both.select("id", urls.normalize_url("url").alias("norm_url"))


@query(
    "dedupe_key",
    f"""WITH {B.DOC_SQL}, k AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '' ELSE url END AS u FROM doc)
SELECT id, CASE WHEN u <> '' THEN regexp_replace(u, '/$', '')
  ELSE lower(trim(company)) || '|' || lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || '|' || lower(coalesce(location, '')) END AS dedupe_key
FROM k""",
)
def dedupe_key(spark, sf):
    d = B.doc_postings(spark, sf).withColumn("url", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("url")))
    return dedupe.with_dedupe_key(d).select("id", "dedupe_key")


@query(
    "req_id",
    f"WITH {B.DOC_SQL}, {B.PG_SQL}, u AS (SELECT id, url FROM doc UNION ALL SELECT id, url FROM pg) "
    f"SELECT id, {SQL_REQ} AS req FROM u",
)
def req_id(spark, sf):
    d = B.doc_postings(spark, sf).select("id", "url").union(B.page_postings(spark, sf).select("id", "url"))
    return d.select("id", urls.req_id("url").alias("req"))


@query(
    "norm_key",
    f"""WITH {B.TRK_SQL} SELECT regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS company_key,
  regexp_replace(lower(role), '[^a-z0-9]', '', 'g') AS role_key, count(*) AS n FROM trk GROUP BY 1, 2""",
)
def norm_key(spark, sf):
    t = B.tracker(spark, sf)
    return t.groupBy(text.norm_key("company").alias("company_key"), text.norm_key("role").alias("role_key")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "iso_dates",
    f"""WITH {B.TRK_SQL} SELECT application_id,
  CAST(try_cast(CASE WHEN regexp_matches(deadline, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN deadline END AS DATE) AS VARCHAR) AS strict,
  CAST(try_cast(substr(deadline || 'T10:00:00Z', 1, 10) AS DATE) AS VARCHAR) AS lead_date FROM trk""",
)
def iso_dates(spark, sf):
    t = B.tracker(spark, sf)
    return t.select(
        "application_id",
        dates.strict_iso("deadline").cast("string").alias("strict"),
        dates.iso_date(F.concat("deadline", F.lit("T10:00:00Z"))).cast("string").alias("lead_date"),
    )


@query(
    "lenient_date",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS rfc, "
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS named, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso FROM orders",
)
def lenient_date(spark, sf):
    o = B.text_table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    return o.select(
        "o_orderkey",
        dates.lenient_date(F.concat(F.date_format(d, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).cast("string").alias("rfc"),
        dates.lenient_date(F.date_format(d, "MMMM d, yyyy")).cast("string").alias("named"),
        dates.lenient_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("string").alias("iso"),
    )


@query(
    "relative_date",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(DATE '2024-04-30' - CAST(o_orderkey % 40 AS INTEGER) AS VARCHAR) "
    "WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS posted FROM orders",
)
def relative_date(spark, sf):
    o = B.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("Posted "), k % 40, F.lit(" Days Ago")))
        .when(k % 4 == 1, F.col("o_orderdate").cast("date").cast("string"))
        .when(k % 4 == 2, F.lit("Posted 30+ Days Ago"))
        .otherwise(F.lit("Posted Today"))
    )
    return o.select("o_orderkey", dates.relative_date(raw, B.AS_OF).cast("string").alias("posted"))


@query(
    "epoch_dates",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS from_seconds, CAST(CAST(ts AS DATE) AS VARCHAR) AS from_millis, "
    "CAST(CAST(ts AS DATE) AS VARCHAR) AS from_either FROM events",
)
def epoch_dates(spark, sf):
    e = B.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    sec = F.unix_timestamp(ts)
    either = F.when(F.col("event_id") % 2 == 0, sec.cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select(
        "event_id",
        dates.epoch_date(sec).cast("string").alias("from_seconds"),
        dates.epoch_date(sec * 1000, "ms").cast("string").alias("from_millis"),
        dates.epoch_or_iso_date(either).cast("string").alias("from_either"),
    )


@query(
    "age_and_staleness",
    f"""WITH {B.DOC_SQL}, a AS (SELECT id, DATE '2024-04-30' - posted_date AS age FROM doc)
SELECT id, CAST(age AS INTEGER) AS age, coalesce(age > 30, true) AS stale_or_undated, coalesce(age > 30, false) AS stale FROM a""",
)
def age_and_staleness(spark, sf):
    d = B.doc_postings(spark, sf)
    return d.select(
        "id",
        dates.age_days("posted_date", B.AS_OF).alias("age"),
        dates.is_stale("posted_date", 30, B.AS_OF).alias("stale_or_undated"),
        dates.is_stale("posted_date", 30, B.AS_OF, flag_undated=False).alias("stale"),
    )


SQL_DECODE = "h"
for _entity, _char in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    SQL_DECODE = f"replace({SQL_DECODE}, '{_entity}', '{_char}')"


@query(
    "strip_html",
    f"""WITH p AS (SELECT page_id, html AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQL_DECODE},
  '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body
FROM p""",
)
def strip_html(spark, sf):
    return B.text_table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("body"))


@query(
    "html_to_text",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)</div>', chr(10), 'g'), '(?i)</li>', chr(10), 'g'),
  '(?i)<li[^>]*>', '• ', 'g'), '(?i)<h[1-6][^>]*>(.*?)</h[1-6]>', chr(10) || chr(10) || '\\1' || chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(
  replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), chr(10)), lambda l: rtrim(l)), chr(10)),
  '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS body FROM p""",
)
def html_to_text(spark, sf):
    return B.text_table(spark, sf, "pages").select("page_id", text.html_to_text("html").alias("body"))


@query(
    "html_to_prose",
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<\\s*br\\s*/?>', chr(10), 'g'),
  '(?i)</(?:p|li|ul|ol|div|h\\d)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), '') AS body FROM p""",
)
def html_to_prose(spark, sf):
    return B.text_table(spark, sf, "pages").select("page_id", text.html_to_prose("html").alias("body"))


@query(
    "detect_board",
    """WITH u AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '/([a-z][a-z])/', 1) AS lang FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'smartrecruiters'
   WHEN 4 THEN 'amazon' ELSE 'unknown' END AS board,
  CASE k WHEN 0 THEN 'co' || page_id WHEN 1 THEN 'co' || page_id WHEN 2 THEN 't' || page_id || '/site' || page_id || '/' ||
     CASE WHEN page_id % 4 = 0 THEN '5' ELSE '3' END END AS slug FROM u""",
)
def detect_board(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select("page_id", urls.detect_board(board_url()).alias("b")).select("page_id", "b.board", "b.slug")


def board_url():
    """A careers URL of one of the boards for each page."""
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    inst = F.when(F.col("page_id") % 4 == 0, ".wd5").otherwise("")
    return (
        F.when(k == 0, F.concat(F.lit("https://Boards.Greenhouse.io/co"), n, F.lit("/jobs/"), n, F.lit("77?x=1")))
        .when(k == 1, F.concat(F.lit("https://jobs.lever.co/co"), n, F.lit("/abc-"), n))
        .when(k == 2, F.concat(F.lit("https://t"), n, inst, F.lit(".myworkdayjobs.com/en-US/site"), n, F.lit("/job/X_"), n))
        .when(k == 3, F.concat(F.lit("https://jobs.smartrecruiters.com/Co"), n, F.lit("/74400000"), n))
        .when(k == 4, F.concat(F.lit("https://www.amazon.jobs/en/jobs/26"), F.lpad(n, 6, "0")))
        .otherwise(F.col("url"))
    )


@query(
    "parse_ref",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'smartrecruiters'
   WHEN 4 THEN 'amazon' ELSE 'unknown' END AS board,
  CASE page_id % 6 WHEN 0 THEN '1' WHEN 1 THEN 'abc-' || page_id WHEN 2 THEN '/job/X_' || page_id
     WHEN 3 THEN '74400000' || page_id WHEN 4 THEN '26' || lpad(CAST(page_id AS VARCHAR), 6, '0') END AS posting_id FROM pages""",
)
def parse_ref(spark, sf):
    p = B.table(spark, sf, "pages")
    return urls.with_ref(p.select("page_id", board_url().alias("url"))).select("page_id", "board", "posting_id")


@query(
    "canon_location",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bengaluru, in' WHEN 1 THEN 'navi mumbai' WHEN 2 THEN 'delhi ncr'
  WHEN 3 THEN 'gurugram / bengaluru' ELSE lang END AS place FROM documents""",
)
def canon_location(spark, sf):
    d = B.table(spark, sf, "documents")
    raw = B.choose(
        F.col("doc_id") % 5,
        {0: "Bangalore, IN", 1: "Navi Bombay", 2: "New Delhi NCR", 3: "Gurgaon / Bangalore"},
    )
    return d.select("doc_id", text.canon_location(F.coalesce(raw, "lang")).alias("place"))


@query(
    "company_names",
    f"""WITH {B.CO_SQL} SELECT DISTINCT company,
  regexp_replace(regexp_replace(lower(company), '\\bpvt\\.?\\s*ltd\\.?\\b|\\btechnologies\\b|\\(.*?\\)|\\bindia\\b|\\bholding\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS company_key,
  array_to_string(regexp_extract_all(regexp_replace(lower(company), '\\bpvt\\.?\\s*ltd\\.?\\b|\\btechnologies\\b|\\(.*?\\)|\\bindia\\b|\\bholding\\b', '', 'g'), '[a-z0-9]{{2,}}'), ' ') AS words
FROM co""",
)
def company_names(spark, sf):
    co = B.companies(spark, sf).select("company").distinct()
    return co.select("company", names.company_key("company").alias("company_key"), F.array_join(names.core_words("company"), " ").alias("words"))


@query(
    "anglicize",
    "SELECT doc_id, replace(replace(replace(replace(replace(replace(lower(text), 'ø', 'o'), 'æ', 'ae'), 'å', 'aa'), 'ö', 'o'), 'ä', 'ae'), 'ü', 'u') AS plain FROM documents",
)
def anglicize(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", names.anglicize("text").alias("plain"))


@query(
    "token_sets",
    f"""WITH {B.DOC_SQL} SELECT id,
  len(regexp_extract_all(lower(description), '[a-z0-9+#.]{{3,}}')) AS score_words,
  len(list_distinct(regexp_extract_all(lower(description), '[a-z0-9+#.]{{4,}}'))) AS pack_words FROM doc""",
)
def token_sets(spark, sf):
    d = B.doc_postings(spark, sf)
    return d.select(
        "id",
        F.size(text.score_tokens("description")).cast("bigint").alias("score_words"),
        F.size(F.array_distinct(text.pack_tokens("description"))).cast("bigint").alias("pack_words"),
    )


@query(
    "canon_status",
    f"""WITH {B.TRK_SQL}, s AS (SELECT replace(status, ' ', '_') AS status FROM trk)
SELECT status, status NOT IN ('hired','rejected','no_response','offer_declined','withdrawn') AS open, count(*) AS n FROM s GROUP BY 1, 2""",
)
def canon_status(spark, sf):
    t = B.tracker(spark, sf).withColumn("status", text.canon_status(F.upper("status")))
    return t.groupBy("status", text.is_open(F.col("status")).alias("open")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "error_info",
    """WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'FETCH_ERROR' WHEN 'view' THEN 'detail-failed'
   WHEN 'click' THEN 'NOT_FOUND' ELSE 'made_up' END AS c FROM events)
SELECT lower(replace(c, '_', '-')) AS code, c <> 'made_up' AS known, c IN ('FETCH_ERROR', 'detail-failed') AS retryable, count(*) AS n
FROM e GROUP BY 1, 2, 3""",
)
def error_info(spark, sf):
    e = B.table(spark, sf, "events")
    code = B.choose(F.col("event_type"), {"error": "FETCH_ERROR", "view": "detail-failed", "click": "NOT_FOUND"}, "made_up")
    return e.select(text.error_info(code).alias("e")).groupBy("e.code", "e.known", "e.retryable").agg(F.count(F.lit(1)).alias("n"))


# --- filters -------------------------------------------------------------------


@query(
    "stage_filter",
    f"""WITH {B.PG_SQL} SELECT id, location FROM pg WHERE lower(location) LIKE '%en%'
  AND coalesce(DATE '2024-04-30' - posted_date <= 21, true)""",
)
def stage_filter(spark, sf):
    p = B.page_postings(spark, sf)
    return filters.stage_filter(p, B.AS_OF, location="EN", stage="experienced", max_age=21).select("id", "location")


@query(
    "stage_filter_interns",
    f"""WITH {B.DOC_SQL}, t AS (SELECT * REPLACE (title || CASE doc_id % 6 WHEN 0 THEN ' Intern' WHEN 1 THEN ' (TRAINEE)' ELSE '' END AS title) FROM doc)
SELECT id, title FROM t WHERE regexp_matches(lower(title), 'intern|trainee|apprentice')
  AND coalesce(DATE '2024-04-30' - posted_date <= 40, true)""",
)
def stage_filter_interns(spark, sf):
    d = B.doc_postings(spark, sf)
    mark = B.choose(F.col("doc_id") % 6, {0: " Intern", 1: " (TRAINEE)"}, "")
    d = d.withColumn("title", F.concat("title", mark))
    return filters.stage_filter(d, B.AS_OF, stage="student", max_age=40).select("id", "title")


@query("stage_filter_remote", f"WITH {B.DOC_SQL} SELECT id FROM doc WHERE lower(location) LIKE '%remote%'")
def stage_filter_remote(spark, sf):
    return filters.stage_filter(B.doc_postings(spark, sf), B.AS_OF, stage="remote-global").select("id")


@query(
    "match_phrase",
    f"""WITH {B.DOC_SQL} SELECT id FROM doc WHERE contains(lower(title || ' ' || coalesce(location, '')), 'the')""",
)
def match_phrase(spark, sf):
    return filters.match_phrase(B.doc_postings(spark, sf), "The", filters.PHRASE_COLUMNS["greenhouse"]).select("id")


@query(
    "match_any_column",
    f"""WITH {B.DOC_SQL} SELECT id FROM doc WHERE contains(lower(title), 'batch') OR contains(lower(company), 'batch')
  OR contains(lower(description), 'batch') OR lang = 'batch'""",
)
def match_any_column(spark, sf):
    d = B.doc_postings(spark, sf).withColumn("tags", F.array("lang"))
    return filters.match_any_column(d, "Batch", ["title", "company", "description"], "tags").select("id")


@query(
    "match_all_words",
    f"""WITH {B.DOC_SQL}, h AS (SELECT id, lower(title || ' ' || company || ' ' || coalesce(location, '') || ' ' || lang || ' ' || description) AS hay FROM doc)
SELECT id FROM h WHERE contains(hay, 'remote') AND contains(hay, 'stipend')""",
)
def match_all_words(spark, sf):
    d = B.doc_postings(spark, sf).withColumn("tags", F.array("lang"))
    cols = ["title", "company", "location", "description"]
    return filters.match_all_words(d, " Remote  STIPEND ", cols, "tags").select("id")


@query("match_tag", f"WITH {B.DOC_SQL} SELECT id FROM doc WHERE contains(lang, 'e') OR contains(company, 'e')")
def match_tag(spark, sf):
    d = B.doc_postings(spark, sf).withColumn("tags", F.array("lang", "company"))
    return filters.match_tag(d, " E ").select("id")


@query("match_category", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
def match_category(spark, sf):
    return filters.match_category(B.table(spark, sf, "orders"), "not-specified", "o_orderpriority").select("o_orderkey")


@query("match_location", f"WITH {B.PG_SQL} SELECT id FROM pg WHERE location IS NULL OR contains(location, 'fr')")
def match_location(spark, sf):
    return filters.match_location(B.page_postings(spark, sf), "FR").select("id")


@query("match_location_stated", f"WITH {B.DOC_SQL} SELECT id FROM doc WHERE contains(lower(location), 'mumbai')")
def match_location_stated(spark, sf):
    return filters.match_location(B.doc_postings(spark, sf), "Mumbai", policy="remotive").select("id")


@query(
    "min_salary_max_age",
    f"""SELECT p_partkey FROM part WHERE (p_partkey % 20 = 0 OR p_retailprice >= 1000 OR p_partkey % 17 = 0)
  AND coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 200 END <= 60, true)""",
)
def min_salary_max_age(spark, sf):
    s = B.table(spark, sf, "part")
    k = F.col("p_partkey")
    s = s.select(
        "p_partkey",
        F.when(k % 20 == 0, F.lit(None))
        .when(k % 17 == 0, F.lit("from 5k a month"))
        .otherwise(F.format_string("$%,.0f / year", F.floor("p_retailprice").cast("double")))
        .alias("salary"),
        F.when(k % 9 != 0, B.days_before(k % 200)).alias("posted_date"),
    )
    return filters.max_age(filters.min_salary(s, 1000), 60, B.AS_OF).select("p_partkey")


RULES_SQL = """CASE WHEN location IS NULL THEN 'no-location' WHEN title = '' THEN 'no-title' WHEN description = '' THEN 'no-text' END"""


@query(
    "split_valid",
    f"WITH {B.DOC_SQL}, r AS (SELECT {RULES_SQL} AS reject_reason FROM doc) "
    "SELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS n FROM r GROUP BY 1",
)
def split_valid(spark, sf):
    rules = [
        ("no-location", F.col("location").isNotNull()),
        ("no-title", F.col("title") != ""),
        ("no-text", F.col("description") != ""),
    ]
    good, bad = filters.split_valid(B.doc_postings(spark, sf), rules)
    both = good.select(F.lit("valid").alias("outcome")).union(bad.select("reject_reason"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "facet_filter",
    f"""WITH {B.DOC_SQL} SELECT id FROM doc WHERE lang IN ('en', 'fr') AND location IN ('Remote', 'Mumbai')
  AND DATE '2024-04-30' - posted_date <= 14""",
)
def facet_filter(spark, sf):
    d = B.doc_postings(spark, sf).withColumns({"regions": F.array("lang"), "work_mode": F.col("location")})
    kept = filters.facet_filter(d, B.AS_OF, posted_within=14, regions=["en", "fr"], work_mode=["Remote", "Mumbai"])
    return kept.select("id")


ATS_WORDS_SQL = " + ".join(f"CAST(contains(l, '{w}') AS INTEGER)" for w in vocab.ATS_SECTION_WORDS)


@query(
    "text_hygiene",
    f"""WITH d AS (SELECT doc_id, text AS t, lower(text) AS l FROM documents), f AS (SELECT doc_id, list_filter([
    CASE WHEN length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) < 40 THEN 'too-short' END,
    CASE WHEN contains(t, chr(65533)) THEN 'replacement-chars' END,
    CASE WHEN regexp_matches(t, '\\(cid:\\d+\\)') THEN 'cid-markers' END,
    CASE WHEN regexp_matches(t, '\\\\item\\s*\\[') THEN 'leaked-item-bracket' END,
    CASE WHEN regexp_matches(t, '\\\\(cventry|makecvtitle|moderncvstyle|sectionstyle)\\b') THEN 'leaked-macro' END,
    CASE WHEN NOT regexp_matches(t, '{vocab.EMAIL}') THEN 'no-email' END,
    CASE WHEN NOT regexp_matches(t, '{vocab.PHONE}') THEN 'no-phone' END,
    CASE WHEN {ATS_WORDS_SQL} < 2 THEN 'few-sections' END], lambda x: x IS NOT NULL) AS issues FROM d)
SELECT doc_id, array_to_string(issues, ',') AS issues, len(issues) = 0 AS ok FROM f""",
)
def text_hygiene(spark, sf):
    d = filters.text_hygiene(B.text_table(spark, sf, "documents", "doc_id", "text"), min_chars=40)
    return d.select("doc_id", F.array_join("issues", ",").alias("issues"), "ok")
