"""Registered queries: feeds, tables, sinks.

The landed payloads are built by Spark from the given tables, one document
per row, and read back through the feed mappers; the SQL twins state the
expected postings straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rolebook import schemas, vocab
from rolebook.functions import text as T
from rolebook.operators import dedupe, filters, limits
from rolebook.operators import reports as R
from rolebook.plans import bindings as B
from rolebook.plans.queries_joins import collapsed_sql
from rolebook.plans.queries_postings import SQL_DECODE, SQL_NORM
from rolebook.plans.registry import query
from rolebook.session import scratch_path
from rolebook.sources import feeds, sinks, tables


def js(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def doc(**fields):
    return F.to_json(js(**fields))


def day(c):
    return c.cast("string")


def strip_sql(expr: str) -> str:
    decoded = SQL_DECODE.replace("(h,", f"({expr},", 1) if "(h," in SQL_DECODE else SQL_DECODE
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({decoded}, "
        "'(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def shown(mapped, *extra):
    """Mapped rows as compared: date as text, valid rows and rejects alike."""
    cols = ["id", "title", "company", "location", day(F.col("posted_date")).alias("posted_date"), "url", *extra]
    return mapped.select(*cols, "reject_reason")


def docs(spark, sf):
    return B.doc_postings(spark, sf)


DATE_SQL = "CAST(posted_date AS VARCHAR) AS posted_date"


@query(
    "feed_greenhouse",
    f"""WITH {B.DOC_SQL}, d AS (SELECT doc.*, documents.text AS raw FROM doc JOIN documents USING (doc_id))
SELECT 'greenhouse:' || company || ':' || doc_id AS id, trim(title) AS title, 'Co ' || company AS company, location, {DATE_SQL}, url,
  {strip_sql("'&lt;p&gt;' || raw || '&lt;/p&gt;'")} AS description, CAST(NULL AS VARCHAR) AS reject_reason FROM d""",
)
def feed_greenhouse(spark, sf):
    d = docs(spark, sf).join(B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw")), "doc_id")
    job = js(
        id=F.col("doc_id"), title=F.concat(F.lit("  "), "title", F.lit(" ")), absolute_url=F.col("url"),
        location=js(name=F.concat(F.lit(" "), "location")),
        updated_at=F.concat(day(F.col("posted_date")), F.lit("T05:00:00Z")),
        content=F.concat(F.lit("&lt;p&gt;"), "raw", F.lit("&lt;/p&gt;")),
    )
    payloads = d.select(doc(jobs=F.array(job)).alias("payload"), F.col("company").alias("slug"), F.concat(F.lit("Co "), "company").alias("company"))
    return shown(feeds.map_greenhouse(payloads), "description")


@query(
    "feed_lever",
    f"""WITH {B.DOC_SQL}, d AS (SELECT doc.*, documents.text AS raw FROM doc JOIN documents USING (doc_id))
SELECT 'lever:' || company || ':x' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'Untitled' ELSE trim(title) END AS title, company, location, {DATE_SQL}, url,
  {strip_sql("raw")} || chr(10) || chr(10) || 'Must have' || chr(10) || 'a b' || chr(10) || chr(10) || 'Perks' || chr(10) || lang AS description,
  CAST(NULL AS VARCHAR) AS reject_reason FROM d""",
)
def feed_lever(spark, sf):
    d = docs(spark, sf).join(B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw")), "doc_id")
    section = lambda t, c: js(text=F.lit(t), content=c)
    item = js(
        id=F.concat(F.lit("x"), "doc_id"), text=F.when(F.col("doc_id") % 7 != 0, F.col("title")), hostedUrl=F.col("url"),
        categories=js(location=F.col("location")), createdAt=F.unix_timestamp(F.col("posted_date").cast("timestamp")) * 1000,
        description=F.col("raw"),
        lists=F.array(section("Must have", F.lit("<li>a</li><li>b</li>")), section("Perks", F.col("lang"))),
    )
    payloads = d.select(F.to_json(F.array(item)).alias("payload"), F.col("company").alias("slug"), "company")
    return shown(feeds.map_lever(payloads), "description")


@query(
    "feed_smartrecruiters",
    """SELECT 'smartrecruiters:s ' || c_nationkey || ':' || c_custkey AS id, c_name AS title, 'Co' AS company,
  CASE c_custkey % 4 WHEN 0 THEN 'City, in' WHEN 1 THEN 'City' WHEN 2 THEN 'in' END AS location, '2024-03-05' AS posted_date,
  'https://jobs.smartrecruiters.com/s%20' || c_nationkey || '/' || c_custkey AS url, CAST(NULL AS VARCHAR) AS reject_reason FROM customer""",
)
def feed_smartrecruiters(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey")
    item = js(
        id=k.cast("string"), name=F.concat("c_name", F.lit(" ")),
        location=js(city=F.when(k % 4 < 2, "City").otherwise(""), country=F.when((k % 4 == 0) | (k % 4 == 2), "in")),
        releasedDate=F.lit("2024-03-05T00:00:00.000Z"),
    )
    payloads = c.select(doc(content=F.array(item)).alias("payload"), F.concat(F.lit("s "), "c_nationkey").alias("slug"), F.lit("Co").alias("company"))
    return shown(feeds.map_smartrecruiters(payloads))


@query(
    "feed_smartrecruiters_detail",
    f"""WITH d AS (SELECT doc_id, {strip_sql("text")} AS body, lang FROM documents)
SELECT doc_id, trim('Zeta' || chr(10) || body) || chr(10) || chr(10) || 'Alpha' || chr(10) || lang AS description FROM d""",
)
def feed_smartrecruiters_detail(spark, sf):
    d = B.text_table(spark, sf, "documents", "doc_id", "text", "lang")
    first, second = js(title=F.lit("Zeta"), text=F.col("text")), js(title=F.lit("Alpha"), text=F.col("lang"))
    as_array = doc(jobAd=js(sections=F.array(first, second)))
    as_object = doc(jobAd=js(sections=F.struct(first.alias("z"), second.alias("a"))))
    payload = F.when(F.col("doc_id") % 2 == 0, as_array).otherwise(as_object)
    return d.select("doc_id", feeds.smartrecruiters_description(payload).alias("description"))


@query(
    "feed_amazon",
    f"""WITH {B.DOC_SQL}, d AS (SELECT doc.*, documents.text AS raw FROM doc JOIN documents USING (doc_id))
SELECT 'amazon:' || doc_id AS id, trim(title) AS title, 'Amazon' AS company, location, {DATE_SQL},
  'https://www.amazon.jobs/en/jobs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/x' ELSE '' END AS url,
  {strip_sql("raw || chr(10) || 'Basic <b>quals</b>'")} AS description, CAST(NULL AS VARCHAR) AS reject_reason FROM d""",
)
def feed_amazon(spark, sf):
    d = docs(spark, sf).join(B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw")), "doc_id")
    item = js(
        id=F.col("doc_id"), title=F.col("title"), location=F.col("location"),
        posting_date=F.date_format("posted_date", "MMMM d, yyyy"),
        job_path=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/en/jobs/"), "doc_id", F.lit("/x"))),
        description=F.col("raw"), qualifications=F.lit("Basic <b>quals</b>"),
    )
    return shown(feeds.map_amazon(d.select(doc(jobs=F.array(item)).alias("payload"))), "description")


@query(
    "feed_workday",
    """SELECT 'workday:acme:' || CASE o_orderkey % 3 WHEN 0 THEN 'job/R-' || o_orderkey WHEN 1 THEN 'B' || o_orderkey ELSE 'Role%20' || o_orderkey END AS id,
  'Role ' || o_orderkey AS title, 'Acme' AS company, CASE WHEN o_orderkey % 2 = 0 THEN 'Pune' END AS location,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(DATE '2024-04-30' - CAST(o_orderkey % 25 AS INTEGER) AS VARCHAR) WHEN 1 THEN '2024-02-01' END AS posted_date,
  'https://acme.myworkdayjobs.com/en-US/' || CASE o_orderkey % 3 WHEN 0 THEN 'job/R-' || o_orderkey WHEN 1 THEN 'B' || o_orderkey ELSE 'Role%20' || o_orderkey END AS url,
  CAST(NULL AS VARCHAR) AS reject_reason FROM orders""",
)
def feed_workday(spark, sf):
    o = B.text_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    item = js(
        title=F.concat(F.lit("Role "), k), externalPath=F.when(k % 3 == 0, F.concat(F.lit("job/R-"), k)),
        bulletinId=F.when(k % 3 == 1, F.concat(F.lit("B"), k)), locationsText=F.when(k % 2 == 0, "Pune").otherwise(" "),
        postedOn=F.when(k % 4 == 0, F.concat(F.lit("Posted "), k % 25, F.lit(" Days Ago")))
        .when(k % 4 == 1, "2024-02-01T00:00:00").when(k % 4 == 2, "Posted 30+ Days Ago"),
    )
    payloads = o.select(doc(jobPostings=F.array(item)).alias("payload"), F.lit("acme/site/5").alias("slug"), F.lit("Acme").alias("company"))
    return shown(feeds.map_workday(payloads, B.AS_OF))


@query(
    "feed_workday_detail",
    f"""WITH p AS (SELECT page_id, {strip_sql("html")} AS body FROM pages)
SELECT 'workday:acme:job/X_' || page_id AS id, CASE WHEN page_id % 9 = 0 THEN 'Untitled' ELSE 'Role ' || page_id END AS title, 'Acme' AS company,
  CAST(NULL AS VARCHAR) AS location, CASE WHEN page_id % 9 <> 0 THEN '2024-04-01' END AS posted_date,
  'https://acme.wd5.myworkdayjobs.com/en-US/site/job/X_' || page_id AS url,
  CASE WHEN page_id % 9 = 0 THEN '(no description returned)' ELSE body END AS description,
  CASE WHEN page_id % 9 = 0 THEN 'no-record' END AS reject_reason FROM p""",
)
def feed_workday_detail(spark, sf):
    p = B.text_table(spark, sf, "pages")
    k = F.col("page_id")
    info = js(title=F.concat(F.lit("Role "), k), jobDescription=F.col("html"), startDate=F.lit("2024-04-01"))
    payloads = p.select(
        F.when(k % 9 == 0, F.lit("{}")).otherwise(doc(jobPostingInfo=info)).alias("payload"),
        F.lit("acme/site/5").alias("slug"), F.lit("Acme").alias("company"),
        F.when(k % 2 == 0, F.concat(F.lit("https://acme.wd5.myworkdayjobs.com/en-US/site/job/X_"), k))
        .otherwise(F.concat(F.lit("job/X_"), k)).alias("ref"),
    )
    return shown(feeds.map_workday_detail(payloads, B.AS_OF), "description")


REMOTEOK_SQL = f"""WITH {B.DOC_SQL}
SELECT 'remoteok:' || doc_id AS id, CASE WHEN doc_id % 10 <> 3 THEN title END AS title, CASE WHEN doc_id % 6 = 0 THEN 'Unknown' ELSE company END AS company, location,
  {DATE_SQL}, CASE doc_id % 5 WHEN 0 THEN 'https://remoteok.com/remote-jobs/s-' || doc_id WHEN 1 THEN NULL ELSE url END AS url,
  CASE WHEN doc_id % 3 = 0 THEN '$' || format('{{:,}}', 30000 + doc_id) || ' - $90,000 / year' WHEN doc_id % 3 = 1 THEN 'From $' || format('{{:,}}', 30000 + doc_id) || ' / year' END AS salary,
  lang || ',x' AS tags, CASE WHEN doc_id % 10 = 3 THEN 'no-position' WHEN doc_id % 5 = 1 THEN 'no-url' END AS reject_reason FROM doc
UNION ALL SELECT 'remoteok', NULL, 'Unknown', NULL, NULL, NULL, NULL, '', 'no-id' FROM doc"""


def landed_remoteok(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    notice = F.lit('{"last_updated":1794556821,"legal":"terms"}')
    item = doc(
        slug=F.when(k % 5 == 0, F.concat(F.lit(" s-"), k)), id=k.cast("string"), date=F.concat(day(F.col("posted_date")), F.lit("T08:00:21+00:00")),
        company=F.when(k % 6 == 0, "").otherwise(F.col("company")), position=F.when(k % 10 != 3, F.col("title")),
        tags=F.array("lang", F.lit("x")), location=F.col("location"), url=F.when(k % 5 > 1, F.col("url")),
        salary_min=F.when(k % 3 < 2, 30000 + k).otherwise(F.lit(0)), salary_max=F.when(k % 3 == 0, 90000).otherwise(F.lit(0)),
        description=F.col("description"),
    )
    payloads = d.select("doc_id", F.concat(F.lit("["), notice, F.lit(","), item, F.lit("]")).alias("payload"))
    return feeds.map_remoteok(payloads).withColumn("tags", F.array_join("tags", ","))


@query("feed_remoteok", REMOTEOK_SQL)
def feed_remoteok(spark, sf):
    return shown(landed_remoteok(spark, sf), "salary", "tags")


REMOTIVE_SQL = f"""WITH {B.DOC_SQL} SELECT CASE WHEN doc_id % 12 = 5 THEN 'remotive' ELSE 'remotive:' || doc_id END AS id, title || ' & co' AS title,
  CASE WHEN doc_id % 6 = 0 THEN 'Unknown' ELSE company || ' / x' END AS company, location, {DATE_SQL},
  CASE WHEN doc_id % 2 = 0 THEN url WHEN doc_id % 12 = 5 THEN NULL ELSE 'https://remotive.com/remote-jobs/' || doc_id END AS url,
  lang AS category, CASE WHEN doc_id % 12 = 5 OR doc_id = 0 THEN 'no-id' END AS reject_reason FROM doc"""


def landed_remotive(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    item = js(
        id=F.when(k % 12 != 5, k), url=F.when(k % 2 == 0, F.col("url")), title=F.concat("title", F.lit(" &amp; co")),
        company_name=F.when(k % 6 != 0, F.concat("company", F.lit(" &#x2F; &#120;"))), category=F.col("lang"),
        publication_date=F.concat(day(F.col("posted_date")), F.lit("T00:00:00")), candidate_required_location=F.col("location"),
    )
    return feeds.map_remotive(d.select("doc_id", doc(jobs=F.array(item)).alias("payload")))


@query("feed_remotive", REMOTIVE_SQL)
def feed_remotive(spark, sf):
    return shown(landed_remotive(spark, sf), "category")


@query(
    "feed_freehire",
    f"""WITH {B.DOC_SQL} SELECT CASE WHEN doc_id % 2 = 0 THEN 'freehire:p-' || doc_id ELSE 'freehire:' || doc_id END AS id,
  CASE WHEN doc_id % 14 <> 9 THEN title END AS title, CASE WHEN doc_id % 6 = 0 THEN '777' ELSE company END AS company, location, {DATE_SQL}, url,
  CASE WHEN doc_id % 4 = 0 THEN 'senior' END AS seniority, CASE doc_id % 4 WHEN 0 THEN 'EUR 10–20' WHEN 1 THEN '10' END AS salary,
  lang || ',zz' AS skills, CASE WHEN doc_id % 14 = 9 THEN 'no-title' END AS reject_reason FROM doc""",
)
def feed_freehire(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    enrich = js(
        seniority=F.when(k % 4 == 0, "senior").otherwise(""), salary_min=F.when(k % 4 < 2, 10),
        salary_max=F.when(k % 4 == 0, 20), salary_currency=F.when(k % 4 == 0, "EUR"),
    )
    common = dict(
        title=F.when(k % 14 != 9, F.col("title")), location=F.col("location"), url=F.col("url"),
        skills=F.array("lang", F.lit("zz")), posted_at=day(F.col("posted_date")), enrichment=enrich,
    )
    even = doc(data=F.array(js(public_slug=F.concat(F.lit("p-"), k), id=k, company=F.col("company"), **common)))
    odd = doc(data=F.array(js(id=k, company=F.col("company"), **common)))
    coerced = doc(data=F.array(js(public_slug=F.concat(F.lit("p-"), k), company=F.lit(777), **common)))
    payload = F.when(k % 6 == 0, coerced).when(k % 2 == 0, even).otherwise(odd)
    out = feeds.map_freehire(d.select(payload.alias("payload"))).withColumn("skills", F.array_join("skills", ","))
    return shown(out, "seniority", "salary", "skills")


ARBEITNOW_SQL = f"""WITH {B.DOC_SQL} SELECT CASE WHEN doc_id % 15 = 4 THEN 'arbeitnow' ELSE 'arbeitnow:a' || doc_id END AS id, CASE WHEN doc_id % 8 = 1 THEN 'Untitled' ELSE trim(title) END AS title,
  CASE WHEN doc_id % 6 = 0 THEN 'Unknown' ELSE company END AS company, CASE WHEN location IS NOT NULL THEN location WHEN doc_id % 2 = 0 THEN 'Remote' END AS location,
  {DATE_SQL}, url, CASE WHEN doc_id % 15 = 4 THEN 'no-slug' END AS reject_reason FROM doc"""


def landed_arbeitnow(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    seconds = F.unix_timestamp(F.col("posted_date").cast("timestamp"))
    common = dict(
        slug=F.when(k % 15 != 4, F.concat(F.lit("a"), k)), company_name=F.when(k % 6 != 0, F.col("company")),
        title=F.when(k % 8 == 1, " ").otherwise(F.col("title")), remote=k % 2 == 0, url=F.concat("url", F.lit(" ")), location=F.col("location"),
    )
    by_seconds = doc(data=F.array(js(created_at=seconds, **common)))
    by_text = doc(data=F.array(js(created_at=F.concat(day(F.col("posted_date")), F.lit("T01:02:03Z")), **common)))
    payload = F.when(k % 3 == 0, by_text).otherwise(by_seconds)
    return feeds.map_arbeitnow(d.select("doc_id", payload.alias("payload")))


@query("feed_arbeitnow", ARBEITNOW_SQL)
def feed_arbeitnow(spark, sf):
    return shown(landed_arbeitnow(spark, sf))


@query(
    "feed_unstop",
    f"""WITH {B.DOC_SQL} SELECT 'unstop:' || doc_id AS id, CASE WHEN doc_id % 11 = 2 THEN NULL ELSE trim(title) END AS title,
  CASE WHEN doc_id % 6 = 0 THEN 'Unstop' ELSE company END AS company, CASE WHEN doc_id % 4 = 0 THEN 'First' ELSE location END AS location, {DATE_SQL},
  CASE WHEN doc_id % 3 = 0 THEN 'https://unstop.com/o/' || doc_id ELSE url END AS url, CASE WHEN doc_id % 11 = 2 THEN 'no-title' END AS reject_reason FROM doc""",
)
def feed_unstop(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id")
    title = F.when(k % 11 != 2, F.col("title"))
    item = js(
        id=k, title=F.when(k % 2 == 0, title), name=F.when(k % 2 == 1, title),
        organisation=js(name=F.when(k % 6 != 0, F.col("company"))),
        location=F.when(k % 4 != 0, F.col("location")), locations=F.when(k % 4 == 0, F.array(F.lit("First"), F.lit("Second"))),
        start_date=F.coalesce(day(F.col("posted_date")), F.lit("soon")), public_url=F.when(k % 3 == 1, F.col("url")), url=F.when(k % 3 == 2, F.col("url")),
    )
    nested, flat = doc(data=js(data=F.array(item))), doc(opportunities=F.array(item))
    return shown(feeds.map_unstop(d.select(F.when(k % 2 == 0, nested).otherwise(flat).alias("payload"))))


@query(
    "feed_wwr",
    """SELECT 'weworkremotely:' || CASE WHEN o_orderkey % 3 = 0 THEN 'https://wwr.example.com/' || o_orderkey ELSE 'g' || o_orderkey END AS id,
  CASE WHEN o_orderkey % 13 = 6 THEN '' ELSE 'Role & ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 13 = 6 THEN 'Unknown' WHEN o_orderkey % 2 = 0 THEN 'Acme ' || (o_custkey % 7) WHEN o_orderkey % 4 = 1 THEN 'Creator' ELSE 'Unknown' END AS company,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Anywhere' END AS location,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_date, 'https://wwr.example.com/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 13 = 6 THEN 'no-title' END AS reject_reason FROM orders""",
)
def feed_wwr(spark, sf):
    o = B.text_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    role = F.concat(F.lit("Role &amp; "), k)
    title = F.when(k % 13 == 6, "").when(k % 2 == 0, F.concat(F.lit("Acme "), F.col("o_custkey") % 7, F.lit(": "), role)).otherwise(role)

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    item = F.concat(
        F.lit("<rss><channel><title>feed</title><item>"), tag("title", title),
        F.when((k % 4 == 1) & (k % 13 != 6), tag("dc:creator", F.lit("Creator"))).otherwise(""),
        F.when(k % 5 == 0, tag("location", F.lit("Anywhere"))).otherwise(""),
        tag("pubDate", F.date_format("o_orderdate", "E, dd MMM yyyy HH:mm:ss' +0000'")),
        tag("link", F.concat(F.lit("https://wwr.example.com/"), k)),
        F.when(k % 3 != 0, tag("guid", F.concat(F.lit("g"), k))).otherwise(""), F.lit("</item></channel></rss>"),
    )
    return shown(feeds.map_wwr(o.select(item.alias("payload"))))


@query(
    "extract_jsonld",
    """SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'Role ' || page_id END AS title, CASE WHEN page_id % 4 <> 0 THEN 'Org' END AS company,
  CASE WHEN page_id % 4 <> 0 THEN '2024-04-02' END AS date,
  CASE page_id % 4 WHEN 1 THEN '$' || page_id WHEN 2 THEN 'EUR1 - EUR' || (page_id + 2) END AS salary FROM pages""",
)
def extract_jsonld(spark, sf):
    p = B.text_table(spark, sf, "pages")
    k = F.col("page_id")

    def salary(low, high, currency):
        return js(currency=currency, value=js(minValue=low, maxValue=high))

    ld = doc(**{
        "@type": F.lit("JobPosting"), "title": F.concat(F.lit("Role "), k), "hiringOrganization": js(name=F.lit("Org")),
        "datePosted": F.lit("2024-04-02"),
        "baseSalary": F.when(k % 4 == 1, salary(k, k, F.lit(None).cast("string"))).when(k % 4 == 2, salary(F.lit(1).cast("bigint"), k + 2, F.lit("EUR"))),
    })
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    other, broken = F.lit('{"@type":"Organization","title":"no"}'), F.lit("{not json")
    html = F.concat("html", script(other), script(broken), F.when(k % 4 != 0, script(ld)).otherwise(""), script(other))
    d = feeds.extract_jsonld(p.select("page_id", html.alias("html")))
    return d.select("page_id", "posting.title", "posting.company", "posting.date", "posting.salary")


@query(
    "pick_array",
    """SELECT CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS items, count(*) AS n FROM orders GROUP BY 1""",
)
def pick_array(spark, sf):
    k = F.col("o_orderkey")
    arr = lambda n: F.array(*[js(id=k) for _ in range(n)])
    payload = F.when(k % 4 == 0, F.to_json(arr(2))).when(k % 4 == 1, doc(data=js(data=arr(1)))).when(
        k % 4 == 2, doc(opportunities=arr(3), data=F.lit("x"))
    ).otherwise(doc(surprise=arr(2)))
    d = B.table(spark, sf, "orders").select(F.size(feeds.pick_array(F.try_parse_json(payload), ["data.data", "opportunities"])).alias("items"))
    return d.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


@query(
    "as_text",
    """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'word' WHEN 1 THEN '777' WHEN 2 THEN 'fallback' ELSE 'fallback' END AS value, count(*) AS n FROM orders GROUP BY 1""",
)
def as_text(spark, sf):
    k = F.col("o_orderkey")
    payload = F.when(k % 4 == 0, '{"v":"word"}').when(k % 4 == 1, '{"v":777}').when(k % 4 == 2, '{"v":{"a":1}}').otherwise('{"v":null}')
    d = B.table(spark, sf, "orders").select(feeds.text_of(F.try_parse_json(payload), "v", "fallback").alias("value"))
    return d.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "payload_notes",
    """SELECT 'x' AS portal, o_orderkey % 9 <> 0 AS ok, count(*) AS payloads,
  CAST(sum(CASE WHEN o_orderkey % 9 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows FROM orders GROUP BY 1, 2""",
)
def payload_notes(spark, sf):
    k = F.col("o_orderkey")
    d = B.table(spark, sf, "orders").select(F.when(k % 9 == 0, "{oops").otherwise(doc(jobs=F.array(js(id=k)))).alias("payload"))
    notes = feeds.payload_notes(d, "x", ["jobs"])
    return notes.groupBy("portal", "ok").agg(F.count(F.lit(1)).alias("payloads"), F.sum("rows").alias("rows"))


@query(
    "envelope_issues",
    "SELECT o_orderkey, o_orderkey % 4 AS stated, 2 AS listed FROM orders WHERE o_orderkey % 4 <> 2",
)
def envelope_issues(spark, sf):
    k = F.col("o_orderkey")
    payload = doc(meta=js(count=k % 4, page=F.lit(1)), results=F.array(js(id=k), js(id=k + 1)))
    out = feeds.envelope_issues(B.table(spark, sf, "orders").select("o_orderkey", payload.alias("payload")))
    return out.select("o_orderkey", "stated", "listed")


# --- tables -----------------------------------------------------------------------


def registry_rows(spark, sf):
    k = F.col("pos")
    boards = dict(enumerate(("amazon", "greenhouse", "lever", "smartrecruiters", "workday")))
    return B.companies(spark, sf).select(
        "company", B.choose(k % 5, boards).alias("board"),
        F.when(k % 5 == 4, F.concat(F.lit("t"), k, F.lit("/site/5"))).otherwise(F.concat(F.lit("slug"), k)).alias("slug"),
        F.when(k % 3 == 0, "global").alias("region"), F.when(k % 4 == 0, "gcc").alias("category"),
    )


@query(
    "resolve_targets",
    f"""WITH {B.CO_SQL} SELECT company, 'slug' || pos AS slug, 'india' AS region, 'startup' AS category,
  'https://api.lever.co/v0/postings/slug' || pos || '?mode=json' AS seed FROM co WHERE lower(company) = 'red ring india' AND pos % 5 = 2 AND pos % 3 <> 0 AND pos % 4 <> 0""",
)
def resolve_targets(spark, sf):
    reg = tables.check_registry(registry_rows(spark, sf))
    out = tables.resolve_targets(reg, company="RED ring India", board="lever", category="startup", region="india")
    return out.select("company", "slug", "region", "category", tables.seed_url().alias("seed"))


@query(
    "seed_urls",
    f"""WITH {B.CO_SQL} SELECT pos, CASE pos % 5 WHEN 0 THEN 'https://www.amazon.jobs/en/search.json'
  WHEN 1 THEN 'https://boards-api.greenhouse.io/v1/boards/slug' || pos || '/jobs' WHEN 2 THEN 'https://api.lever.co/v0/postings/slug' || pos || '?mode=json'
  WHEN 3 THEN 'https://api.smartrecruiters.com/v1/companies/slug' || pos || '/postings'
  ELSE 'https://t' || pos || '.wd5.myworkdayjobs.com/wday/cxs/t' || pos || '/site/jobs' END AS seed FROM co""",
)
def seed_urls(spark, sf):
    reg = registry_rows(spark, sf).withColumn("pos", F.regexp_extract("slug", r"(\d+)", 1).cast("bigint"))
    return reg.select("pos", tables.seed_url().alias("seed"))


def seen_payloads(spark, sf):
    """One store document per posting; every 40th entry is not an object."""
    s = B.seen_store(spark, sf)
    k = F.col("p_partkey")
    entry = F.to_json(
        js(title=F.col("title"), status=F.col("status"), deadline=F.col("deadline"), rank_score=F.col("rank_score"),
           scores=js(technical=F.lit(50.0)), gaps=F.col("gaps"), my_note=js(a=k)),
    )
    value = F.when(k % 40 == 0, F.lit('"oops"')).otherwise(entry)
    keyed = F.concat(F.lit('{"'), "key", F.lit('":'), value, F.lit("}"))
    return s.select(F.when(k % 2 == 0, F.concat(F.lit('{"schemaVersion":1,"seen":'), keyed, F.lit("}"))).otherwise(keyed).alias("payload"))


@query(
    "parse_seen",
    f"""WITH {B.SEEN_SQL} SELECT key, CASE WHEN p_partkey % 40 <> 0 THEN title END AS title, CASE WHEN p_partkey % 40 <> 0 THEN deadline END AS deadline,
  CASE WHEN p_partkey % 40 <> 0 THEN rank_score END AS rank_score, CASE WHEN p_partkey % 40 <> 0 THEN '{{"a":' || p_partkey || '}}' END AS extra,
  CASE WHEN p_partkey % 40 = 0 THEN 'entry is not an object' END AS error FROM seen""",
)
def parse_seen(spark, sf):
    good, bad = tables.parse_seen(seen_payloads(spark, sf))
    none = F.lit(None).cast("string")
    return good.select("key", "title", "deadline", "rank_score", F.col("extra")["my_note"].alias("extra"), none.alias("error")).union(
        bad.select("key", none, none, F.lit(None).cast("int"), none, "error")
    )


@query(
    "tracker_columns",
    f"""WITH {B.TRK_SQL} SELECT application_id, company, status, fit_rating, CAST(NULL AS VARCHAR) AS deadline, 14 AS columns FROM trk""",
)
def tracker_columns(spark, sf):
    """A legacy header without the last column, padded."""
    legacy = B.tracker(spark, sf).drop("deadline").withColumn("notes", F.col("application_id").cast("string"))
    t = tables.conform_tracker(legacy)
    return t.select(
        F.col("notes").cast("bigint").alias("application_id"), "company", "status", "fit_rating", "deadline", F.lit(len(t.columns)).alias("columns")
    )


def salary_payloads(spark, sf):
    co = B.companies(spark, sf)
    cats = F.create_map(F.lit("engineer"), js(count=F.col("count"), index=F.col("index")), F.lit("lead"), js(count=F.lit(None).cast("double"), index=F.lit("120")))
    entry = js(company=F.col("company"), city=F.col("city"), categories=cats)
    return co.select(doc(metadata=js(index_baseline=F.lit(1000.0)), companies=F.array(entry)).alias("payload"))


@query(
    "parse_salary_data",
    f"""WITH {B.CO_SQL}, l AS (SELECT company, city, 'engineer' AS category, count, index FROM co UNION ALL SELECT company, city, 'lead', NULL, '120' FROM co)
SELECT company, city, category, count(*) AS n, round(sum(count), 6) AS counted, count(index) AS with_index FROM l GROUP BY 1, 2, 3""",
)
def parse_salary_data(spark, sf):
    d = tables.parse_salary_data(salary_payloads(spark, sf))
    return d.groupBy("company", "city", "category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("count"), 6).alias("counted"), F.count("index").alias("with_index")
    )


SHEET_HEADERS = ("Notes", "Company", "City", "Engineer count", "Engineer index", "Employee id", "Bonus 2025", "Comment")


def sheet_cells(spark, sf):
    """Each company row as cells of a sheet per brand, under a title row and a
    header row."""
    p = B.table(spark, sf, "part")
    k = F.col("p_partkey")
    values = F.array(
        F.lit("x"), F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"),
        F.when(k % 6 == 0, "n/a").when(k % 6 == 1, F.concat(F.floor("p_retailprice"), F.lit(",5"))).otherwise(F.floor("p_retailprice").cast("string")),
        k.cast("string"), F.when(k % 5 == 0, "1.234").otherwise(k.cast("string")), F.lit("free text"),
    )
    body = p.select(F.col("p_brand").alias("sheet"), (k + 20).alias("row"), F.posexplode(values).alias("col", "value"))
    heads = F.array(*[F.lit(h) for h in SHEET_HEADERS])
    sheets = p.groupBy(F.col("p_brand").alias("sheet")).agg(F.count(F.lit(1)).alias("n"))
    title = sheets.select("sheet", F.lit(1).cast("bigint").alias("row"), F.lit(0).alias("col"), F.lit("Survey by employer, 1234 responses").alias("value"))
    header = sheets.select("sheet", F.lit(3).cast("bigint").alias("row"), F.posexplode(heads).alias("col", "value"))
    return body.union(title).union(header)


@query(
    "unpivot_salary",
    """WITH b AS (SELECT p_brand AS sheet, p_partkey + 20 AS row, p_name AS company, p_type AS city, p_size, p_partkey AS k, floor(p_retailprice) AS price FROM part)
SELECT sheet, row, company, city, 'engineer' AS category, CAST(p_size AS DOUBLE) AS count,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN price + 0.5 ELSE price END AS index FROM b
UNION ALL SELECT sheet, row, company, city, 'bonus_2025', NULL, CAST(k AS DOUBLE) FROM b WHERE k % 5 <> 0""",
)
def unpivot_salary(spark, sf):
    return tables.unpivot_salary(sheet_cells(spark, sf))


def gap_cells(spark, sf):
    """Companies of which some have no figure; the header of every other brand is in row 12."""
    p = B.table(spark, sf, "part")
    k, low = F.col("p_partkey"), F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    values = F.array("p_name", F.when(k % 7 == 0, "n/a").otherwise(k.cast("string")))
    body = p.select(F.col("p_brand").alias("sheet"), (k + 20).alias("row"), F.posexplode(values).alias("col", "value"))
    heads = p.select("p_brand", F.when(low, 12).otherwise(2).cast("bigint").alias("row")).distinct()
    header = heads.select(F.col("p_brand").alias("sheet"), "row", F.posexplode(F.array(F.lit("Employer"), F.lit("Median pay"))).alias("col", "value"))
    return body.union(header)


@query(
    "unpivot_salary_gaps",
    """SELECT p_brand AS sheet, p_partkey + 20 AS row, p_name AS company, '' AS city, CASE WHEN p_partkey % 7 <> 0 THEN 'median_pay' END AS category,
  CAST(NULL AS DOUBLE) AS count, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey AS DOUBLE) END AS index FROM part""",
)
def unpivot_salary_gaps(spark, sf):
    return tables.unpivot_salary(gap_cells(spark, sf), depth=12)


@query(
    "sheet_issues",
    """SELECT DISTINCT p_brand AS sheet, 'no header in the first 10 rows' AS error FROM part WHERE CAST(right(p_brand, 1) AS INTEGER) % 2 = 0""",
)
def sheet_issues(spark, sf):
    return tables.sheet_issues(gap_cells(spark, sf))


@query(
    "salary_issues",
    f"""WITH {B.CO_SQL}, e AS (SELECT pos, unnest(CASE pos % 5 WHEN 0 THEN ['company must be a non-empty string'] WHEN 1 THEN ['city must be a string when provided']
   WHEN 2 THEN ['categories.eng.count must be a number', 'categories.ops must be an object'] WHEN 3 THEN ['categories must be an object when provided'] ELSE [] END) AS error FROM co)
SELECT error, count(*) AS n FROM e GROUP BY 1""",
)
def salary_issues(spark, sf):
    co = B.companies(spark, sf)
    k, name = F.col("pos"), F.col("company")
    nested = F.lit('{"eng":{"count":"many"},"ops":7}')
    payload = F.concat(
        F.lit('{"companies":[{"company":"'), F.when(k % 5 == 0, " ").otherwise(name), F.lit('"'),
        F.when(k % 5 == 1, F.lit(',"city":5')).otherwise(""),
        F.when(k % 5 == 2, F.concat(F.lit(',"categories":'), nested)).when(k % 5 == 3, ',"categories":[1]').otherwise(',"categories":{"eng":{"count":1,"index":"n/a"}}'),
        F.lit("}]}"),
    )
    d = tables.salary_issues(co.select(payload.alias("payload")))
    return d.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_batch_refs",
    """SELECT o_orderkey, 0 AS entry_no, 'https://x/' || o_orderkey AS ref, CAST(NULL AS VARCHAR) AS error FROM orders
UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'entry#1' END, 'batch entry is missing its ref' FROM orders""",
)
def parse_batch_refs(spark, sf):
    k = F.col("o_orderkey")
    second = F.when(k % 3 == 0, '{"ref":" "}').when(k % 3 == 1, "5").otherwise('{"ref":7}')
    payload = F.concat(F.lit('[{"ref":"https://x/'), k, F.lit('"},'), second, F.lit("]"))
    good, bad = tables.parse_batch_refs(B.table(spark, sf, "orders").select("o_orderkey", payload.alias("payload")))
    return good.select("o_orderkey", "entry_no", "ref", F.lit(None).cast("string").alias("error")).union(
        bad.select("o_orderkey", "entry_no", "ref", "error")
    )


@query(
    "batch_outcome",
    "SELECT count(*) AS built, count(*) AS failed, 2 * count(*) AS total FROM orders",
)
def batch_outcome(spark, sf):
    d = parse_batch_refs(spark, sf).withColumn("ok", F.col("error").isNull())
    return R.batch_outcome(d)


@query(
    "parse_scores",
    f"""WITH {B.SCORES_SQL} SELECT CASE WHEN key LIKE '%0' THEN 'results[0]' ELSE key END AS key, CASE WHEN key NOT LIKE '%0' AND key NOT LIKE '%6' THEN technical END AS technical,
  CASE WHEN key LIKE '%0' THEN 'scoring object must be an object, got bigint' WHEN key LIKE '%6' THEN 'scores must be an object, got array' END AS error
FROM scores""",
)
def parse_scores(spark, sf):
    s = B.score_results(spark, sf)
    whole = F.to_json(F.struct("key", "scores", "language_gate"))
    payload = F.when(F.endswith("key", F.lit("0")), "[5]").when(
        F.endswith("key", F.lit("6")), F.concat(F.lit('{"results":[{"key":"'), "key", F.lit('","scores":[1]}]}'))
    ).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    good, bad = tables.parse_scores(s.select(payload.alias("payload")))
    return good.select("key", "scores.technical", F.lit(None).cast("string").alias("error")).union(
        bad.select("key", F.lit(None).cast("double"), "error")
    )


# --- sinks ------------------------------------------------------------------------


@query(
    "seen_sink",
    f"WITH {B.SEEN_SQL} SELECT status, count(*) AS n, count(deadline) AS dated FROM seen WHERE status <> 'seen' GROUP BY 1",
)
def seen_sink(spark, sf):
    """Two versions written; the later one is current."""
    root = scratch_path(spark, "seen")
    s = B.seen_store(spark, sf)
    sinks.write_seen(s, root, 1)
    sinks.write_seen(sinks.read_seen(spark, root).filter(F.col("status") != "seen"), root, 2)
    now = sinks.read_seen(spark, root)
    return now.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("deadline").alias("dated"))


@query(
    "render_table",
    f"""WITH {B.PG_SQL} SELECT id, replace(replace(title, '|', '\\|'), chr(10), ' ') || ' | ' || company || ' | ' || coalesce(location, 'unspecified') || ' | ' || CAST(posted_date AS VARCHAR) || ' | ' || url AS line FROM pg""",
)
def render_table(spark, sf):
    return sinks.render(B.page_postings(spark, sf), "table").select("id", "line")


@query(
    "render_plain",
    f"""WITH {B.DOC_SQL} SELECT id, title || ' — ' || company || ' (' || coalesce(location, 'unspecified') || ', ' || coalesce(CAST(posted_date AS VARCHAR), 'undated') || ')' || chr(10) || url AS line FROM doc""",
)
def render_plain(spark, sf):
    return sinks.render(docs(spark, sf), "plain").select("id", "line")


@query(
    "render_json",
    f"""WITH {B.DOC_SQL} SELECT id, title, location, CAST(posted_date AS VARCHAR) AS posted, true AS null_kept FROM doc""",
)
def render_json(spark, sf):
    d = sinks.render(docs(spark, sf), "json")
    back = F.from_json("line", "id string, title string, location string, postedDate string")
    null_kept = F.contains("line", F.lit('"location":'))
    return d.select(back.alias("j"), null_kept.alias("null_kept")).select(
        "j.id", "j.title", "j.location", F.col("j.postedDate").alias("posted"), "null_kept"
    )


# --- money ------------------------------------------------------------------------


@query(
    "format_salary",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '$' || format('{:,}', p_partkey + 1000) || ' / year' WHEN 1 THEN '$' || format('{:,}', p_partkey + 1000) || ' - $' || format('{:,}', p_partkey + 91000) || ' / year'
  WHEN 2 THEN 'From $' || format('{:,}', p_partkey + 1000) || ' / year' WHEN 3 THEN 'Up to $' || format('{:,}', p_partkey + 91000) || ' / year' END AS yearly,
  CASE p_partkey % 5 WHEN 0 THEN 'EUR ' || (p_partkey + 1000) || '–' || (p_partkey + 1000) WHEN 1 THEN 'EUR ' || (p_partkey + 1000) || '–' || (p_partkey + 91000) WHEN 2 THEN 'EUR ' || (p_partkey + 1000) || '–0'
   WHEN 3 THEN 'EUR 0–' || (p_partkey + 91000) ELSE 'EUR 0–0' END AS currency FROM part""",
)
def format_salary_q(spark, sf):
    from rolebook.functions.money import format_salary, format_salary_currency

    k = F.col("p_partkey")
    low = F.when(k % 5 <= 2, k + 1000).otherwise(F.lit(0))
    high = F.when(k % 5 == 0, k + 1000).when((k % 5 == 1) | (k % 5 == 3), k + 91000).otherwise(F.lit(0))
    return B.table(spark, sf, "part").select(
        k, format_salary(low, high).alias("yearly"), format_salary_currency(low, high, F.lit("EUR")).alias("currency")
    )


@query(
    "parse_salary",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey + 1000 AS DOUBLE) WHEN 1 THEN CAST(p_partkey % 90 AS DOUBLE) * 1000 END AS figure FROM part""",
)
def parse_salary_q(spark, sf):
    from rolebook.functions.money import parse_salary

    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(k + 1000, 0), F.lit(" - $99,000 / year"))).when(
        k % 3 == 1, F.concat(k % 90, F.lit("K to 120K"))
    ).otherwise("competitive")
    return B.table(spark, sf, "part").select(k, parse_salary(raw).alias("figure"))


@query(
    "parse_locale_number",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size + 1000.25::DOUBLE WHEN 1 THEN p_size + 1000.25::DOUBLE WHEN 3 THEN p_size + 0.5::DOUBLE WHEN 4 THEN CAST(p_size AS DOUBLE) END AS value FROM part""",
)
def parse_locale_number_q(spark, sf):
    from rolebook.functions.money import parse_locale_number

    k, n = F.col("p_partkey"), F.col("p_size")
    whole = n + 1000
    thousands = F.concat(F.floor(whole / 1000), F.lit("{}"), F.lpad((whole % 1000).cast("string"), 3, "0"))
    raw = (
        F.when(k % 6 == 0, F.concat(F.replace(thousands, F.lit("{}"), F.lit(".")), F.lit(",25")))
        .when(k % 6 == 1, F.concat(F.replace(thousands, F.lit("{}"), F.lit(",")), F.lit(".25")))
        .when(k % 6 == 2, F.replace(thousands, F.lit("{}"), F.lit(",")))
        .when(k % 6 == 3, F.concat(n, F.lit(",5")))
        .when(k % 6 == 4, F.concat(F.lit(" "), n, F.lit(" ")))
        .otherwise("n/a")
    )
    return B.table(spark, sf, "part").select(k, parse_locale_number(raw).alias("value"))


@query(
    "numeric_entities",
    "SELECT doc_id, lang || ' é 😀 A  & ' || lang AS decoded FROM documents",
)
def numeric_entities(spark, sf):
    raw = F.concat("lang", F.lit(" &#233; &#x1F600; &#65; &#99999999; &amp; "), "lang")
    return B.table(spark, sf, "documents").select("doc_id", T.decode_entities(raw).alias("decoded"))


# --- contract ---------------------------------------------------------------------


@query(
    "contract_nulls",
    f"""WITH {B.PG_SQL} SELECT 'id' AS field, count(*) - count(id) AS nulls FROM pg UNION ALL SELECT 'title', count(*) - count(title) FROM pg
UNION ALL SELECT 'company', count(*) - count(company) FROM pg UNION ALL SELECT 'url', count(*) - count(url) FROM pg
UNION ALL SELECT 'portal', count(*) - count(portal) FROM pg UNION ALL SELECT 'source', 0 FROM (SELECT 1)""",
)
def contract_nulls(spark, sf):
    postings = schemas.conform(B.page_postings(spark, sf), "posting")
    return schemas.required_nulls(postings, "posting")


@query(
    "enum_violations",
    f"""WITH {B.TRK_SQL} SELECT status, count(*) AS rows FROM trk WHERE status IN ('no response', 'offer declined') GROUP BY 1""",
)
def enum_violations(spark, sf):
    return schemas.enum_violations(B.tracker(spark, sf), "status", vocab.TRACKER_STATUSES)


@query(
    "tracker_csv",
    f"""WITH {B.TRK_SQL} SELECT company, role, status, count(*) AS n, max(deadline) AS deadline FROM trk GROUP BY 1, 2, 3""",
)
def tracker_csv(spark, sf):
    """Written as CSV files with a header and read back."""
    path = scratch_path(spark, "tracker")
    cols = [F.col(c).cast("string") if c in ("date", "company", "role", "status", "fit_rating", "source", "deadline") else F.lit("").alias(c) for c in vocab.TRACKER_COLUMNS]
    B.tracker(spark, sf).select(*cols).write.option("header", True).csv(path)
    t = tables.read_tracker(spark, path)
    return t.groupBy("company", "role", "status").agg(F.count(F.lit(1)).alias("n"), F.max("deadline").alias("deadline"))


@query(
    "feed_files",
    f"""WITH {B.DOC_SQL} SELECT reject_reason, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 3 THEN 'no-position' END AS reject_reason FROM doc UNION ALL SELECT 'no-id' FROM doc) GROUP BY 1""",
)
def feed_files(spark, sf):
    """Payloads landed as text files and read by the feed reader."""
    path = scratch_path(spark, "landing")
    k = F.col("doc_id")
    item = doc(id=k, position=F.when(k % 10 != 3, F.lit("Role")), slug=F.concat(F.lit("s"), k))
    docs(spark, sf).select(F.concat(F.lit('[{"legal":"terms"},'), item, F.lit("]")).alias("value")).write.text(path)
    payloads = spark.read.text(path).withColumnRenamed("value", "payload")
    good, bad = feeds.split_feed(feeds.FEEDS["remoteok"].map(payloads))
    rows = good.select(F.lit(None).cast("string").alias("reject_reason")).union(bad.select("reject_reason"))
    return rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_issues",
    """SELECT CASE o_orderkey % 6 WHEN 0 THEN 'document is not valid JSON' WHEN 1 THEN 'no list at jobs, got object' WHEN 3 THEN 'no list at jobs, got bigint'
  WHEN 4 THEN 'document is missing' END AS document_error, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 2 GROUP BY 1""",
)
def document_issues(spark, sf):
    """Items and unusable documents: every document with an item or a fault is a row."""
    k = F.col("o_orderkey")
    payload = (
        F.when(k % 6 == 0, F.concat(F.lit("{oops"), k)).when(k % 6 == 1, doc(jobs=k.cast("string"))).when(k % 6 == 2, "[]")
        .when(k % 6 == 3, k.cast("string")).when(k % 6 == 5, doc(jobs=F.array(js(id=k))))
    )
    items = feeds.items_of(B.table(spark, sf, "orders").select(payload.alias("payload")), ["jobs"])
    return items.groupBy("document_error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "salary_document_issues",
    """SELECT CASE p_partkey % 5 WHEN 0 THEN 'companies must be a list, got string' WHEN 1 THEN 'metadata must be an object, got bigint'
  WHEN 2 THEN 'top level must be an object, got array' ELSE 'entry must be an object' END AS error, p_partkey % 5 = 4 AS entry, count(*) AS n
FROM part WHERE p_partkey % 5 <> 3 GROUP BY 1, 2""",
)
def salary_document_issues(spark, sf):
    k = F.col("p_partkey")
    payload = (
        F.when(k % 5 == 0, doc(companies=F.col("p_name"))).when(k % 5 == 1, doc(metadata=k, companies=F.array().cast("array<int>")))
        .when(k % 5 == 2, F.to_json(F.array(k))).when(k % 5 == 3, doc(companies=F.array(js(company=F.col("p_name"))))).otherwise(doc(companies=F.array(k)))
    )
    out = tables.salary_issues(B.table(spark, sf, "part").select(payload.alias("payload")))
    return out.groupBy("error", F.col("pos").isNotNull().alias("entry")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tracker_mixed",
    f"""WITH {B.TRK_SQL} SELECT status, count(*) AS n, count(deadline) AS deadlines FROM trk GROUP BY 1""",
)
def tracker_mixed(spark, sf):
    """One folder of files with thirteen and with fourteen columns."""
    path = scratch_path(spark, "tracker-mixed")
    cols = [F.col(c).cast("string") if c in ("date", "company", "role", "status", "fit_rating", "source", "deadline") else F.lit("").alias(c) for c in vocab.TRACKER_COLUMNS]
    rows = B.tracker(spark, sf).select(*cols)
    rows.where("deadline IS NULL").select(*vocab.TRACKER_COLUMNS[:13]).write.option("header", True).csv(path)
    rows.where("deadline IS NOT NULL").write.mode("append").option("header", True).csv(path)
    t = tables.read_tracker(spark, path)
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("deadline").alias("deadlines"))


@query(
    "tracker_headers",
    f"""WITH {B.TRK_SQL}, k AS (SELECT *, application_id % 4 AS kind FROM trk)
SELECT 'row' AS what, status AS name, count(*) AS n, count(DISTINCT company) AS companies, count(deadline) AS deadlines FROM k WHERE kind <> 3 GROUP BY 2
UNION ALL SELECT 'issue', 'column is not read: salary', count(*), 0, 0 FROM k WHERE kind = 2
UNION ALL SELECT 'issue', 'no header with company and role', count(*), 0, 0 FROM k WHERE kind = 3""",
)
def tracker_headers(spark, sf):
    """One folder of files with the known header, another order, a column more, and none."""
    path = scratch_path(spark, "tracker-headers")
    known = ("date", "company", "role", "status", "fit_rating", "source", "deadline")
    rows = B.tracker(spark, sf).select(*[F.col(c).cast("string") if c in known else F.lit("").alias(c) for c in vocab.TRACKER_COLUMNS], (F.col("application_id") % 4).alias("kind"))
    names = list(vocab.TRACKER_COLUMNS)
    files = {0: names, 1: ["company", "date", *reversed(names[2:])], 2: [*names, F.lit("20").alias("salary")], 3: names}
    for kind, columns in files.items():
        rows.where(F.col("kind") == kind).select(*columns).write.mode("append").option("header", kind != 3).csv(path)
    good = tables.read_tracker(spark, path, multiline=False).groupBy(F.col("status").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("company").alias("companies"), F.count("deadline").alias("deadlines")
    )
    bad = tables.tracker_issues(spark, path, multiline=False).groupBy(F.col("error").alias("name")).agg(F.sum("lines").alias("n"))
    none = F.lit(0).cast("long")
    return good.select(F.lit("row").alias("what"), "*").union(bad.select(F.lit("issue"), "name", "n", none, none))


@query(
    "large_documents",
    """WITH k AS (SELECT *, p_partkey // 500 AS d, p_partkey % 17 = 3 AS bad FROM part)
SELECT 'entry' AS what, 'part:' || p_partkey AS key, p_name AS title, CAST(p_size AS INTEGER) AS score, NULL AS error FROM k WHERE NOT bad AND d % 3 <> 2
UNION ALL SELECT 'bad', 'part:' || p_partkey, NULL, NULL, 'entry is not an object' FROM k WHERE bad AND d % 3 <> 2
UNION ALL SELECT 'bad', NULL, NULL, NULL, 'document is not valid JSON' FROM (SELECT DISTINCT d FROM k WHERE d % 3 = 2)""",
)
def large_documents(spark, sf):
    """Stores of 500 parts as one document each, wrapped, bare, and cut short, read in pieces."""
    path = scratch_path(spark, "large")
    k = F.col("p_partkey")
    entry = F.when(k % 17 == 3, F.to_json(F.array(k))).otherwise(F.to_json(js(title=F.col("p_name"), rank_score=F.col("p_size").cast("int"), note=F.lit("a, \"b\" {c} ["))))
    rows = B.table(spark, sf, "part").select(F.floor(k / 500).alias("d"), F.concat(F.lit('"part:'), k, F.lit('":'), entry).alias("e"))
    body = F.array_join(F.array_sort(F.collect_list("e")), ",")
    docs = rows.groupBy("d").agg(body.alias("body")).withColumn("kind", F.col("d") % 3)
    text = F.when(F.col("kind") == 0, F.concat(F.lit('{"version":1,"seen":{'), "body", F.lit('},"end":[]}'))).when(F.col("kind") == 1, F.concat(F.lit("{"), "body", F.lit("}")))
    docs.select("d", text.otherwise(F.concat(F.lit('{"seen":{'), "body")).alias("value")).write.partitionBy("d").text(path)
    good, bad = tables.read_seen_large(spark, path)
    none = F.lit(None)
    return good.select(F.lit("entry").alias("what"), "key", "title", F.col("rank_score").alias("score"), none.cast("string").alias("error")).union(
        bad.select(F.lit("bad"), "key", none, none, "error")
    )


SCRAPED = (("remoteok", REMOTEOK_SQL), ("remotive", REMOTIVE_SQL), ("arbeitnow", ARBEITNOW_SQL))


def scraped(spark, sf):
    """Landed payloads of three boards as one pool each, rejects among them."""
    mapped = (landed_remoteok(spark, sf), landed_remotive(spark, sf), landed_arbeitnow(spark, sf))
    cols = ["id", "title", "company", "location", "posted_date", "url", "portal", "reject_reason", F.col("doc_id").alias("pos")]
    pools = [m.select(*cols).withColumn("pool_no", F.lit(i)) for i, m in enumerate(mapped)]
    return dedupe.union_pools(*pools)


def scraped_sql():
    rows = " UNION ALL ".join(
        f"SELECT id, title, company, location, posted_date, url, reject_reason, '{portal}' AS portal, {i} AS pool_no FROM ({sql})"
        for i, (portal, sql) in enumerate(SCRAPED)
    )
    return f"""landed AS ({rows}),
  pg2 AS (SELECT * REPLACE (CAST(posted_date AS DATE) AS posted_date), CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS pos FROM landed WHERE reject_reason IS NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY pool_no ORDER BY pos) AS pool_rank FROM pg2),
  keyed AS (SELECT *, {SQL_NORM} AS dedupe_key FROM ranked),
  merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY pool_rank, pool_no, id) AS rn FROM keyed) WHERE rn = 1),
  {collapsed_sql('merged', 'pool_rank, pool_no, id')}"""


@query(
    "scrape_feeds",
    f"""WITH {scraped_sql()} SELECT id, company, location, portal FROM collapsed
WHERE lower(location) LIKE '%remote%' AND coalesce(DATE '2024-04-30' - posted_date <= 40, true) ORDER BY pool_rank, pool_no LIMIT 50""",
)
def scrape_feeds(spark, sf):
    """Payloads to mappers to one merged, collapsed, filtered and sliced list."""
    good, _ = feeds.split_feed(scraped(spark, sf))
    merged = dedupe.merge_pools(dedupe.interleave(dedupe.with_keys(good))).drop("copies", "dedupe_key")
    rows = filters.stage_filter(dedupe.collapse_spread(merged), B.AS_OF, location="remote", max_age=40)
    top, _ = limits.limit_with_meta(rows, dedupe.round_robin_order(), 50)
    return top.select("id", "company", "location", "portal")


@query(
    "scrape_feeds_notes",
    f"""WITH {scraped_sql()} SELECT portal, CAST(count(*) FILTER (WHERE reject_reason IS NULL) AS BIGINT) AS rows,
  CAST(count(reject_reason) AS BIGINT) AS quarantined FROM landed GROUP BY 1""",
)
def scrape_feeds_notes(spark, sf):
    """What each board gave: listed rows are postings or quarantined, none is lost."""
    rows = scraped(spark, sf)
    return rows.groupBy("portal").agg(F.count_if(F.col("reject_reason").isNull()).alias("rows"), F.count("reject_reason").alias("quarantined"))
