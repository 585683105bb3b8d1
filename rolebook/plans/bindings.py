"""Bindings: the given tables projected to postings, tracker, seen store,
company list and application events, in Spark and as SQL text for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-04-30"
WS = "[ \\t\\r\\n\\f]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of texts; the session's split size says how many tasks read it."""
    df = table(spark, sf_dir, name)
    return df.select(*columns) if columns else df


def days_before(days: Column) -> Column:
    return F.date_sub(F.lit(AS_OF).cast("date"), days.cast("int"))


def choose(c: Column, options: dict, default=None) -> Column:
    out = F.lit(default)
    for value, result in options.items():
        out = F.when(c == value, F.lit(result)).otherwise(out)
    return out


SUFFIXES = {
    0: ". 2025 batch only.",
    1: ". Monthly stipend of INR 15000.",
    2: ". CTC 8 LPA.",
    3: ". 2 year service agreement applies.",
    4: ". Fluent German.",
    5: ". 2026 batch welcome.",
    6: ". Rs 30000 per month.",
    7: "",
}


def doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    k = F.col("doc_id")
    return d.select(
        F.concat(F.lit("doc:"), k).alias("id"),
        F.regexp_replace("text", WS, " ").alias("title"),
        F.col("source").alias("company"),
        choose(F.col("lang"), {"en": "Remote", "de": "Bangalore", "fr": "Mumbai"}).alias("location"),
        F.when(k % 11 != 0, days_before(k % 60)).alias("posted_date"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/jobs/"), 10000000 + k % 400).alias("url"),
        F.col("source").alias("portal"),
        F.lit("adapter").alias("source"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("pool_no"),
        k.alias("pos"),
        F.concat("text", choose(k % 8, SUFFIXES)).alias("description"),
        "doc_id",
        "lang",
    )


DOC_SQL = """doc AS (
  SELECT 'doc:' || doc_id AS id,
         regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g') AS title,
         source AS company,
         CASE lang WHEN 'en' THEN 'Remote' WHEN 'de' THEN 'Bangalore' WHEN 'fr' THEN 'Mumbai' END AS location,
         CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-04-30' - CAST(doc_id % 60 AS INTEGER) END AS posted_date,
         'https://' || source || '.example.com/jobs/' || (10000000 + doc_id % 400) AS url,
         source AS portal,
         CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS pool_no,
         doc_id AS pos,
         text || CASE doc_id % 8
            WHEN 0 THEN '. 2025 batch only.' WHEN 1 THEN '. Monthly stipend of INR 15000.'
            WHEN 2 THEN '. CTC 8 LPA.' WHEN 3 THEN '. 2 year service agreement applies.'
            WHEN 4 THEN '. Fluent German.' WHEN 5 THEN '. 2026 batch welcome.'
            WHEN 6 THEN '. Rs 30000 per month.' ELSE '' END AS description,
         doc_id, lang
  FROM documents)"""


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = text_table(spark, sf_dir, "pages")
    k = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    place = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([a-z][a-z])(?:[/?#]|$)", 1)
    portal = F.regexp_extract(host, r"\.(com|net|org)$", 1)
    return p.select(
        F.concat(F.lit("page:"), k).alias("id"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        host.alias("company"),
        F.when(place != "", place).alias("location"),
        days_before(k % 45).alias("posted_date"),
        "url",
        portal.alias("portal"),
        F.lit("adapter").alias("source"),
        choose(portal, {"com": 0, "net": 1, "org": 2}, 3).alias("pool_no"),
        k.alias("pos"),
        F.col("html").alias("description"),
        "page_id",
    )


PG_SQL = """pg AS (
  SELECT *, CASE portal WHEN 'com' THEN 0 WHEN 'net' THEN 1 WHEN 'org' THEN 2 ELSE 3 END AS pool_no
  FROM (SELECT 'page:' || page_id AS id,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS company,
         nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z][a-z])(?:[/?#]|$)', 1), '') AS location,
         DATE '2024-04-30' - CAST(page_id % 45 AS INTEGER) AS posted_date,
         url,
         coalesce(regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '\\.(com|net|org)$', 1), '') AS portal,
         page_id AS pos, html AS description, page_id
  FROM pages))"""


def mirror_postings(pages: DataFrame) -> DataFrame:
    """The secure pages again, under a tracked URL and another portal."""
    base, frag = F.substring_index("url", "#", 1), F.regexp_extract("url", "(#.*)$", 1)
    mark = F.when(F.instr(base, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return pages.filter(F.startswith("url", F.lit("https:"))).withColumns(
        {
            "id": F.concat(F.lit("mirror:"), "page_id"),
            "portal": F.lit("mirror"),
            "pool_no": F.lit(4),
            "url": F.concat(base, mark, F.lit("utm_source=m"), frag),
        }
    )


PG2_SQL = (
    PG_SQL
    + """, pg2 AS (
  SELECT id, title, company, location, posted_date, url, portal, pos, description, page_id, pool_no FROM pg
  UNION ALL
  SELECT 'mirror:' || page_id, title, company, location, posted_date,
         regexp_extract(url, '^([^#]*)', 1) || CASE WHEN regexp_extract(url, '^([^#]*)', 1) LIKE '%?%' THEN '&' ELSE '?' END
           || 'utm_source=m' || coalesce(regexp_extract(url, '(#.*)$', 1), ''),
         'mirror', pos, description, page_id, 4 FROM pg WHERE url LIKE 'https:%')"""
)


TRACKER_STATUS = {
    0: "drafted", 1: "applied", 2: "interview", 3: "offer", 4: "hired", 5: "rejected",
    6: "no_response", 7: "offer_declined", 8: "withdrawn", 9: "no response", 10: "offer declined",
}


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return o.select(
        day.alias("date"),
        F.concat(F.lit("Company "), F.col("o_custkey") % 97).alias("company"),
        F.concat("o_orderpriority", F.lit(" "), k % 13).alias("role"),
        choose(k % 11, TRACKER_STATUS).alias("status"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, "n/a").otherwise((k % 101).cast("string")).alias("fit_rating"),
        F.concat(F.lit("portal"), F.col("o_custkey") % 12).alias("source"),
        F.when(k % 17 == 0, "ASAP")
        .otherwise(F.date_add(day, (k % 40).cast("int")).cast("string"))
        .alias("deadline"),
        k.alias("application_id"),
    )


TRK_SQL = """trk AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         'Company ' || (o_custkey % 97) AS company,
         o_orderpriority || ' ' || (o_orderkey % 13) AS role,
         CASE o_orderkey % 11 WHEN 0 THEN 'drafted' WHEN 1 THEN 'applied' WHEN 2 THEN 'interview' WHEN 3 THEN 'offer'
           WHEN 4 THEN 'hired' WHEN 5 THEN 'rejected' WHEN 6 THEN 'no_response' WHEN 7 THEN 'offer_declined'
           WHEN 8 THEN 'withdrawn' WHEN 9 THEN 'no response' ELSE 'offer declined' END AS status,
         CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN 'n/a'
              ELSE CAST(o_orderkey % 101 AS VARCHAR) END AS fit_rating,
         'portal' || (o_custkey % 12) AS source,
         CASE WHEN o_orderkey % 17 = 0 THEN 'ASAP'
              ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS VARCHAR) END AS deadline,
         o_orderkey AS application_id
  FROM orders)"""

SEEN_STATUS = {0: "new", 1: "scored", 2: "ranked", 3: "skipped", 4: "expired", 5: "seen"}


def seen_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    from rolebook.operators.scoring import band

    score = (k % 101).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("part:"), k).alias("key"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company"),
        choose(k % 4, {0: "PASS", 1: "Pune", 2: "FAIL"}).alias("location"),
        F.concat(F.lit("https://jobs.example.com/"), k).alias("url"),
        F.concat(F.lit("portal"), k % 5).alias("portal"),
        days_before(k % 200 + 10).alias("first_seen"),
        F.when(k % 9 != 0, days_before(k % 200).cast("string")).alias("posted_date"),
        choose(k % 6, SEEN_STATUS).alias("status"),
        F.when(k % 3 != 1, score).alias("rank_score"),
        F.when(k % 3 != 1, band(score)).alias("rank_verdict"),
        F.when(k % 3 != 1, days_before(F.lit(20))).alias("rank_date"),
        F.when(k % 8 == 0, "FAIL").otherwise("PASS").alias("location_verdict"),
        F.when(k % 10 == 0, "FAIL").otherwise("PASS").alias("language_gate"),
        F.when(k % 10 == 0, F.lit("stored note")).alias("language_note"),
        F.when(k % 7 == 0, F.lit(None))
        .when(k % 19 == 0, "ASAP")
        .otherwise(days_before(30 - k % 60).cast("string"))
        .alias("deadline"),
        F.array(F.lower("p_name")).alias("strengths"),
        F.array("p_type").alias("gaps"),
        F.array().cast("array<struct<score:int,verdict:string,date:string>>").alias("rank_history"),
        k.alias("p_partkey"),
    )


SEEN_SQL = """seen AS (
  SELECT *, CASE WHEN rank_score IS NULL THEN NULL WHEN rank_score >= 75 THEN 'Strong Fit' WHEN rank_score >= 60 THEN 'Good Fit'
       WHEN rank_score >= 45 THEN 'Moderate Fit' WHEN rank_score >= 30 THEN 'Weak Fit' ELSE 'Poor Fit' END AS rank_verdict
  FROM (SELECT 'part:' || p_partkey AS key, p_name AS title, p_brand AS company,
         CASE p_partkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'Pune' WHEN 2 THEN 'FAIL' END AS location,
         'https://jobs.example.com/' || p_partkey AS url, 'portal' || (p_partkey % 5) AS portal,
         CASE WHEN p_partkey % 9 <> 0 THEN CAST(DATE '2024-04-30' - CAST(p_partkey % 200 AS INTEGER) AS VARCHAR) END AS posted_date,
         CASE p_partkey % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'scored' WHEN 2 THEN 'ranked' WHEN 3 THEN 'skipped'
           WHEN 4 THEN 'expired' ELSE 'seen' END AS status,
         CASE WHEN p_partkey % 3 <> 1 THEN CAST(p_partkey % 101 AS INTEGER) END AS rank_score,
         CASE WHEN p_partkey % 3 <> 1 THEN DATE '2024-04-10' END AS rank_date,
         CASE WHEN p_partkey % 8 = 0 THEN 'FAIL' ELSE 'PASS' END AS location_verdict,
         CASE WHEN p_partkey % 10 = 0 THEN 'FAIL' ELSE 'PASS' END AS language_gate,
         CASE WHEN p_partkey % 10 = 0 THEN 'stored note' END AS language_note,
         CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN 'ASAP'
              ELSE CAST(DATE '2024-04-30' + CAST(p_partkey % 60 - 30 AS INTEGER) AS VARCHAR) END AS deadline,
         lower(p_name) AS strength, p_type AS gap, p_partkey
  FROM part))"""


def seen_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker rows for the promoted postings, spelled differently."""
    p = table(spark, sf_dir, "part").filter(F.col("p_type") == "PROMO")
    return p.select(F.upper("p_brand").alias("company"), F.col("p_name").alias("role"))


TRKS_SQL = "trks AS (SELECT upper(p_brand) AS company, p_name AS role FROM part WHERE p_type = 'PROMO')"


def score_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score results for every part, with unknown keys and missing dimensions
    here and there."""
    k = F.col("p_partkey")
    dims = F.struct(
        F.when(k % 23 != 0, ((k * 7) % 101).cast("double")).alias("technical"),
        ((k * 11) % 101).cast("double").alias("experience"),
        ((k * 13) % 101).cast("double").alias("behavioral"),
        ((k * 17) % 101).cast("double").alias("career"),
    )
    gate = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "FAIL").otherwise("PASS")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.when(k % 100 == 0, F.concat(F.lit("gone:"), k)).otherwise(F.concat(F.lit("part:"), k)).alias("key"),
            F.when(k % 52 == 0, "expired").alias("status"),
            dims.alias("scores"),
            F.when(k % 12 == 0, "FLAG").alias("location_verdict"),
            gate.alias("language_gate"),
            F.when(gate == "FAIL", F.concat(F.lit("note "), k)).alias("language_note"),
            F.when(k % 8 != 0, F.lit("2024-05-03")).alias("deadline"),
            F.when(k % 16 != 0, F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"), F.lit("s4"))).alias("strengths"),
            F.lit(None).cast("array<string>").alias("gaps"),
        )
    )


SCORES_SQL = """scores AS (
  SELECT CASE WHEN p_partkey % 100 = 0 THEN 'gone:' || p_partkey ELSE 'part:' || p_partkey END AS key,
         CASE WHEN p_partkey % 52 = 0 THEN 'expired' END AS status,
         CASE WHEN p_partkey % 23 <> 0 THEN CAST((p_partkey * 7) % 101 AS DOUBLE) END AS technical,
         CAST((p_partkey * 11) % 101 AS DOUBLE) AS experience,
         CAST((p_partkey * 13) % 101 AS DOUBLE) AS behavioral,
         CAST((p_partkey * 17) % 101 AS DOUBLE) AS career,
         CASE WHEN p_partkey % 12 = 0 THEN 'FLAG' END AS location_verdict,
         CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS language_gate,
         CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 'note ' || p_partkey END AS language_note,
         CASE WHEN p_partkey % 8 <> 0 THEN '2024-05-03' END AS deadline,
         p_partkey % 16 <> 0 AS has_strengths
  FROM part)"""

COMPANY_SUFFIX = {0: "Pvt Ltd", 1: "Technologies", 2: "India", 3: "(Group)", 4: "Holding"}


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" "), choose(k % 5, COMPANY_SUFFIX)).alias("company"),
        F.col("p_type").alias("city"),
        F.col("p_size").cast("double").alias("count"),
        F.when(k % 20 == 0, "n/a")
        .when(k % 17 == 0, F.lit(None))
        .otherwise(F.col("p_retailprice").cast("string"))
        .alias("index"),
        F.when(k % 20 == 0, F.lit(None)).when(k % 17 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("price"),
        k.alias("pos"),
    )


CO_SQL = """co AS (
  SELECT p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Pvt Ltd' WHEN 1 THEN 'Technologies' WHEN 2 THEN 'India'
           WHEN 3 THEN '(Group)' ELSE 'Holding' END AS company,
         p_type AS city, CAST(p_size AS DOUBLE) AS count,
         CASE WHEN p_partkey % 20 = 0 THEN 'n/a' WHEN p_partkey % 17 = 0 THEN NULL
              ELSE CAST(p_retailprice AS VARCHAR) END AS index,
         CASE WHEN p_partkey % 20 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS price,
         p_partkey AS pos
  FROM part)"""

EVENT_STAGE = {"view": "drafted", "click": "applied", "signup": "interview", "purchase": "offer", "error": "rejected"}


def application_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("application_id"),
        choose(F.col("event_type"), EVENT_STAGE).alias("stage"),
        F.col("ts").cast("date").alias("at"),
        F.concat(F.lit("portal"), F.col("user_id") % 12).alias("source"),
        "event_id",
    )


EVT_SQL = """evt AS (
  SELECT user_id AS application_id,
         CASE event_type WHEN 'view' THEN 'drafted' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'interview'
           WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected' END AS stage,
         CAST(ts AS DATE) AS at, 'portal' || (user_id % 12) AS source, event_id
  FROM events)"""
