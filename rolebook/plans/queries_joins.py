"""Registered queries: pools, dedupe, limits and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import companies as C
from rolebook.operators import dedupe, filters, joins, limits, lookup, robots, shortlists
from rolebook.operators import scoring as S
from rolebook.plans import bindings as B
from rolebook.plans.queries_matching import EXPERIENCED, FACTS_SQL, STUDENT, scored_sql
from rolebook.plans.queries_postings import SQL_NORM, SQL_REQ
from rolebook.plans.registry import query

# --- pools ----------------------------------------------------------------------

RANKED_SQL = f"""{B.PG2_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY pool_no ORDER BY pos) AS pool_rank FROM pg2)"""
MERGED_SQL = f"""{RANKED_SQL}, keyed AS (SELECT *, {SQL_NORM} AS dedupe_key FROM ranked),
  merged AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dedupe_key) AS copies,
      row_number() OVER (PARTITION BY dedupe_key ORDER BY pool_rank, pool_no, id) AS rn FROM keyed) WHERE rn = 1)"""


def collapsed_sql(source: str, order: str) -> str:
    """Collapse ``source`` (a CTE) into CTE ``collapsed``."""
    return f"""grp AS (SELECT *, lower(company) AS gc, coalesce({SQL_REQ}, lower(title)) AS gr, coalesce(location, '') AS place,
      row_number() OVER () AS rid FROM {source}),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY gc, gr ORDER BY {order}) AS crn,
      count(*) OVER (PARTITION BY gc, gr) AS group_size FROM grp),
  cities AS (SELECT gc, gr, list(place ORDER BY first_at) AS places FROM (
      SELECT gc, gr, place, min(ord) AS first_at FROM (
        SELECT gc, gr, place, row_number() OVER (PARTITION BY gc, gr ORDER BY {order}) AS ord FROM grp) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  collapsed AS (SELECT f.* EXCLUDE (location), CASE WHEN len(places) > 1 THEN places[1] || ' (+' || (len(places) - 1) || ' cities: '
      || array_to_string(places[2:], ', ') || ')' ELSE location END AS location
    FROM firsts f JOIN cities c ON f.gc = c.gc AND f.gr = c.gr WHERE crn = 1)"""


def pools(spark, sf):
    pages = B.page_postings(spark, sf)
    return dedupe.union_pools(pages, B.mirror_postings(pages))


@query("union_pools", f"WITH {B.PG2_SQL} SELECT portal, count(*) AS n FROM pg2 GROUP BY 1")
def union_pools(spark, sf):
    return pools(spark, sf).groupBy("portal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "interleave_gaps",
    f"""WITH {B.DOC_SQL}, g AS (SELECT id, CASE WHEN doc_id % 7 <> 0 THEN pool_no END AS pool_no, CASE WHEN doc_id % 5 <> 0 THEN pos END AS pos FROM doc)
SELECT CASE WHEN pos IS NOT NULL THEN id END AS id, pool_no, row_number() OVER (PARTITION BY pool_no ORDER BY pos NULLS LAST) AS pool_rank FROM g""",
)
def interleave_gaps(spark, sf):
    """Rows without a pool or a position among others; those without one come in any order."""
    k = F.col("doc_id")
    d = B.doc_postings(spark, sf).select("id", F.when(k % 7 != 0, F.col("pool_no")).alias("pool_no"), F.when(k % 5 != 0, F.col("pos")).alias("pos"))
    return dedupe.interleave(d).select(F.when(F.col("pos").isNotNull(), F.col("id")).alias("id"), "pool_no", "pool_rank")


@query("interleave", f"WITH {RANKED_SQL} SELECT id, pool_no, pool_rank FROM ranked")
def interleave(spark, sf):
    return dedupe.interleave(pools(spark, sf)).select("id", "pool_no", "pool_rank")


@query("merge_pools", f"WITH {MERGED_SQL} SELECT id, dedupe_key, copies FROM merged")
def merge_pools(spark, sf):
    return dedupe.merge_pools(dedupe.interleave(pools(spark, sf))).select("id", "dedupe_key", "copies")


@query("duplicate_count", f"WITH {MERGED_SQL} SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicates, count(*) AS kept FROM merged")
def duplicate_count(spark, sf):
    return dedupe.duplicate_count(dedupe.merge_pools(dedupe.interleave(pools(spark, sf))))


@query(
    "collapse_spread",
    f"WITH {B.DOC_SQL}, {collapsed_sql('doc', 'pos, id')} SELECT id, title, location, group_size FROM collapsed",
)
def collapse_spread(spark, sf):
    d = B.doc_postings(spark, sf).select("id", "title", "company", "location", "url", "pos")
    return dedupe.collapse_spread(d, ["pos", "id"]).select("id", "title", "location", "group_size")


@query(
    "collapse_spread_pages",
    f"WITH {MERGED_SQL}, {collapsed_sql('merged', 'pool_rank, pool_no, id')} SELECT id, location, group_size FROM collapsed",
)
def collapse_spread_pages(spark, sf):
    merged = dedupe.merge_pools(dedupe.interleave(pools(spark, sf)))
    slim = merged.select("id", "title", "company", "location", "url", "pool_no", "pool_rank")
    return dedupe.collapse_spread(slim).select("id", "location", "group_size")


@query(
    "scrape_top50",
    f"""WITH {MERGED_SQL}, {collapsed_sql('merged', 'pool_rank, pool_no, id')} SELECT id, location, portal FROM collapsed
WHERE lower(location) LIKE '%en%' AND coalesce(DATE '2024-04-30' - posted_date <= 40, true)
ORDER BY pool_rank, pool_no LIMIT 50""",
)
def scrape_top50(spark, sf):
    """Interleave, merge, collapse, filter and slice: the whole fan-in. Landed rows
    cost no fetching, so no source is capped before the filter."""
    ranked = dedupe.interleave(dedupe.with_keys(pools(spark, sf).drop("description")))
    merged = dedupe.merge_pools(ranked).drop("copies", "dedupe_key")
    rows = filters.stage_filter(dedupe.collapse_spread(merged), B.AS_OF, location="en", max_age=40)
    top, _ = limits.limit_with_meta(rows, dedupe.round_robin_order(), 50)
    return top.select("id", "location", "portal")


@query(
    "diff_sets",
    """WITH e AS (SELECT DISTINCT c_custkey % 50 AS g, CASE c_custkey % 3 WHEN 0 THEN 'compensation' WHEN 1 THEN 'bond' ELSE 'batch' END AS gate FROM customer),
a AS (SELECT DISTINCT s_suppkey % 50 AS g, CASE s_suppkey % 4 WHEN 0 THEN 'compensation' WHEN 1 THEN 'bond' WHEN 2 THEN 'stale' ELSE 'compensation' END AS gate FROM supplier)
SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
)
def diff_sets(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    e = B.table(spark, sf, "customer").select(
        (c % 50).alias("g"), B.choose(c % 3, {0: "compensation", 1: "bond", 2: "batch"}).alias("gate")
    )
    a = B.table(spark, sf, "supplier").select(
        (s % 50).alias("g"), B.choose(s % 4, {0: "ctc", 1: "Bond ", 2: "stale", 3: "salary"}).alias("gate")
    )
    return dedupe.diff_sets(e, a, ["g"], "gate")


# --- limits ---------------------------------------------------------------------


@query("limit_with_meta", f"WITH {B.PG_SQL} SELECT id FROM pg ORDER BY posted_date DESC, pos LIMIT 25")
def limit_with_meta(spark, sf):
    rows, _ = limits.limit_with_meta(B.page_postings(spark, sf), [F.col("posted_date").desc(), "pos"], 25)
    return rows.select("id")


@query("limit_meta", "SELECT count(*) AS total, count(*) > 25 AS truncated FROM pages")
def limit_meta(spark, sf):
    _, meta = limits.limit_with_meta(B.table(spark, sf, "pages"), ["page_id"], 25)
    return meta


@query("page", f"WITH {B.PG_SQL} SELECT id FROM pg ORDER BY posted_date DESC, pos LIMIT 20 OFFSET 40")
def page(spark, sf):
    rows, _ = limits.page(B.page_postings(spark, sf), [F.col("posted_date").desc(), "pos"], 3, 20)
    return rows.select("id")


@query("deep_pages", "WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS row_no FROM lineitem) SELECT * FROM o WHERE row_no BETWEEN 401 AND 420 OR row_no BETWEEN 5001 AND 5020")
def deep_pages(spark, sf):
    """Page 21 and page 251 of all order lines, from ranges sorted once."""
    lines = B.table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    pages = limits.Pages(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], 32)
    return pages.page(21, 20).union(pages.page(251, 20)).select("l_orderkey", "l_linenumber", "row_no")


@query(
    "cap_per_source",
    f"WITH {B.DOC_SQL} SELECT id, portal FROM (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY pos) AS r FROM doc) WHERE r <= 30",
)
def cap_per_source(spark, sf):
    d = B.doc_postings(spark, sf).select("id", "portal", "pos")
    return limits.cap_per_source(d, 10).select("id", "portal")


@query(
    "row_budget",
    f"""WITH {B.DOC_SQL}, c AS (SELECT pool_no, count(*) AS rows FROM doc GROUP BY 1),
b AS (SELECT *, coalesce(sum(rows) OVER (ORDER BY pool_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM c)
SELECT pool_no, rows, rows_before < 300 AS taken, CASE WHEN rows_before >= 300 THEN 'row budget 300 reached' END AS note,
  CASE WHEN rows_before < 300 THEN rows ELSE 0 END AS kept FROM b""",
)
def row_budget(spark, sf):
    d = B.doc_postings(spark, sf).select("id", "pool_no")
    kept, notes = limits.row_budget(d, 300)
    n = kept.groupBy("pool_no").agg(F.count(F.lit(1)).alias("kept"))
    return notes.join(n, "pool_no", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("bigint"))


# --- joins ----------------------------------------------------------------------

NK = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(
    "exclude_tracked",
    f"""WITH {B.SEEN_SQL}, {B.TRKS_SQL} SELECT key FROM seen s WHERE NOT EXISTS (SELECT 1 FROM trks t
  WHERE {NK.format('t.company')} = {NK.format('s.company')} AND {NK.format('t.role')} = {NK.format('s.title')})""",
)
def exclude_tracked(spark, sf):
    return joins.exclude_tracked(B.seen_store(spark, sf), B.seen_tracker(spark, sf)).select("key")


@query(
    "only_new",
    f"""WITH {B.PG2_SQL}, k AS (SELECT id, portal, {SQL_NORM} AS dedupe_key FROM pg2)
SELECT id, dedupe_key FROM k WHERE dedupe_key NOT IN (SELECT dedupe_key FROM k WHERE portal = 'mirror')""",
)
def only_new(spark, sf):
    keyed = dedupe.with_dedupe_key(pools(spark, sf)).select("id", "portal", "dedupe_key")
    seen = keyed.filter(F.col("portal") == "mirror").select(F.col("dedupe_key").alias("key"))
    return joins.only_new(keyed, seen).select("id", "dedupe_key")


@query(
    "join_scores",
    f"""WITH {B.SEEN_SQL}, {B.SCORES_SQL} SELECT r.key, s.key IS NOT NULL AS known,
  CASE WHEN s.key IS NULL THEN 'no such key in the seen store' END AS error FROM scores r LEFT JOIN seen s ON r.key = s.key""",
)
def join_scores(spark, sf):
    ok, err = joins.join_scores(B.score_results(spark, sf), B.seen_store(spark, sf))
    return ok.select("key", F.lit(True).alias("known"), F.lit(None).cast("string").alias("error")).union(
        err.select("key", F.lit(False), "error")
    )


COMPANY_PAIR_SQL = f"""WITH {B.CO_SQL}, n AS (SELECT DISTINCT company FROM co),
f AS (SELECT company, regexp_replace(w, '[^a-z0-9]', '', 'g') AS k, list_distinct(regexp_extract_all(w, '[a-z0-9]{{2,}}')) AS words
  FROM (SELECT company, regexp_replace(lower(company), '\\bpvt\\.?\\s*ltd\\.?\\b|\\btechnologies\\b|\\(.*?\\)|\\bindia\\b|\\bholding\\b', '', 'g') AS w FROM n)),
q AS (SELECT DISTINCT p_name AS query, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS qk, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}')) AS qw FROM part),
p AS (SELECT query, company, qk, k, qw, len(list_intersect(qw, words)) AS shared FROM q, f WHERE qk <> '' AND k <> ''),
s AS (SELECT query, company, CAST(CASE WHEN qk = k THEN 100
  WHEN contains(k, qk) AND (NOT (length(qk) <= 4 AND length(qk)::DOUBLE / length(k) < 0.5) OR shared > 0) THEN 80 + floor(length(qk)::DOUBLE / length(k) * 10)
  WHEN contains(qk, k) AND NOT (length(k) <= 4 AND length(k)::DOUBLE / length(qk) < 0.5) THEN 80 + floor(length(k)::DOUBLE / length(qk) * 10)
  WHEN contains(qk, k) AND shared > 0 THEN 75 WHEN shared = 0 THEN 0 WHEN len(qw) = 1 THEN 70
  ELSE floor(30 + shared::DOUBLE / len(qw) * 40) END AS INTEGER) AS score FROM p)"""


@query("match_names", f"{COMPANY_PAIR_SQL} SELECT query, company, score FROM s WHERE score >= 30")
def match_names(spark, sf):
    queries = B.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    return C.match_names(queries, B.companies(spark, sf))


@query(
    "match_companies",
    f"""{COMPANY_PAIR_SQL} SELECT query, score, count(*) AS entries, CAST(sum(pos) AS BIGINT) AS pos_sum
FROM s JOIN co USING (company) WHERE score >= 30 AND contains(lower(city), 'eco') GROUP BY 1, 2""",
)
def match_companies(spark, sf):
    queries = B.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    m = C.match_companies(queries, B.companies(spark, sf), city="ECO")
    return m.groupBy("query", "score").agg(F.count(F.lit(1)).alias("entries"), F.sum("pos").alias("pos_sum"))


@query(
    "best_names",
    f"""{COMPANY_PAIR_SQL} SELECT query, company, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, company) AS r FROM s WHERE score >= 30) WHERE r <= 3""",
)
def best_names(spark, sf):
    """The three best names of each; very many share a word."""
    queries = B.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    return C.best_names(queries, B.companies(spark, sf), 3)


@query(
    "best_companies",
    f"""{COMPANY_PAIR_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, company) AS r FROM s
  WHERE score >= 45 AND company IN (SELECT company FROM co WHERE contains(lower(city), 'eco')))
SELECT query, score, count(*) AS entries, CAST(sum(pos) AS BIGINT) AS pos_sum FROM b JOIN co USING (company) WHERE r <= 2 AND contains(lower(city), 'eco') GROUP BY 1, 2""",
)
def best_companies(spark, sf):
    queries = B.table(spark, sf, "part").select(F.col("p_name").alias("query"))
    m = C.best_companies(queries, B.companies(spark, sf), 2, city="ECO", floor=45)
    return m.groupBy("query", "score").agg(F.count(F.lit(1)).alias("entries"), F.sum("pos").alias("pos_sum"))


def ref_postings(spark, sf):
    k = F.col("page_id")
    return B.table(spark, sf, "pages").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("slug-"), k).alias("slug"),
        F.concat(F.lit("https://remoteok.com/remote-jobs/remote-role-"), 100000 + k % 170).alias("url"),
        k.alias("pos"),
    )


def refs(spark, sf):
    k = F.col("page_id")
    return B.table(spark, sf, "pages").select(
        F.when(k % 5 == 0, k.cast("string"))
        .when(k % 5 == 1, F.concat(F.lit("slug-"), k))
        .when(k % 5 == 2, F.concat(F.lit("https://remoteok.com/remote-jobs/remote-role-"), 100000 + k % 170))
        .when(k % 5 == 3, F.concat(F.lit("https://remoteok.io/remote-jobs/other-"), 100000 + k))
        .otherwise(F.concat(F.lit("missing "), k, F.lit("x")))
        .alias("ref")
    ).distinct()


@query(
    "resolve_refs",
    """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id, 'slug-' || page_id AS slug, 100000 + page_id % 170 AS tail, page_id AS pos FROM pages),
r AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'slug-' || page_id
   WHEN 2 THEN 'https://remoteok.com/remote-jobs/remote-role-' || (100000 + page_id % 170)
   WHEN 3 THEN 'https://remoteok.io/remote-jobs/other-' || (100000 + page_id) ELSE 'missing ' || page_id || 'x' END AS ref FROM pages),
n AS (SELECT ref, coalesce(nullif(regexp_extract(ref, '/remote-jobs/(?:.*-)?(\\d+)', 1), ''), nullif(regexp_extract(ref, '(\\d+)$', 1), ''), ref) AS num FROM r),
e AS (SELECT ref, arg_min(id, pos) AS id FROM n JOIN p ON p.id = ref OR p.id = num OR p.slug = ref
   OR 'https://remoteok.com/remote-jobs/remote-role-' || p.tail = ref GROUP BY 1),
t AS (SELECT CAST(tail AS VARCHAR) AS num, min(id) AS id FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT n.ref, coalesce(e.id, t.id) AS posting_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN t.id IS NOT NULL THEN 'tail' END AS how
FROM n LEFT JOIN e ON n.ref = e.ref LEFT JOIN t ON n.num = t.num""",
)
def resolve_refs(spark, sf):
    return joins.resolve_refs(refs(spark, sf), ref_postings(spark, sf))


@query(
    "pair_candidates",
    f"""{scored_sql(True)}, s1 AS (SELECT 'c-student' AS candidate_id, id, pass, CASE WHEN pass THEN score END AS score FROM scored),
s2 AS (SELECT * FROM ({scored_sql(False)} SELECT 'c-exp' AS candidate_id, id, pass, CASE WHEN pass THEN score END AS score FROM scored))
SELECT * FROM s1 UNION ALL SELECT * FROM s2""",
)
def pair_candidates(spark, sf):
    """Texts are read once, then each posting meets every candidate."""
    from rolebook.operators import gates as G

    docs = G.with_text_facts(B.doc_postings(spark, sf))
    pairs = joins.pair(docs, [STUDENT, EXPERIENCED])
    return S.rank_all(pairs, F.col("cand"), B.AS_OF, with_text=True).select("cand.candidate_id", "id", "pass", "score")


@query(
    "pair_candidate_table",
    f"""WITH {B.DOC_SQL}, c AS (SELECT 's' || s_suppkey AS candidate_id, CASE s_nationkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Mumbai' ELSE 'Bengaluru' END AS want FROM supplier),
g AS (SELECT candidate_id, coalesce(DATE '2024-04-30' - posted_date <= 30, true) AND location IS NOT NULL
   AND contains(replace(lower(location), 'bangalore', 'bengaluru'), lower(want)) AS pass FROM doc, c)
SELECT candidate_id, CAST(sum(CAST(pass AS INTEGER)) AS BIGINT) AS passed FROM g GROUP BY 1""",
)
def pair_candidate_table(spark, sf):
    want = B.choose(F.col("s_nationkey") % 3, {0: "Remote", 1: "Mumbai", 2: "Bengaluru"})
    cands = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("candidate_id"), F.array(want).alias("locations")
    )
    return joins.candidate_reach(B.doc_postings(spark, sf), cands, B.AS_OF)


TABLE_SKILLS = {0: ("the", "tion"), 1: ("Eaux", "de", "zzz"), 2: ("er", "th", "on", "python"), 3: ()}
TABLE_WEIGHTS = {stage: vocab.FACTOR_WEIGHTS[stage] for stage in ("student", "experienced")}


def weight_sql(i):
    return f"CASE WHEN stage = 'student' THEN {TABLE_WEIGHTS['student'][i]}::DOUBLE ELSE {TABLE_WEIGHTS['experienced'][i]}::DOUBLE END"


def text_weight_sql(i):
    return "CASE stage " + " ".join(f"WHEN '{s}' THEN {vocab.FACTOR_WEIGHTS[s][i]}::DOUBLE" for s in ("student", "fresher", "experienced")) + " END"


@query(
    "shortlist_per_candidate",
    f"""WITH {B.PG_SQL}, c AS (SELECT 's' || s_suppkey AS candidate_id, CASE WHEN s_suppkey % 2 = 0 THEN 'student' ELSE 'experienced' END AS stage,
  CASE s_suppkey % 4 WHEN 0 THEN ['the', 'tion'] WHEN 1 THEN ['eaux', 'de', 'zzz'] WHEN 2 THEN ['er', 'th', 'on', 'python'] ELSE [] END AS skills,
  CASE s_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS want FROM supplier),
x AS (SELECT c.*, id, pos, CAST(DATE '2024-04-30' - posted_date AS INTEGER) AS age, len(list_filter(skills, lambda s: contains(lower(title), s))) AS h, len(skills) AS n
  FROM pg, c WHERE coalesce(DATE '2024-04-30' - posted_date <= 30, true) AND (want = '' OR coalesce(contains(lower(location), want), false))),
y AS (SELECT *, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE h::DOUBLE / n END AS share, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, h::DOUBLE / least(n, 3)) END AS echo,
  CASE WHEN age IS NULL THEN 0.4::DOUBLE WHEN age <= 3 THEN 1.0::DOUBLE WHEN age <= 7 THEN 0.85::DOUBLE WHEN age <= 14 THEN 0.65::DOUBLE WHEN age <= 30 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS fresh FROM x),
z AS (SELECT candidate_id, id, pos, CAST(floor(100.0::DOUBLE * (({weight_sql(0)}) * share + ({weight_sql(1)}) * echo + ({weight_sql(2)}) * fresh) + 0.5::DOUBLE) AS INTEGER) AS score FROM y)
SELECT candidate_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, pos) AS r FROM z) WHERE r <= 5""",
)
def shortlist_per_candidate(spark, sf):
    """The five best pages of every supplier, taken as candidates."""
    k = F.col("s_suppkey")
    skills = F.lit(None).cast("array<string>")
    for n, own in TABLE_SKILLS.items():
        skills = F.when(k % 4 == n, F.array(*[F.lit(s) for s in own]).cast("array<string>")).otherwise(skills)
    want = B.choose(F.col("s_nationkey") % 3, {0: "en", 1: "fr"})
    cands = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k).alias("candidate_id"), F.when(k % 2 == 0, "student").otherwise("experienced").alias("stage"), skills.alias("skills"),
        F.filter(F.array(want), lambda x: x.isNotNull()).alias("locations"),
    )
    pages = B.page_postings(spark, sf).select("id", "pos", "title", "location", "posted_date")
    return joins.shortlist_per_candidate(pages, cands, B.AS_OF, 5)


TEXT_SKILLS = {0: ("the", "tion", "Of The"), 1: ("Eaux", "de", "zzz", "de"), 2: ("er", "th", "on", "python", "chst"), 3: (), 4: None, 5: ("ö", "++", "batch only")}


@query(
    "shortlist_per_candidate_text",
    f"""WITH {B.DOC_SQL}, {FACTS_SQL}, c AS (SELECT 's' || s_suppkey AS candidate_id, CASE s_suppkey % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'fresher' ELSE 'experienced' END AS stage,
  CASE s_suppkey % 7 WHEN 0 THEN ['the', 'tion', 'of the'] WHEN 1 THEN ['eaux', 'de', 'zzz', 'de'] WHEN 2 THEN ['er', 'th', 'on', 'python', 'chst'] WHEN 5 THEN ['ö', '++', 'batch only']
    WHEN 6 THEN [lower(s_name), 'supplier', 'un'] ELSE [] END AS skills,
  CASE s_nationkey % 4 WHEN 0 THEN ['remote'] WHEN 1 THEN ['mumbai', 'bengaluru'] WHEN 2 THEN [] END AS accept,
  2024 + s_nationkey % 3 AS year, CASE WHEN s_suppkey % 2 = 0 THEN 20000 END AS floor FROM supplier),
p AS (SELECT id, pos, age, replace(lower(location), 'bangalore', 'bengaluru') AS place, lower(title) AS t, lower(title || chr(10) || description) AS x, years, exclusive, monthly
  FROM facts WHERE coalesce(age <= 30, true) AND NOT (has_text AND language IS NOT NULL)),
x AS (SELECT candidate_id, stage, id, pos, age, len(skills) AS n, len(list_filter(skills, lambda s: contains(x, s))) AS h, len(list_filter(skills, lambda s: contains(t, s))) AS e
  FROM p, c WHERE (coalesce(len(accept), 0) = 0 OR coalesce(len(list_filter(accept, lambda a: contains(place, a))), 0) > 0)
    AND NOT (stage IN ('student', 'fresher') AND exclusive AND len(years) > 0 AND NOT list_contains(years, CAST(year AS VARCHAR)))
    AND NOT coalesce(stage = 'student' AND monthly < floor, false)),
y AS (SELECT *, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE h::DOUBLE / n END AS share, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, e::DOUBLE / least(n, 3)) END AS echo,
  CASE WHEN age IS NULL THEN 0.4::DOUBLE WHEN age <= 3 THEN 1.0::DOUBLE WHEN age <= 7 THEN 0.85::DOUBLE WHEN age <= 14 THEN 0.65::DOUBLE WHEN age <= 30 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS fresh FROM x),
z AS (SELECT candidate_id, id, pos, CAST(floor(100.0::DOUBLE * (({text_weight_sql(0)}) * share + ({text_weight_sql(1)}) * echo + ({text_weight_sql(2)}) * fresh) + 0.5::DOUBLE) AS INTEGER) AS score FROM y)
SELECT candidate_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, pos) AS r FROM z) WHERE r <= 5""",
)
def shortlist_per_candidate_text(spark, sf):
    """The five best documents of every supplier, taken as candidates, with all gates and texts."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    skills = F.array(F.col("s_name"), F.lit("supplier"), F.lit("un"))
    for n, own in TEXT_SKILLS.items():
        skills = F.when(k % 7 == n, F.lit(None).cast("array<string>") if own is None else F.array(*[F.lit(s) for s in own]).cast("array<string>")).otherwise(skills)
    places = F.when(nation % 4 == 0, F.array(F.lit("Remote"))).when(nation % 4 == 1, F.array(F.lit("Mumbai"), F.lit("Bangalore"))).when(nation % 4 == 2, F.array().cast("array<string>"))
    cands = B.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k).alias("candidate_id"), B.choose(k % 3, {0: "student", 1: "fresher"}, "experienced").alias("stage"), skills.alias("skills"),
        places.alias("locations"), (F.lit(2024) + nation % 3).alias("grad_year"), F.when(k % 2 == 0, 20000.0).alias("stipend_floor"),
    )
    return shortlists.shortlist_per_candidate_text(B.doc_postings(spark, sf), cands, B.AS_OF, 5)


POLICY_BODIES = {
    0: "User-agent: *\nDisallow: /en/\nAllow: /en/1*\n",
    1: "# rules\nUser-agent: bot\nUser-agent: *\nDisallow: /*.html$\n\nUser-agent: other\nDisallow: /\n",
    2: "<html><body>not found</body></html>",
    3: "",
    4: "Disallow: /%66r/\nUser-agent: bot\nDisallow: /\n",
    5: "User-agent: *\nDisallow: /en/\nAllow: /en/\n",
}


def host_policies(spark, sf):
    """A policy text for each host of the page table."""
    p = B.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    hosts = p.groupBy("host").agg((F.min("page_id") % 6).alias("k"))
    return hosts.select(
        "host", F.when(F.col("k") == 3, 404).otherwise(200).alias("http_status"), B.choose(F.col("k"), POLICY_BODIES).alias("body")
    )


ROBOTS_SQL = """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) || CASE WHEN url LIKE '%?%' THEN '?' || regexp_extract(url, '\\?([^#]*)', 1) ELSE '' END AS path FROM pages),
h AS (SELECT host, min(page_id) % 6 AS k FROM u GROUP BY 1)
SELECT page_id, host, CASE k WHEN 0 THEN CASE WHEN path LIKE '/en/1%' THEN 'allowed' WHEN path LIKE '/en/%' THEN 'disallowed' ELSE 'allowed' END
  WHEN 1 THEN CASE WHEN path LIKE '/%.html' THEN 'disallowed' ELSE 'allowed' END
  WHEN 2 THEN 'unconfirmed' WHEN 3 THEN 'allowed'
  WHEN 4 THEN CASE WHEN path LIKE '/fr/%' THEN 'disallowed' ELSE 'allowed' END
  ELSE CASE WHEN path LIKE '/en/%' THEN 'disallowed' ELSE 'allowed' END END AS robots FROM u JOIN h USING (host)"""


@query("robots_filter", ROBOTS_SQL)
def robots_filter(spark, sf):
    urls = B.table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_filter(urls, host_policies(spark, sf)).select("page_id", "host", "robots")


@query("robots_filter_many", ROBOTS_SQL)
def robots_filter_many(spark, sf):
    """The same verdicts with every host's rules as rows."""
    urls = B.table(spark, sf, "pages").select("page_id", "url")
    return robots.robots_filter_many(urls, host_policies(spark, sf)).select("page_id", "host", "robots")


@query(
    "with_company",
    f"""WITH {B.CO_SQL}, r AS (SELECT 'slug' || pos AS slug, company FROM co WHERE city IN ('ECONOMY', 'PROMO'))
SELECT co.pos, coalesce(r.company, 'SLUG' || co.pos) AS company FROM co LEFT JOIN r ON r.slug = 'slug' || co.pos""",
)
def with_company(spark, sf):
    co = B.companies(spark, sf)
    registry = co.filter(F.col("city").isin("ECONOMY", "PROMO")).select(F.concat(F.lit("Slug"), "pos").alias("slug"), "company")
    return joins.with_company(co.select("pos", F.concat(F.lit("SLUG"), "pos").alias("slug")), registry).select("pos", "company")


GAP_SOURCES_SQL = f"""{B.TRK_SQL}, {B.SEEN_SQL}, t0 AS (SELECT lower(company) AS company, lower(role) AS role, fit_rating, date, application_id FROM trk),
t AS (SELECT company, role, arg_max(fit_rating, (date, application_id)) AS fit_rating FROM t0 GROUP BY 1, 2),
r0 AS (SELECT 'company ' || (p_partkey % 97) AS company, CASE p_partkey % 5 WHEN 0 THEN '1-urgent' WHEN 1 THEN '2-high' WHEN 2 THEN '3-medium'
   WHEN 3 THEN '4-not specified' ELSE '5-low' END || ' ' || (p_partkey % 13) AS role, rank_score, gap, key FROM seen WHERE status = 'ranked'),
r AS (SELECT company, role, arg_max(rank_score, (rank_score, key)) AS rank_score, arg_max(gap, (rank_score, key)) AS gap FROM r0 GROUP BY 1, 2),
m AS (SELECT coalesce(t.company, r.company) AS company, coalesce(t.role, r.role) AS role, t.company IS NOT NULL AS tracked,
   fit_rating, rank_score, coalesce(gap, 'inferred skill') AS gap, CASE WHEN gap IS NOT NULL THEN 'recorded' ELSE 'inferred' END AS provenance
   FROM t FULL JOIN r ON t.company = r.company AND t.role = r.role)"""


def gap_sources(spark, sf):
    t = B.tracker(spark, sf).withColumn("inferred", F.array(F.lit("inferred skill")))
    k = F.col("p_partkey")
    roles = {0: "1-URGENT", 1: "2-HIGH", 2: "3-MEDIUM", 3: "4-NOT SPECIFIED", 4: "5-LOW"}
    r = (
        B.seen_store(spark, sf)
        .filter(F.col("status") == "ranked")
        .select(
            "key", "rank_score", "gaps",
            F.concat(F.lit("COMPANY "), k % 97).alias("company"),
            F.concat(B.choose(k % 5, roles), F.lit(" "), k % 13).alias("title"),
        )
    )
    return joins.merge_gap_sources(t, r)


@query(
    "merge_gap_sources",
    f"WITH {GAP_SOURCES_SQL} SELECT company, role, tracked, fit_rating, rank_score, gap AS gaps, provenance FROM m",
)
def merge_gap_sources(spark, sf):
    return gap_sources(spark, sf).withColumn("gaps", F.array_join("gaps", ","))


@query(
    "cache_lookup",
    f"""WITH {B.TRK_SQL}, w AS (SELECT DISTINCT company FROM trk),
l AS (SELECT company, max(date) AS fetched_date, arg_max(role, (date, role)) AS value FROM trk WHERE date BETWEEN DATE '1998-03-01' - 30 AND DATE '1998-03-01' GROUP BY 1)
SELECT w.company, CAST(fetched_date AS VARCHAR) AS fetched_date, value, fetched_date IS NOT NULL AS hit FROM w LEFT JOIN l ON w.company = l.company""",
)
def cache_lookup(spark, sf):
    t = B.tracker(spark, sf)
    cache = t.select("company", F.col("date").alias("fetched_date"), F.col("role").alias("value"))
    out = joins.cache_lookup(t.select("company").distinct(), cache, "1998-03-01")
    return out.withColumn("fetched_date", F.col("fetched_date").cast("string"))


def line_counts(spark, sf, key):
    """Order lines by supplier or by part: two aggregates of all lines that differ."""
    return B.table(spark, sf, "lineitem").groupBy(F.col(key).alias("custkey")).agg(F.count(F.lit(1)).cast("double").alias("n"))


RECONCILE_SQL = """e AS (SELECT l_suppkey AS custkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
a AS (SELECT l_partkey AS custkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
d AS (SELECT coalesce(e.custkey, a.custkey) AS custkey, e.n AS expected, a.n AS actual,
  CASE WHEN a.custkey IS NULL THEN 'missing: ' WHEN e.custkey IS NULL THEN 'extra: ' WHEN abs(e.n - a.n) > 1e-9 THEN 'differs: ' END
  || coalesce(e.custkey, a.custkey) AS detail FROM e FULL JOIN a ON e.custkey = a.custkey)"""


@query("reconcile", f"WITH {RECONCILE_SQL} SELECT * FROM d WHERE detail IS NOT NULL")
def reconcile(spark, sf):
    return joins.reconcile(line_counts(spark, sf, "l_suppkey"), line_counts(spark, sf, "l_partkey"), ["custkey"], "n")


KNOWN = ("missing: 1", "extra: 2", "differs: 999999")


@query(
    "ratchet",
    f"""WITH {RECONCILE_SQL}, p(pattern) AS (VALUES ('missing: 1'), ('extra: 2'), ('differs: 999999'))
SELECT pattern, count(detail) AS hits, count(detail) = 0 AS resolved FROM p LEFT JOIN d ON contains(detail, pattern) GROUP BY 1
UNION ALL SELECT 'unexpected', count(*), false FROM d WHERE detail IS NOT NULL AND NOT contains(detail, 'missing: 1') AND NOT contains(detail, 'extra: 2')""",
)
def ratchet(spark, sf):
    diffs = joins.reconcile(line_counts(spark, sf, "l_suppkey"), line_counts(spark, sf, "l_partkey"), ["custkey"], "n")
    classed, patterns = joins.ratchet(diffs, KNOWN)
    unexpected = classed.filter(F.col("known").isNull()).agg(F.count(F.lit(1)).alias("hits"))
    return patterns.unionByName(unexpected.select(F.lit("unexpected").alias("pattern"), "hits", F.lit(False).alias("resolved")))


@query(
    "cache_lookup_asof",
    f"""WITH {B.TRK_SQL}, w AS (SELECT application_id, company, date + CAST(application_id % 45 AS INTEGER) AS day FROM trk),
c AS (SELECT company, date AS fetched_date, max(role) AS value FROM trk WHERE application_id % 3 = 0 GROUP BY 1, 2)
SELECT application_id, CAST(max(fetched_date) AS VARCHAR) AS fetched_date, arg_max(value, fetched_date) AS value, max(fetched_date) IS NOT NULL AS hit
FROM w LEFT JOIN c ON w.company = c.company AND fetched_date BETWEEN day - 30 AND day GROUP BY 1""",
)
def cache_lookup_asof(spark, sf):
    """Every application asks for its company's latest value on a day of its own."""
    t = B.tracker(spark, sf)
    cache = t.filter(F.col("application_id") % 3 == 0).select("company", F.col("date").alias("fetched_date"), F.col("role").alias("value"))
    asked = t.select("application_id", "company", F.date_add("date", (F.col("application_id") % 45).cast("int")).alias("day"))
    out = joins.cache_lookup_asof(asked, cache)
    return out.select("application_id", F.col("fetched_date").cast("string").alias("fetched_date"), "value", "hit")


@query(
    "reconcile_tables",
    """WITH e AS (SELECT * FROM orders WHERE o_orderkey % 997 <> 1),
a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 499 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 991 <> 2),
j AS (SELECT e.o_orderkey AS ek, a.o_orderkey AS ak, e.o_orderstatus AS es, a.o_orderstatus AS s FROM e FULL JOIN a ON e.o_orderkey = a.o_orderkey)
SELECT 'missing' AS what, '{"o_orderkey":' || ek || '}' AS key, NULL AS "column", NULL AS expected, NULL AS actual FROM j WHERE ak IS NULL
UNION ALL SELECT 'extra', '{"o_orderkey":' || ak || '}', NULL, NULL, NULL FROM j WHERE ek IS NULL
UNION ALL SELECT 'differs', '{"o_orderkey":' || ek || '}', 'o_orderstatus', es, s FROM j WHERE ek = ak AND es <> s
UNION ALL SELECT 'missing column', NULL, 'o_totalprice', NULL, NULL
UNION ALL SELECT 'extra column', NULL, 'note', NULL, NULL""",
)
def reconcile_tables(spark, sf):
    """All orders against a copy with rows left out, values changed and other columns."""
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    status = F.when(k % 499 == 3, "X").otherwise(F.col("o_orderstatus"))
    other = o.filter(k % 991 != 2).select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), F.lit(1).alias("note"))
    return joins.reconcile_tables(o.filter(k % 997 != 1), other, ["o_orderkey"])


@query(
    "match_query_table",
    f"""WITH {B.DOC_SQL}, q AS (SELECT doc_id AS query_id, doc_id % 20 = 0 AS phrase, CASE WHEN doc_id % 20 = 0 THEN lower(substr(text, 9, 11)) ELSE lower(split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 5)) END AS query
  FROM documents WHERE doc_id % 10 = 0),
w AS (SELECT query_id, CASE WHEN phrase THEN list_filter([query], lambda x: x <> '') ELSE list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '') END AS w FROM q),
h AS (SELECT id, lower(title || ' ' || description) AS hay FROM doc)
SELECT query_id, id FROM w, h WHERE len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(hay, x))) = 0""",
)
def match_query_table(spark, sf):
    """A tenth of the documents as queries (two words, or a phrase) against all."""
    d = B.table(spark, sf, "documents").filter(F.col("doc_id") % 10 == 0)
    is_phrase = F.col("doc_id") % 20 == 0
    two = F.concat(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(5)))
    queries = d.select(F.col("doc_id").alias("query_id"), F.when(is_phrase, F.substring("text", 9, 11)).otherwise(two).alias("query"), F.when(is_phrase, "phrase").otherwise("words").alias("kind"))
    return lookup.match_query_table(B.doc_postings(spark, sf), queries, ["title", "description"])
