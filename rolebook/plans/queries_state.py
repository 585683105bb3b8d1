"""Registered queries: reports, packs, state over time, evaluation, stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import apply, dedupe, packs, state
from rolebook.operators import evaluation as E
from rolebook.operators import reports as R
from rolebook.operators import scoring as S
from rolebook.plans import bindings as B
from rolebook.plans.queries_joins import GAP_SOURCES_SQL, gap_sources, pools
from rolebook.plans.queries_matching import (
    BAND_SQL,
    GATE_COLS,
    STUDENT,
    docs_gated,
    gated_sql,
    overall_sql,
    scored_sql,
)
from rolebook.plans.queries_postings import SQL_NORM
from rolebook.plans.registry import query
from rolebook.session import scratch_path
from rolebook.sources import sinks, tables
from rolebook.streaming import ingest, keyed

# --- reports ----------------------------------------------------------------------


@query(
    "source_notes",
    f"""WITH {B.PG2_SQL}, s AS (SELECT portal, CASE portal WHEN 'org' THEN 'HTTP 500' WHEN 'dead' THEN 'timeout' END AS error
  FROM (SELECT portal FROM pg2 UNION SELECT 'dead' UNION SELECT 'quiet')),
c AS (SELECT portal, count(*) AS rows FROM pg2 GROUP BY 1)
SELECT s.portal, error IS NULL AS ok, coalesce(rows, 0) AS rows, coalesce(rows, 0) >= 84 AS truncated, error,
  CASE WHEN error IS NOT NULL THEN 'health: ' || s.portal || ' — error: ' || error END AS line FROM s LEFT JOIN c USING (portal)""",
)
def source_notes(spark, sf):
    p = pools(spark, sf).select("portal", "page_id")
    extra = B.table(spark, sf, "region").select(B.choose(F.col("r_regionkey") % 2, {0: "dead", 1: "quiet"}).alias("portal"))
    sources = p.select("portal").union(extra)
    failed = B.choose(F.col("portal"), {"dead": "timeout", "org": "HTTP 500"})
    errors = sources.select("portal", failed.alias("error")).filter(F.col("error").isNotNull())
    notes = R.source_notes(p, sources, errors, 84)
    return notes.join(R.health_lines(notes), "portal", "left")


REJECT_ROWS = " UNION ALL ".join(
    f"SELECT '{c[2:]}' AS gate, count(*) AS rejected FROM gated WHERE starts_with({c}, 'FAIL') HAVING count(*) > 0" for c in GATE_COLS
)


@query("rejections_by_gate", f"{gated_sql(True)} {REJECT_ROWS}")
def rejections_by_gate(spark, sf):
    return R.rejections_by_gate(docs_gated(spark, sf, STUDENT))


NOISE_SQL = "[" + ",".join(f"'{w}'" for w in vocab.GAP_NOISE) + "]"
GAPS_SQL = f"""{B.DOC_SQL}, w AS (
  SELECT id, unnest(regexp_extract_all(lower(title), '[a-z0-9+#.]{{4,}}')) AS word, 4 AS n, 0 AS part,
    generate_subscripts(regexp_extract_all(lower(title), '[a-z0-9+#.]{{4,}}'), 1) AS spot FROM doc
  UNION ALL SELECT id, unnest(regexp_extract_all(lower(description), '[a-z0-9+#.]{{4,}}')), 1, 1,
    generate_subscripts(regexp_extract_all(lower(description), '[a-z0-9+#.]{{4,}}'), 1) FROM doc),
g AS (SELECT id, word, sum(n) AS weight, min(part * 1000000000 + spot) AS first FROM w GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, first) AS place FROM g QUALIFY place <= 12),
h AS (SELECT *, contains('tion', word) OR contains(word, 'tion') OR contains('python', word) OR contains(word, 'python')
     OR contains('een', word) OR contains(word, 'een') AS hit FROM t),
kw AS (SELECT id, coalesce(string_agg(word, ',' ORDER BY place) FILTER (WHERE hit), '') AS covered,
  array_to_string((list(word ORDER BY place) FILTER (WHERE NOT hit AND NOT list_contains({NOISE_SQL}, word)))[1:5], ',') AS missing FROM h GROUP BY 1)"""


def gap_skills():
    return F.array(F.lit("tion"), F.lit("Python"), F.lit("een"))


@query(
    "keyword_gaps",
    f"WITH {GAPS_SQL} SELECT doc.id, coalesce(covered, '') AS covered, coalesce(missing, '') AS missing FROM doc LEFT JOIN kw ON doc.id = kw.id",
)
def keyword_gaps(spark, sf):
    g = packs.keyword_gaps(B.doc_postings(spark, sf).select("id", "title", "description"), gap_skills())
    return g.select("id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


PROFILE_JSON = """{"name":"Asha","email":"a@example.com","phone":"","location":"Pune","summary":"Builder.",
"skills":["een","Python","tion"],"experience":[{"role":"Intern","company":"Acme","period":"2024","bullets":[
{"text":"Cleaned data"},{"text":"Wrote eration tools"},{"text":"Ran tests"},{"text":"Led ention work"},{"text":"Docs"}]}],
"education":[{"degree":"BTech","school":"IIT","year":"2026"},{"degree":"XII","school":"KV"}],"links":["https://x.example.com"]}"""


APPLY_SQL = scored_sql(True).replace("age > 30 THEN 'FAIL", "age > 90 THEN 'FAIL").replace("(> 30d window)", "(> 90d window)")


@query(
    "apply_batch",
    f"""{APPLY_SQL}, {GAPS_SQL.replace(B.DOC_SQL + ",", "", 1)},
ent AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN id WHEN 1 THEN url WHEN 2 THEN 'missing ' || doc_id || 'x' END AS ref FROM doc),
u AS (SELECT url, arg_min(id, doc_id) AS pid FROM doc GROUP BY 1),
r AS (SELECT ref, CASE doc_id % 4 WHEN 0 THEN ref WHEN 1 THEN pid END AS posting_id FROM ent LEFT JOIN u ON ent.ref = u.url)
SELECT coalesce(ref, 'entry#0') AS ref, posting_id, CASE WHEN ref IS NULL THEN 'batch-file' WHEN posting_id IS NULL THEN 'apply-failed' END AS code,
  scored.pass AS pass, scored.score AS score, scored.verdict AS verdict, CASE WHEN posting_id IS NOT NULL THEN coalesce(kw.missing, '') END AS gaps
FROM r LEFT JOIN scored ON scored.id = posting_id LEFT JOIN kw ON kw.id = posting_id""",
)
def apply_batch(spark, sf):
    """Batch documents of one entry each, resolved, gated over 90 days, scored and packed."""
    d, k = B.doc_postings(spark, sf), F.col("doc_id")
    ref = F.when(k % 4 == 0, F.col("id")).when(k % 4 == 1, F.col("url")).when(k % 4 == 2, F.concat(F.lit("missing "), k, F.lit("x")))
    entries, errors = tables.parse_batch_refs(d.select(F.to_json(F.array(F.struct(ref.alias("ref")))).alias("payload")))
    profile = F.from_json(F.lit(PROFILE_JSON), packs.PROFILE_SCHEMA)
    out = apply.apply_batch(entries, errors, d, STUDENT.as_struct(), profile, gap_skills(), B.AS_OF)
    return out.select("ref", "posting_id", "code", "pass", "score", "verdict", F.array_join("pack.gaps", ",").alias("gaps"))


@query(
    "build_packs",
    f"""WITH {GAPS_SQL}, p AS (SELECT doc.id, title, company, coalesce(covered, '') AS c, coalesce(missing, '') AS m FROM doc LEFT JOIN kw USING (id)),
q AS (SELECT *, CASE WHEN c = '' THEN [] ELSE string_split(c, ',') END AS ks FROM p),
b AS (SELECT id, unnest([struct_pack(t := 'Cleaned data', i := 0), struct_pack(t := 'Wrote eration tools', i := 1), struct_pack(t := 'Ran tests', i := 2),
   struct_pack(t := 'Led ention work', i := 3), struct_pack(t := 'Docs', i := 4)]) AS x, ks FROM q),
o AS (SELECT id, x.i AS i, x.t AS t, row_number() OVER (PARTITION BY id ORDER BY len(list_filter(ks, lambda k: contains(lower(x.t), k))) DESC, x.i) AS r FROM b),
tr AS (SELECT id, string_agg(t || '@experience[0].bullets[' || i || ']', ';' ORDER BY r) AS traces, string_agg('- ' || t, chr(10) ORDER BY r) AS bullets FROM o WHERE r <= 4 GROUP BY 1),
sk AS (SELECT id, array_to_string(list_concat(list_filter(['een', 'Python', 'tion'], lambda s: list_contains(ks, lower(s))), list_filter(['een', 'Python', 'tion'], lambda s: NOT list_contains(ks, lower(s)))), ', ') AS skills FROM q)
SELECT q.id, traces, substr('Applying for ' || title || ' at ' || company || ': ' || CASE WHEN c <> '' THEN 'my strongest matches are ' || array_to_string(ks[1:3], ', ') || '.'
    ELSE 'my background is a growth fit for this role.' END || ' Builder.', 1, 600) AS pitch,
  'Hi — I applied for ' || title || ' at ' || company || ' a week ago and wanted to briefly follow up. The role matches my work in ' ||
    CASE WHEN c <> '' THEN array_to_string(ks[1:2], ' and ') ELSE 'this area' END || '. Happy to share anything useful. Thanks!' AS follow_up,
  m AS gaps, array_to_string(['# Asha', 'a@example.com · Pune', '', 'Builder.' || chr(10), '## Skills', skills, '', '## Experience',
    '### Intern — Acme (2024)' || chr(10) || bullets, '', '## Education', '- BTech, IIT (2026)', '- XII, KV', '', '## Links', '- https://x.example.com'], chr(10)) AS resume
FROM q JOIN tr USING (id) JOIN sk USING (id)""",
)
def build_packs(spark, sf):
    profile = F.from_json(F.lit(PROFILE_JSON), packs.PROFILE_SCHEMA)
    d = B.doc_postings(spark, sf).select("id", "title", "company", "description")
    d = packs.build_packs(packs.with_keyword_gaps(d, gap_skills()), profile)
    traces = F.array_join(F.transform("pack.traces", lambda t: F.concat(t["claim"], F.lit("@"), t["source"])), ";")
    return d.select(
        "id", traces.alias("traces"), "pack.pitch", "pack.follow_up", F.array_join("pack.gaps", ",").alias("gaps"), "pack.resume"
    )


@query(
    "salary_vs_baseline",
    f"""WITH {B.CO_SQL} SELECT pos, round((price - 1000) / 1000 * 100, 6) AS vs_baseline,
  CASE WHEN index IS NULL THEN 'N/A' WHEN price IS NULL THEN index ELSE printf('%.1f', round(price, 1)) END AS index_shown,
  CASE WHEN price IS NOT NULL THEN price >= 1000 END AS above FROM co""",
)
def salary_vs_baseline(spark, sf):
    d = R.salary_vs_baseline(B.companies(spark, sf).withColumn("baseline", F.lit(1000.0)))
    return d.select(
        "pos", F.round("vs_baseline", 6).alias("vs_baseline"), "index_shown", F.startswith("difference", F.lit("+")).alias("above")
    )


@query(
    "duplicate_companies",
    f"""WITH {B.CO_SQL}, f AS (SELECT lower(company) AS k, min(pos) AS first_pos FROM co GROUP BY 1 HAVING count(*) > 1)
SELECT company, first_pos, pos FROM co JOIN f ON lower(company) = k WHERE pos > first_pos""",
)
def duplicate_companies(spark, sf):
    return R.duplicate_companies(B.companies(spark, sf))


@query(
    "funnel",
    f"""WITH {B.EVT_SQL}, r AS (SELECT application_id, max(CASE stage WHEN 'drafted' THEN 0 WHEN 'applied' THEN 1 WHEN 'rejected' THEN 1 WHEN 'interview' THEN 2 WHEN 'offer' THEN 3 END) AS reached FROM evt GROUP BY 1)
SELECT stage, count(*) FILTER (WHERE reached >= k) AS applications FROM r, (VALUES ('applied', 1), ('interview', 2), ('offer', 3), ('hired', 4)) s(stage, k) GROUP BY 1""",
)
def funnel(spark, sf):
    return R.funnel(B.application_events(spark, sf))


@query(
    "rejection_rate",
    """SELECT count(*) FILTER (WHERE o_orderkey % 11 IN (5, 6, 9)) AS rejected, count(*) FILTER (WHERE o_orderkey % 11 >= 4) AS closed,
  round(count(*) FILTER (WHERE o_orderkey % 11 IN (5, 6, 9))::DOUBLE / count(*) FILTER (WHERE o_orderkey % 11 >= 4), 9) AS rate FROM orders""",
)
def rejection_rate(spark, sf):
    return R.rejection_rate(B.tracker(spark, sf)).withColumn("rate", F.round("rate", 9))


@query(
    "portal_yield",
    f"""WITH {B.EVT_SQL}, r AS (SELECT application_id, source, max(CASE stage WHEN 'drafted' THEN 0 WHEN 'applied' THEN 1 WHEN 'rejected' THEN 1 WHEN 'interview' THEN 2 WHEN 'offer' THEN 3 END) AS reached FROM evt GROUP BY 1, 2)
SELECT source, count(*) AS applications, count(*) FILTER (WHERE reached >= 2) AS interviews, round(count(*) FILTER (WHERE reached >= 2)::DOUBLE / count(*), 9) AS interview_rate FROM r WHERE reached >= 1 GROUP BY 1""",
)
def portal_yield(spark, sf):
    return R.portal_yield(B.application_events(spark, sf)).withColumn("interview_rate", F.round("interview_rate", 9))


@query(
    "status_buckets",
    """WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'ghosted' ELSE 'x' END AS g, o_orderkey % 11 AS k FROM orders)
SELECT CASE WHEN g = 'ghosted' THEN 'Rejected/Closed' WHEN k = 0 THEN 'Drafted' WHEN k = 1 THEN 'Applied' WHEN k = 2 THEN 'Interview' WHEN k = 3 THEN 'Offer'
   WHEN k = 4 THEN 'Hired' ELSE 'Rejected/Closed' END AS bucket, count(*) AS applications, count(*) FILTER (WHERE g = 'ghosted') AS unrecognised FROM s GROUP BY 1""",
)
def status_buckets(spark, sf):
    t = B.tracker(spark, sf)
    t = t.withColumn("status", F.when(F.col("application_id") % 50 == 0, "Ghosted").otherwise(F.col("status")))
    return R.status_buckets(t)


@query(
    "gap_heatmap",
    f"""WITH {GAP_SOURCES_SQL}, u AS (SELECT *, CASE WHEN tracked THEN coalesce(try_cast(fit_rating AS DOUBLE), rank_score) WHEN rank_score >= 45 THEN rank_score END AS used FROM m)
SELECT lower(gap) AS gap, round(sum((100.0::DOUBLE - used) / 100.0), 6) AS weight, count(*) AS postings, count(*) FILTER (WHERE provenance = 'recorded') AS recorded,
  count(*) FILTER (WHERE provenance = 'inferred') AS inferred FROM u WHERE used IS NOT NULL GROUP BY 1""",
)
def gap_heatmap(spark, sf):
    return R.gap_heatmap(gap_sources(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(
    "gap_coverage",
    f"""WITH {GAP_SOURCES_SQL}, u AS (SELECT *, CASE WHEN tracked THEN coalesce(try_cast(fit_rating AS DOUBLE), rank_score) WHEN rank_score >= 45 THEN rank_score END AS used FROM m)
SELECT count(*) FILTER (WHERE used IS NOT NULL AND tracked) AS tracked, count(*) FILTER (WHERE used IS NOT NULL AND NOT tracked) AS ranked,
  count(*) FILTER (WHERE used IS NULL AND tracked) AS skipped FROM u""",
)
def gap_coverage(spark, sf):
    return R.gap_coverage(gap_sources(spark, sf))


# --- evaluation -------------------------------------------------------------------

LABEL_SQL = "lab AS (SELECT 'doc:' || doc_id AS id, CASE WHEN quality = 0 THEN 'REJECT' WHEN toxic = 1 THEN 'KEEP_WITH_FLAG' ELSE 'KEEP' END AS label FROM labels)"
EVAL_ROWS = " UNION ALL ".join(
    f"SELECT '{c[2:]}' AS gate, starts_with({c}, 'FAIL') AS rejected, starts_with({c}, 'FLAG') AS flagged, label FROM j" for c in GATE_COLS
)
ANY_FLAG = " OR ".join(f"starts_with({c}, 'FLAG')" for c in GATE_COLS)


@query(
    "evaluate_gates",
    f"""{gated_sql(True)}, {LABEL_SQL}, j AS (SELECT * FROM gated JOIN lab USING (id)),
r AS ({EVAL_ROWS} UNION ALL SELECT 'all', NOT pass, {ANY_FLAG}, label FROM j)
SELECT gate, count(*) AS postings,
  round(count(*) FILTER (WHERE rejected AND label <> 'REJECT') / nullif(count(*) FILTER (WHERE label <> 'REJECT'), 0)::DOUBLE, 9) AS false_reject_rate,
  round(count(*) FILTER (WHERE NOT rejected AND label = 'REJECT') / nullif(count(*) FILTER (WHERE label = 'REJECT'), 0)::DOUBLE, 9) AS false_accept_rate,
  round(count(*) FILTER (WHERE flagged AND label = 'KEEP_WITH_FLAG') / nullif(count(*) FILTER (WHERE flagged), 0)::DOUBLE, 9) AS flag_precision FROM r GROUP BY 1""",
)
def evaluate_gates(spark, sf):
    lab = B.table(spark, sf, "labels").select(
        F.concat(F.lit("doc:"), "doc_id").alias("id"),
        F.when(F.col("quality") == 0, "REJECT").when(F.col("toxic") == 1, "KEEP_WITH_FLAG").otherwise("KEEP").alias("label"),
    )
    out = E.evaluate_gates(docs_gated(spark, sf, STUDENT), lab)
    return out.withColumns({c: F.round(c, 9) for c in ("false_reject_rate", "false_accept_rate", "flag_precision")})


@query(
    "evaluate_dedupe",
    f"""WITH {B.PG2_SQL}, k AS (SELECT id, page_id, {SQL_NORM} AS g FROM pg2),
p AS (SELECT 'mirror:' || page_id AS l, 'page:' || page_id AS r, 'tracking' AS kind, 'SAME' AS label FROM pages WHERE url LIKE 'https:%'
  UNION ALL SELECT 'page:' || page_id, 'page:' || (page_id + 1), 'neighbour', 'DIFFERENT' FROM pages)
SELECT kind, count(*) AS pairs, count(*) FILTER (WHERE label = 'SAME' AND a.g = b.g) AS true_merges, count(*) FILTER (WHERE label <> 'SAME' AND a.g = b.g) AS false_merges,
  round(count(*) FILTER (WHERE label = 'SAME' AND a.g = b.g) / nullif(count(*) FILTER (WHERE a.g = b.g), 0)::DOUBLE, 9) AS precision,
  round(count(*) FILTER (WHERE label = 'SAME' AND a.g = b.g) / nullif(count(*) FILTER (WHERE label = 'SAME'), 0)::DOUBLE, 9) AS recall
FROM p JOIN k a ON a.id = l JOIN k b ON b.id = r GROUP BY 1""",
)
def evaluate_dedupe(spark, sf):
    groups = dedupe.with_dedupe_key(pools(spark, sf)).select("id", F.col("dedupe_key").alias("group"))
    k = F.col("page_id")
    p = B.table(spark, sf, "pages").select("page_id", "url")
    page = F.concat(F.lit("page:"), k)
    same = p.filter(F.startswith("url", F.lit("https:"))).select(
        F.concat(F.lit("mirror:"), k).alias("left_id"), page.alias("right_id"), F.lit("tracking").alias("kind"), F.lit("SAME").alias("label")
    )
    other = p.select(page.alias("left_id"), F.concat(F.lit("page:"), k + 1).alias("right_id"), F.lit("neighbour").alias("kind"), F.lit("DIFFERENT").alias("label"))
    out = E.evaluate_dedupe(same.union(other), groups)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query(
    "rank_stability",
    f"""WITH s AS (SELECT p_partkey AS id, CAST((p_partkey * 7) % 101 AS INTEGER) AS a, CAST(((p_partkey * 7) % 101 + p_partkey % 9) % 101 AS INTEGER) AS b FROM part),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM s),
t AS (SELECT count(*) AS n FROM (SELECT id FROM s ORDER BY a DESC, id LIMIT 10) JOIN (SELECT id FROM s ORDER BY b DESC, id LIMIT 10) USING (id))
SELECT count(*) AS postings, round(corr(ra, rb), 6) AS spearman, (SELECT n FROM t) AS top_k_overlap,
  count(*) FILTER (WHERE {BAND_SQL.format('a')} <> {BAND_SQL.format('b')}) AS band_churn, round(sqrt(avg((a - b) * (a - b) / 2.0::DOUBLE)), 6) AS score_sigma FROM r""",
)
def rank_stability(spark, sf):
    k = F.col("p_partkey")
    p = B.table(spark, sf, "part")
    first = p.select(k.alias("id"), ((k * 7) % 101).cast("int").alias("score"))
    second = p.select(k.alias("id"), (((k * 7) % 101 + k % 9) % 101).cast("int").alias("score"))
    out = E.rank_stability(first, second)
    return out.withColumns({c: F.round(c, 6) for c in ("spearman", "score_sigma")})


# --- seen store -------------------------------------------------------------------

EXCLUDE = ("part:14", "part:2", "part:33")
EXCLUDE_SQL = "('part:14', 'part:2', 'part:33')"


@query(
    "select_candidates",
    f"""WITH {B.SEEN_SQL}, {B.TRKS_SQL} SELECT key, title, company, url, portal, deadline, posted_date FROM seen s WHERE status = 'new'
  AND NOT EXISTS (SELECT 1 FROM trks t WHERE regexp_replace(lower(t.company), '[^a-z0-9]', '', 'g') = regexp_replace(lower(s.company), '[^a-z0-9]', '', 'g') AND t.role = s.title)
  AND contains(lower(title || ' ' || company || ' ' || strength || ' ' || gap), 'ring') ORDER BY p_partkey % 200 DESC, key LIMIT 10""",
)
def select_candidates(spark, sf):
    s, _ = state.select_candidates(B.seen_store(spark, sf), B.seen_tracker(spark, sf), focus="RING")
    return s


@query(
    "candidate_report",
    f"""WITH {B.SEEN_SQL}, {B.TRKS_SQL}, m AS (SELECT *, status <> 'skipped' AS wanted, EXISTS (SELECT 1 FROM trks t WHERE lower(t.company) = lower(s.company) AND t.role = s.title) AS tracked,
   contains(lower(title || ' ' || company || ' ' || strength || ' ' || gap), 'ring') AS focus FROM seen s)
SELECT count(*) FILTER (WHERE wanted AND NOT tracked AND focus) AS eligible, greatest(count(*) FILTER (WHERE wanted AND NOT tracked AND focus) - 10, 0) AS deferred,
  count(*) FILTER (WHERE wanted AND tracked) AS excluded_by_tracker, count(*) AS total_entries FROM m""",
)
def candidate_report(spark, sf):
    _, report = state.select_candidates(B.seen_store(spark, sf), B.seen_tracker(spark, sf), focus="ring", everything=True)
    return report


@query(
    "focus_filter",
    f"WITH {B.SEEN_SQL} SELECT key FROM seen WHERE contains(lower(title || ' ' || company || ' ' || strength || ' ' || gap), 'promo')",
)
def focus_filter(spark, sf):
    from rolebook.operators.filters import focus_filter as ff

    return ff(B.seen_store(spark, sf), "Promo").select("key")


T1_SQL = f"""{B.SEEN_SQL}, {B.SCORES_SQL}, sc AS (SELECT *, {overall_sql("'experienced'").replace('t *', 'technical *').replace('e *', 'experience *').replace('b *', 'behavioral *').replace('c *', 'career *')} AS score FROM scores),
j AS (SELECT s.*, r.status AS r_status, r.score, r.key IS NOT NULL AND coalesce(r.status, '') <> 'expired' AND r.score IS NOT NULL AS ranked,
   r.location_verdict AS r_lv, r.language_gate AS r_gate, r.language_note AS r_note, r.deadline AS r_deadline, r.has_strengths
   FROM seen s LEFT JOIN sc r ON s.key = r.key),
after AS (SELECT key, CASE WHEN r_status = 'expired' THEN 'expired' WHEN ranked THEN 'ranked' ELSE status END AS status,
   CASE WHEN ranked AND location IN ('PASS', 'FAIL') THEN NULL ELSE location END AS location,
   CASE WHEN ranked THEN coalesce(r_lv, location_verdict) ELSE location_verdict END AS location_verdict,
   CASE WHEN ranked THEN coalesce(r_gate, language_gate) ELSE language_gate END AS language_gate,
   CASE WHEN ranked AND r_gate = 'PASS' THEN NULL WHEN ranked AND r_gate IS NOT NULL THEN coalesce(r_note, language_note) ELSE language_note END AS language_note,
   CASE WHEN ranked THEN coalesce(r_deadline, deadline) ELSE deadline END AS deadline,
   CASE WHEN ranked AND has_strengths THEN 's1,s2,s3' ELSE strength END AS strengths, gap AS gaps,
   CASE WHEN ranked THEN score ELSE rank_score END AS rank_score,
   CASE WHEN ranked THEN {BAND_SQL.format('score')} ELSE rank_verdict END AS rank_verdict,
   CAST(CASE WHEN ranked THEN DATE '2024-04-30' ELSE rank_date END AS VARCHAR) AS rank_date,
   CASE WHEN ranked AND rank_score IS NOT NULL THEN rank_score || '/' || rank_verdict || '/' || CAST(rank_date AS VARCHAR) ELSE '' END AS history,
   CASE WHEN r_status = 'expired' THEN 'expired' WHEN ranked THEN 'ranked' END AS outcome, CASE WHEN ranked THEN rank_score END AS prev_score FROM j)"""


def scored_store(spark, sf):
    return state.apply_scores(B.seen_store(spark, sf), B.score_results(spark, sf), B.AS_OF)


@query(
    "apply_scores",
    f"WITH {T1_SQL} SELECT * FROM after",
)
def apply_scores(spark, sf):
    out, _ = scored_store(spark, sf)
    history = F.array_join(F.transform("rank_history", lambda h: F.concat_ws("/", h["score"].cast("string"), h["verdict"], h["date"])), ";")
    return out.select(
        "key", "status", "location", "location_verdict", "language_gate", "language_note", "deadline",
        F.array_join("strengths", ",").alias("strengths"), F.array_join("gaps", ",").alias("gaps"), "rank_score", "rank_verdict",
        F.col("rank_date").cast("string").alias("rank_date"), history.alias("history"), "outcome", "prev_score",
    )


@query(
    "score_store",
    f"WITH {T1_SQL} SELECT key, status, location, location_verdict, language_gate, language_note, deadline, rank_score, rank_verdict, rank_date, history FROM after",
)
def score_store(spark, sf):
    """The written store scored by two deltas, folded after the first: as one rewrite."""
    root = scratch_path(spark, "scored")
    sinks.write_seen(B.seen_store(spark, sf), root, 1)
    results = B.score_results(spark, sf)
    half = F.pmod(F.hash("key"), F.lit(2)) == 0
    state.score_store(spark, root, results.filter(half), B.AS_OF)
    sinks.fold(spark, root)
    state.score_store(spark, root, results.filter(~half), B.AS_OF)
    history = F.array_join(F.transform("rank_history", lambda h: F.concat_ws("/", h["score"].cast("string"), h["verdict"], h["date"])), ";")
    return sinks.read_seen(spark, root).select(
        "key", "status", "location", "location_verdict", "language_gate", "language_note", "deadline", "rank_score", "rank_verdict", F.col("rank_date").cast("string").alias("rank_date"), history.alias("history")
    )


REPEATS_SQL = f"""WITH {B.SEEN_SQL}, {B.SCORES_SQL},
swapped AS (SELECT * REPLACE (career AS technical, technical AS career) FROM scores WHERE part_no % 4 = 0),
sc AS (SELECT *, {overall_sql("'experienced'").replace('t *', 'technical *').replace('e *', 'experience *').replace('b *', 'behavioral *').replace('c *', 'career *')} AS score FROM scores),
sc2 AS (SELECT key, {overall_sql("'experienced'").replace('t *', 'technical *').replace('e *', 'experience *').replace('b *', 'behavioral *').replace('c *', 'career *')} AS score FROM swapped),
j AS (SELECT s.key, s.rank_score, s.rank_verdict, s.rank_date,
   CASE WHEN r.status IS NULL THEN r.score END AS s1, r2.score AS s2
   FROM seen s LEFT JOIN sc r ON s.key = r.key LEFT JOIN sc2 r2 ON s.key = r2.key),
h AS (SELECT *, coalesce(s2, s1, rank_score) AS now,
   CASE WHEN rank_score IS NOT NULL AND coalesce(s1, s2) IS NOT NULL THEN rank_score || '/' || rank_verdict || '/' || CAST(rank_date AS VARCHAR) END AS h0,
   CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 || '/' || {BAND_SQL.format('s1')} || '/2024-04-30' END AS h1 FROM j)
SELECT key, now AS rank_score, concat_ws(';', h0, h1) AS history FROM h"""


@query("apply_scores_repeats", REPEATS_SQL.replace("part_no", "CAST(split_part(key, ':', 2) AS BIGINT)"))
def apply_scores_repeats(spark, sf):
    """A second result for every fourth key: applied in order, the store keeps its size."""
    first = B.score_results(spark, sf).withColumn("n", F.lit(0))
    s = F.col("scores")
    swapped = s.withField("technical", s["career"]).withField("career", s["technical"])
    again = first.where(F.substring_index("key", ":", -1).cast("long") % 4 == 0).withColumn("scores", swapped)
    again = again.withColumns({"n": F.lit(1), "status": F.lit(None).cast("string")})
    out, _ = state.apply_scores(B.seen_store(spark, sf), first.unionByName(again), B.AS_OF)
    history = F.array_join(F.transform("rank_history", lambda h: F.concat_ws("/", h["score"].cast("string"), h["verdict"], h["date"])), ";")
    return out.select("key", "rank_score", history.alias("history"))


@query(
    "apply_scores_errors",
    f"""WITH {B.SEEN_SQL}, {B.SCORES_SQL} SELECT r.key, CASE WHEN s.key IS NULL THEN 'no such key in the seen store' ELSE 'missing or non-numeric score ''technical''' END AS error
FROM scores r LEFT JOIN seen s ON r.key = s.key WHERE s.key IS NULL OR (technical IS NULL AND coalesce(r.status, '') <> 'expired')""",
)
def apply_scores_errors(spark, sf):
    return scored_store(spark, sf)[1]


@query(
    "rank_report",
    f"""WITH {T1_SQL} SELECT key, rank_score, rank_verdict, coalesce(date_diff('day', DATE '2024-04-30', try_cast(deadline AS DATE)) BETWEEN 0 AND 7, false) AS urgent,
  location_verdict = 'FAIL' OR language_gate = 'FAIL' AS vetoed FROM after WHERE outcome = 'ranked'""",
)
def rank_report(spark, sf):
    out, _ = scored_store(spark, sf)
    ranked, vetoed = S.rank_report(out.filter(F.col("outcome") == "ranked"), B.AS_OF)
    cols = ["key", "rank_score", "rank_verdict", "urgent"]
    return ranked.select(*cols, F.lit(False).alias("vetoed")).union(vetoed.select(*cols, F.lit(True)))


@query(
    "score_movement",
    f"""WITH {T1_SQL} SELECT CASE WHEN prev_score IS NULL THEN NULL WHEN {BAND_SQL.format('prev_score')} <> rank_verdict THEN 'band' WHEN abs(rank_score - prev_score) <= 5 THEN 'noise' ELSE 'drift' END AS movement,
  count(*) AS n FROM after WHERE outcome = 'ranked' GROUP BY 1""",
)
def score_movement(spark, sf):
    out, _ = scored_store(spark, sf)
    moved = S.movement(F.col("prev_score"), F.col("rank_score"))
    return out.filter(F.col("outcome") == "ranked").groupBy(moved.alias("movement")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "sweep",
    f"""WITH {B.SEEN_SQL} SELECT key, CASE WHEN deadline IS NULL THEN 'ok' WHEN deadline = 'ASAP' THEN 'unparseable' WHEN CAST(deadline AS DATE) < DATE '2024-04-30' THEN 'expired'
  WHEN CAST(deadline AS DATE) <= DATE '2024-05-07' THEN 'closing' ELSE 'ok' END AS sweep FROM (SELECT key, nullif(deadline, 'ASAP') AS d, deadline FROM seen WHERE status = 'ranked' AND key NOT IN {EXCLUDE_SQL})""",
)
def sweep(spark, sf):
    return state.sweep(B.seen_store(spark, sf), B.AS_OF, EXCLUDE).select("key", "sweep")


@query(
    "sweep_and_compact",
    f"""WITH {B.SEEN_SQL}, s AS (SELECT *, CASE WHEN status = 'ranked' AND try_cast(deadline AS DATE) < DATE '2024-04-30' THEN 'expired' ELSE status END AS st FROM seen),
c AS (SELECT st, st IN ('skipped', 'expired') AND coalesce(try_cast(deadline AS DATE) < DATE '2024-04-30', true) AND coalesce(CAST(posted_date AS DATE) <= DATE '2024-04-30' - 90, false)
   AND key NOT IN {EXCLUDE_SQL} AS dropped FROM s)
SELECT st AS status, dropped, count(*) AS n FROM c GROUP BY 1, 2""",
)
def sweep_and_compact(spark, sf):
    """Over a store written by status, so each step reads what it needs."""
    root = scratch_path(spark, "store")
    sinks.write_seen(B.seen_store(spark, sf), root, 1)
    swept = state.apply_sweep(sinks.read_seen(spark, root), B.AS_OF)
    kept, dropped = state.compact(swept, B.AS_OF, EXCLUDE)
    both = kept.select("status", F.lit(False).alias("dropped")).union(dropped.select("status", F.lit(True)))
    return both.groupBy("status", "dropped").agg(F.count(F.lit(1)).alias("n"))


@query(
    "compact",
    f"""WITH {B.SEEN_SQL} SELECT key, title, company, portal, posted_date, status FROM seen WHERE status IN ('skipped', 'expired')
  AND coalesce(try_cast(deadline AS DATE) < DATE '2024-04-30', true) AND CAST(posted_date AS DATE) <= DATE '2024-04-30' - 90 AND key NOT IN {EXCLUDE_SQL}""",
)
def compact(spark, sf):
    _, dropped = state.compact(B.seen_store(spark, sf), B.AS_OF, EXCLUDE)
    return dropped.select("key", "title", "company", "portal", "posted_date", "status")


@query(
    "migrate_seen",
    f"""WITH {B.SEEN_SQL} SELECT key, CASE WHEN location NOT IN ('PASS', 'FAIL') THEN location END AS location, CASE WHEN p_partkey % 2 = 0 THEN location_verdict WHEN location IN ('PASS', 'FAIL') THEN location END AS location_verdict FROM seen""",
)
def migrate_seen(spark, sf):
    s = B.seen_store(spark, sf)
    s = s.withColumn("location_verdict", F.when(F.col("p_partkey") % 2 == 0, F.col("location_verdict")))
    return state.migrate_seen(s).select("key", "location", "location_verdict")


# --- tracker over time -------------------------------------------------------------

FOLLOW_AS_OF = "1998-06-30"
ACT_SQL = f"""{B.TRK_SQL}, act AS (SELECT l_orderkey AS application_id, max(CAST(l_shipdate AS DATE)) AS last, count(*) FILTER (WHERE l_linenumber % 3 = 1) AS followups
   FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-06-30' GROUP BY 1),
q AS (SELECT trk.application_id, coalesce(followups, 0) AS followups, CAST(DATE '1998-06-30' - greatest(date, coalesce(last, date)) AS INTEGER) AS days_quiet
   FROM trk LEFT JOIN act USING (application_id) WHERE application_id % 11 IN (1, 2, 3) AND date <= DATE '1998-06-30')"""


def activity(spark, sf):
    li = B.table(spark, sf, "lineitem")
    at = F.col("l_shipdate").cast("date")
    return li.filter(at <= F.lit(FOLLOW_AS_OF).cast("date")).select(
        F.col("l_orderkey").alias("application_id"), at.alias("at"),
        F.when(F.col("l_linenumber") % 3 == 1, "followup").otherwise("note").alias("kind"),
    )


def sent_by(spark, sf):
    return B.tracker(spark, sf).filter(F.col("date") <= F.lit(FOLLOW_AS_OF).cast("date"))


@query("followups_due", f"WITH {ACT_SQL} SELECT application_id, days_quiet, followups FROM q WHERE days_quiet >= 7 AND followups < 2")
def followups_due(spark, sf):
    out = state.followups_due(sent_by(spark, sf), activity(spark, sf), FOLLOW_AS_OF)
    return out.select("application_id", "days_quiet", "followups")


@query("stale_applications", f"WITH {ACT_SQL} SELECT application_id, days_quiet FROM q WHERE days_quiet >= 30")
def stale_applications(spark, sf):
    return state.stale_applications(sent_by(spark, sf), activity(spark, sf), FOLLOW_AS_OF).select("application_id", "days_quiet")


SIGNAL_TEXT = {
    0: " You have been shortlisted.", 1: " Your application was viewed.", 2: " We received your application.",
    3: " On to the next round!", 4: "",
}


@query(
    "advance_status",
    f"""WITH {B.TRK_SQL}, sig AS (SELECT conv_id AS application_id, DATE '1999-01-01' + CAST(turn AS INTEGER) AS day, CASE WHEN regexp_matches(lower(text), 'application was viewed|viewed your application') THEN NULL
    WHEN (conv_id + turn) % 5 IN (0, 3) OR regexp_matches(lower(text), 'shortlisted|next[ -]round') THEN CASE WHEN (conv_id + turn) % 5 = 1 THEN NULL ELSE 2 END WHEN (conv_id + turn) % 5 = 2 THEN 1 END AS k FROM conversations),
b AS (SELECT application_id, max(k) AS k, max(day) FILTER (WHERE k = 1) AS ack FROM sig WHERE k IS NOT NULL GROUP BY 1),
j AS (SELECT t.application_id, date, replace(status, ' ', '_') AS st, k, ack, application_id % 11 >= 4 AS final,
   CASE application_id % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS cur FROM trk t LEFT JOIN b USING (application_id)),
m AS (SELECT *, NOT final AND coalesce(k > cur, false) AS moves FROM j)
SELECT application_id, CASE WHEN moves THEN CASE k WHEN 1 THEN 'applied' ELSE 'interview' END ELSE st END AS status,
  CAST(CASE WHEN moves AND st = 'drafted' AND ack IS NOT NULL THEN ack ELSE date END AS VARCHAR) AS date, CASE WHEN moves THEN 'advanced' END AS change FROM m
UNION ALL SELECT application_id, 'applied', CAST(ack AS VARCHAR), 'reapplied' FROM m WHERE final AND ack > date""",
)
def advance_status(spark, sf):
    c = B.table(spark, sf, "conversations")
    signals = c.select(
        F.col("conv_id").alias("application_id"),
        F.date_add(F.lit("1999-01-01").cast("date"), F.col("turn").cast("int")).alias("at"),
        F.concat("text", B.choose((F.col("conv_id") + F.col("turn")) % 5, SIGNAL_TEXT)).alias("text"),
    )
    out = state.advance_status(B.tracker(spark, sf), signals)
    return out.select("application_id", "status", F.col("date").cast("string").alias("date"), "change")


# --- stream -----------------------------------------------------------------------


@query(
    "stream_ingest",
    f"""WITH {B.PG2_SQL}, k AS (SELECT *, {SQL_NORM} AS key FROM pg2)
SELECT key, 'new' AS status, count(*) - count(*) AS repeats FROM k GROUP BY 1""",
)
def stream_ingest(spark, sf):
    """Pages land in two waves (the mirror second) and are ingested by two
    runs of the stream; every key is stored once."""
    landing, out = (scratch_path(spark, n) for n in ("landing", "ingested"))
    p = pools(spark, sf)
    late = F.col("portal") == "mirror"
    landed = p.select(
        "id", "title", "company", "location", F.col("posted_date").cast("string").alias("posted_date"), "url", "portal",
        F.lit(None).cast("string").alias("deadline"),
        F.when(late, F.lit("2024-05-02")).otherwise(F.lit("2024-05-01")).cast("timestamp").alias("ingested_at"),
    )
    for wave in (~late, late):
        landed.filter(wave).write.mode("append").parquet(landing)
        ingest.stream_ingest(spark, landing, out).awaitTermination()
    rows = ingest.read_table(spark, out)
    return rows.groupBy("key", "status").agg((F.count(F.lit(1)) - 1).alias("repeats"))


@query(
    "stream_entries",
    f"""WITH {B.PG2_SQL}, k AS (SELECT *, {SQL_NORM} AS key, CASE WHEN portal = 'mirror' THEN TIMESTAMP '2024-05-02' ELSE TIMESTAMP '2024-05-01' END AS seen_at,
  CASE WHEN page_id % 3 = 0 THEN CAST(DATE '2024-05-04' + CAST(page_id % 5 AS INTEGER) AS VARCHAR) WHEN page_id % 3 = 1 THEN 'ASAP' END AS deadline FROM pg2),
a AS (SELECT id, key, seen_at, deadline, page_id FROM k UNION ALL
  SELECT 'old:' || page_id, key, TIMESTAMP '2024-04-01', NULL, page_id FROM k WHERE portal <> 'mirror' AND page_id % 4 = 0),
f AS (SELECT key, arg_min(id, (seen_at, id)) AS id, min(seen_at) AS first_seen FROM a GROUP BY key),
-- the rows that came first in each wave tell the deadline: an older row without one keeps it
w AS (SELECT key, first(deadline ORDER BY seen_at, id) AS deadline FROM k GROUP BY key),
c AS (SELECT key, min(page_id) % 101 AS score FROM k WHERE page_id % 2 = 0 GROUP BY key)
SELECT key, id, CAST(first_seen AS DATE) AS first_seen, CASE WHEN score IS NULL THEN 'new' WHEN try_cast(deadline AS DATE) < DATE '2024-05-06' THEN 'expired' ELSE 'ranked' END AS status,
  CAST(score AS INTEGER) AS score, deadline FROM f JOIN w USING (key) LEFT JOIN c USING (key)""",
)
def stream_entries(spark, sf):
    """Postings, their mirror, older sights that land late, scores, a replay of the first wave, and a day that
    lets deadlines pass: each a run of the keyed stream."""
    landing, out = (scratch_path(spark, n) for n in ("landing", "entries"))
    k = F.col("page_id")
    stamp = lambda c: F.lit(c).cast("timestamp") if isinstance(c, str) else c
    due = F.when(k % 3 == 0, F.date_add(F.lit("2024-05-04").cast("date"), (k % 5).cast("int")).cast("string")).when(k % 3 == 1, "ASAP")
    p = dedupe.with_dedupe_key(pools(spark, sf)).withColumnRenamed("dedupe_key", "key").withColumn("deadline", due)
    late = F.col("portal") == "mirror"
    none = F.lit(None).cast("string")

    def land(rows, seen, landed, score=F.lit(None), deadline=F.col("deadline"), name=F.col("id")):
        rows.select(
            name.alias("id"), "title", "company", "location", F.col("posted_date").cast("string").alias("posted_date"), "url", "portal",
            deadline.alias("deadline"), score.cast("int").alias("score"), "key", stamp(seen).alias("seen_at"), stamp(landed).alias("landed_at"),
        ).write.mode("append").parquet(landing)
        keyed.run(spark, landing, out).awaitTermination()

    land(p.filter(~late), "2024-05-01", "2024-05-01")
    land(p.filter(late), "2024-05-02", "2024-05-02")
    land(p.filter(~late & (k % 4 == 0)), "2024-04-01", "2024-05-03", deadline=none, name=F.concat(F.lit("old:"), k))
    scored = p.filter(k % 2 == 0).groupBy("key").agg((F.min("page_id") % 101).alias("s"))
    empty = [none.alias(c) for c in ("id", "title", "company", "location", "posted_date", "url", "portal", "deadline")]
    land(scored.select("key", "s", *empty), "2024-05-03", "2024-05-03", score=F.col("s"))
    land(p.filter(~late), "2024-05-01", "2024-05-06")
    out = keyed.entries(spark, out)
    return out.select("key", "id", F.col("first_seen").cast("date").alias("first_seen"), "status", "score", "deadline")
