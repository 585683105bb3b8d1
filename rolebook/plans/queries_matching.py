"""Registered queries: gates, scores and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import gates as G
from rolebook.operators import scoring as S
from rolebook.plans import bindings as B
from rolebook.plans.registry import query

STUDENT = S.Candidate(
    "c-student", "student", ("tion", "of the", "python", "een"), ("Bengaluru", "Remote"), 2026, 20000.0, None, "india"
)
EXPERIENCED = S.Candidate("c-exp", "experienced", ("the", "and", "python"), (), None, None, 12.0, "global")


# The expected patterns, written out for RE2 apart from those under test.
TERM = r"(?:batch|graduat(?:ing|es|ion|ors?)?|pass\s?out|passing\s+out|class\s+of|cohort|fresher)"
NEAR = rf"(?i)\b20\d{{2}}\b[^.;!?|\n]{{0,30}}?\b{TERM}\b|\b{TERM}\b[^.;!?|\n]{{0,30}}?\b20\d{{2}}\b"
ONLY = r"(?i)\b(?:only|exclusively|exclusive|restricted)\b"
FLUENT = r"(?i)fluent\s+(?:in\s+)?([a-z]+)"
REQUIRED = (
    r"(?i)(?:hindi|kannada|tamil|telugu|malayalam|marathi|bengali|german|french|spanish|japanese|mandarin)"
    r"\s*(?:required|must|essential)"
)
BOND = r"(?i)(?:service (?:agreement|bond)|training bond|bond of [\w\s]+years?)[^.]{0,80}"
MONTHLY = r"per\s+month|per\s+mo\b|/\s*month|/\s*mo\b|monthly"
LAKHS = r"\blpa\b|\blakhs?\b"
ANNUAL = r"per\s+annum\b|\bannually\b|/\s*yr\b"


def money_sql(unit: str) -> str:
    a, cur, gap = r"(\d[\d,]*(?:\.\d+)?)", r"(?:₹|rs\.?\s*|inr\s*)", r"[^.;!?|\n]{0,20}?"
    readings = (
        rf"(?i)(?:₹|rs\.?\s+|inr\s*)?{a}\s*(?:{unit})",
        rf"(?i)(?:{unit})\s*(?:of\s+|is\s+|about\s+|around\s+|up\s+to\s+)?{cur}?{a}",
        rf"(?i)(?:{unit}){gap}{cur}{a}",
        rf"(?i)(?:{unit}){gap}\bof\s+{cur}?{a}",
    )
    return "coalesce(" + ", ".join(f"try_cast(replace(regexp_extract(d, '{r}', 1), ',', '') AS DOUBLE)" for r in readings) + ")"


FACTS_SQL = f"""facts AS (
  SELECT *, length(trim(regexp_replace(d, '\\s+', ' ', 'g'))) > 0 AS has_text,
    CASE WHEN nullif(lower(regexp_extract(d, '{FLUENT}', 1)), '') <> 'english' THEN regexp_extract(d, '{FLUENT}', 0)
         ELSE nullif(regexp_extract(d, '{REQUIRED}', 0), '') END AS language,
    {money_sql(MONTHLY)} AS monthly,
    coalesce({money_sql(LAKHS)}, {money_sql(ANNUAL)} / 100000.0) AS lpa,
    trim(replace(regexp_replace(nullif(regexp_extract(d, '{BOND}', 0), ''), '[\\r\\n]+', ' ', 'g'), '|', '\\|')) AS bond,
    list_sort(list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(d, '{NEAR}'), ' '), '\\b20\\d{{2}}\\b'))) AS years,
    len(list_filter(string_split_regex(d, '[.;!?]'), lambda s: regexp_matches(s, '{NEAR}') AND (
        regexp_matches(s, '{ONLY}[\\s\\S]*(?:{NEAR})') OR regexp_matches(s, '(?:{NEAR})[^\\n]*{ONLY}')
        OR regexp_matches(array_to_string(regexp_extract_all(s, '{NEAR}'), ' '), '{ONLY}')))) > 0 AS exclusive
  FROM (SELECT *, description AS d, CAST(DATE '2024-04-30' - posted_date AS INTEGER) AS age FROM doc))"""

NE = vocab.NOT_EVALUATED_NOTE
NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
MONTHLY_SHOWN = NUM.format("monthly")


def gates_sql(student: bool) -> str:
    """The seven results as text columns ``verdict`` and ``note`` per gate."""
    text = f"CASE WHEN NOT has_text THEN 'PASS~{NE}' ELSE "
    location = (
        "CASE WHEN location IS NULL THEN 'FAIL~location unstated (source gave none)' "
        "WHEN contains(replace(lower(location), 'bangalore', 'bengaluru'), 'bengaluru') OR contains(lower(location), 'remote') THEN 'PASS~' "
        "ELSE 'FAIL~location \"' || location || '\" outside accepted set' END"
        if student
        else "'PASS~'"
    )
    batch = (
        text + "CASE WHEN len(years) = 0 OR list_contains(years, '2026') THEN 'PASS~' "
        "WHEN exclusive THEN 'FAIL~batch-restricted to ' || array_to_string(years, '/') || ' (candidate: 2026)' "
        "ELSE 'FLAG~mentions batches ' || array_to_string(years, '/') || ' (candidate: 2026)' END END"
        if student
        else "'PASS~'"
    )
    stipend = (
        text + f"CASE WHEN monthly IS NULL THEN 'FLAG~no stipend stated' WHEN monthly < 20000 THEN "
        f"'FAIL~stipend ' || {MONTHLY_SHOWN} || ' < floor 20000/month' ELSE 'PASS~' END END"
        if student
        else "'PASS~'"
    )
    ctc = (
        "'PASS~'"
        if student
        else text + "CASE WHEN lpa IS NULL THEN 'FLAG~no CTC stated' WHEN lpa < 12 THEN "
        "'FLAG~CTC ~' || printf('%.1f', lpa) || ' LPA < floor 12 LPA' ELSE 'PASS~' END END"
    )
    return f"""
    CASE WHEN age IS NULL THEN 'FLAG~no posting date; freshness unknown'
         WHEN age > 30 THEN 'FAIL~posted ' || age || 'd ago (> 30d window)' ELSE 'PASS~' END AS g_stale,
    {location} AS g_location,
    {text} CASE WHEN language IS NOT NULL THEN 'FAIL~requires working language: "' || language || '"' ELSE 'PASS~' END END AS g_language,
    {batch} AS g_batch, {stipend} AS g_stipend, {ctc} AS g_ctc,
    {text} CASE WHEN bond IS NOT NULL THEN 'FLAG~bond terms: "' || bond || '"' ELSE 'PASS~' END END AS g_bond"""


GATE_COLS = [f"g_{g}" for g in vocab.GATE_NAMES]
PASS_SQL = " AND ".join(f"NOT starts_with({c}, 'FAIL')" for c in GATE_COLS)


def gated_sql(student: bool) -> str:
    return (
        f"WITH {B.DOC_SQL}, {FACTS_SQL}, gated0 AS (SELECT *, {gates_sql(student)} FROM facts), "
        f"gated AS (SELECT *, {PASS_SQL} AS pass FROM gated0)"
    )


def gate_text(i: int):
    g = F.col("gates")[i]
    return F.concat(g["verdict"], F.lit("~"), g["note"])


def docs_gated(spark, sf, cand):
    return S.gated(B.doc_postings(spark, sf), cand.as_struct(), B.AS_OF, with_text=True)


for _i, _name in enumerate(vocab.GATE_NAMES):

    def _one(spark, sf, i=_i):
        cand = EXPERIENCED if vocab.GATE_NAMES[i] == "ctc" else STUDENT
        return docs_gated(spark, sf, cand).select("id", gate_text(i).alias("result"))

    query(f"gate_{_name}", f"{gated_sql(_name != 'ctc')} SELECT id, g_{_name} AS result FROM gated")(_one)


@query(
    "text_facts",
    f"""WITH {B.DOC_SQL}, {FACTS_SQL} SELECT id, has_text, language, array_to_string(years, '/') AS years, exclusive, monthly, lpa, bond FROM facts""",
)
def text_facts(spark, sf):
    d = G.with_text_facts(B.doc_postings(spark, sf))
    f = F.col("facts")
    return d.select(
        "id", f["has_text"].alias("has_text"), f["language"].alias("language"),
        F.array_join(G.batch_years(f), "/").alias("years"), G.batch_exclusive(f).alias("exclusive"),
        f["monthly"].alias("monthly"), f["lpa"].alias("lpa"), f["bond"].alias("bond"),
    )


@query(
    "not_evaluated",
    f"""WITH {B.DOC_SQL} SELECT id, '{NE}' AS note, CASE WHEN DATE '2024-04-30' - posted_date > 30 THEN false
  WHEN location IS NULL OR location = 'Mumbai' THEN false ELSE true END AS pass FROM doc""",
)
def not_evaluated(spark, sf):
    d = S.gated(B.doc_postings(spark, sf), STUDENT.as_struct(), B.AS_OF, with_text=False)
    return d.select("id", F.col("gates")[2]["note"].alias("note"), "pass")


BLANK_DOC_SQL = B.DOC_SQL.replace("doc AS (", "doc0 AS (", 1) + """,
doc AS (SELECT * REPLACE (CASE WHEN doc_id % 13 = 0 THEN '' ELSE description END AS description) FROM doc0)"""


@query(
    "not_evaluated_blank",
    gated_sql(True).replace(B.DOC_SQL, BLANK_DOC_SQL, 1) + " SELECT id, g_language AS result FROM gated",
)
def not_evaluated_blank(spark, sf):
    """Texts that are empty here and there: their text gates pass unevaluated."""
    d = B.doc_postings(spark, sf)
    d = d.withColumn("description", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("description")))
    return S.gated(d, STUDENT.as_struct(), B.AS_OF, with_text=True).select("id", gate_text(2).alias("result"))


@query(
    "run_gates",
    f"{gated_sql(True)} SELECT id, pass, {' || chr(10) || '.join(GATE_COLS)} AS results FROM gated",
)
def run_gates(spark, sf):
    d = docs_gated(spark, sf, STUDENT)
    return d.select("id", "pass", F.concat_ws("\n", *[gate_text(i) for i in range(7)]).alias("results"))


POLICY_SQL = f"""{gated_sql(True)}, r AS (SELECT id, unnest([
  struct_pack(gate := 'location', v := g_location), struct_pack(gate := 'language', v := g_language),
  struct_pack(gate := 'batch', v := g_batch), struct_pack(gate := 'stipend', v := g_stipend),
  struct_pack(gate := 'bond', v := g_bond)], recursive := true) FROM gated)
SELECT gate, split_part(v, '~', 1) AS verdict, gate = 'language' AND starts_with(v, 'FAIL') AS hard_stop, count(*) AS n
FROM r GROUP BY 1, 2, 3"""


@query("gate_policy", POLICY_SQL)
def gate_policy(spark, sf):
    d = docs_gated(spark, sf, STUDENT)
    d = G.apply_gate_policy(d, F.lit("student"), F.lit("india"))
    r = d.select(F.explode("policy_gates").alias("g"))
    return r.groupBy("g.gate", "g.verdict", "g.hard_stop").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gates_for_stage",
    """WITH p(gate, stages, markets) AS (VALUES ('eligibility', ['*'], ['*']), ('language', ['*'], ['*']),
  ('stipend', ['student'], ['india']), ('batch', ['student', 'fresher'], ['*']), ('bond', ['*'], ['india']),
  ('notice-period', ['experienced'], ['*']), ('compensation', ['fresher', 'experienced'], ['*']),
  ('timezone-overlap', ['remote-global'], ['*']), ('location', ['*'], ['*'])),
c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'student' WHEN 1 THEN 'fresher' WHEN 2 THEN 'experienced' ELSE 'remote-global' END AS stage,
  CASE c_custkey % 3 WHEN 0 THEN 'india' WHEN 1 THEN 'global' ELSE 'us' END AS market FROM customer)
SELECT c_custkey, string_agg(gate, ',' ORDER BY gate) AS gates FROM c JOIN p
  ON (list_contains(stages, '*') OR list_contains(stages, stage)) AND (list_contains(markets, '*') OR list_contains(markets, market))
GROUP BY 1""",
)
def gates_for_stage(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey")
    stage = B.choose(k % 4, dict(enumerate(vocab.STAGES)))
    market = B.choose(k % 3, {0: "india", 1: "global", 2: "us"})
    names = F.array(*[F.lit(g[0]) for g in vocab.GATE_POLICY])
    runs = F.array_sort(F.filter(names, lambda g: G.gate_runs_for(g, F.col("stage"), F.col("market"))))
    return c.select(k, stage.alias("stage"), market.alias("market")).select("c_custkey", F.array_join(runs, ",").alias("gates"))


@query(
    "external_gates",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS v FROM documents)
SELECT doc_id, v AS eligibility, v <> 'FAIL' AS policy_pass, v = 'FAIL' AS hard_stop FROM d""",
)
def external_gates(spark, sf):
    d = B.table(spark, sf, "documents")
    v = F.when(F.col("doc_id") % 9 == 0, "FAIL").otherwise("PASS")
    ext = F.array(
        F.struct(F.lit("citizenship").alias("gate"), v.alias("verdict"), F.lit("from a reviewer").alias("note")),
        F.struct(F.lit("notice").alias("gate"), F.lit("FAIL").alias("verdict"), F.lit("90 days").alias("note")),
    )
    d = d.withColumn("gates", F.array().cast("array<struct<gate:string,verdict:string,note:string>>"))
    d = G.with_external_gates(d, ext)
    d = G.apply_gate_policy(d, F.lit("experienced"), F.lit("global"))
    return d.select("doc_id", F.col("policy_gates")[0]["verdict"].alias("eligibility"), "policy_pass", "hard_stop")


@query(
    "staleness_flag",
    f"""WITH {B.TRK_SQL} SELECT application_id, CASE WHEN DATE '1999-06-30' - date > 30
  THEN 'posted ' || (DATE '1999-06-30' - date) || ' days ago' END AS flag FROM trk""",
)
def staleness_flag(spark, sf):
    t = B.tracker(spark, sf)
    return t.select("application_id", G.staleness_flag("date", "1999-06-30").alias("flag"))


# --- scores --------------------------------------------------------------------


def scored_sql(student: bool, with_text: bool = True) -> str:
    skills = STUDENT.skills if student else EXPERIENCED.skills
    w = vocab.FACTOR_WEIGHTS["student" if student else "experienced"]
    lst = "[" + ", ".join(f"'{s}'" for s in skills) + "]"
    hay = "lower(title || chr(10) || description)" if with_text else "lower(title || chr(10))"
    flag = " , ".join(
        f"CASE WHEN starts_with({c}, 'FLAG') THEN '{c[2:]}: ' || substr({c}, 6) END" for c in GATE_COLS
    )
    return f"""{gated_sql(student)}, parts AS (SELECT *,
    list_filter({lst}, lambda s: contains({hay}, s)) AS hit, list_filter({lst}, lambda s: NOT contains({hay}, s)) AS miss,
    least(1.0::DOUBLE, len(list_filter({lst}, lambda s: contains(lower(title), s)))::DOUBLE / {min(len(skills), 3)}) AS title_part,
    CASE WHEN age IS NULL THEN 0.4::DOUBLE WHEN age <= 3 THEN 1.0::DOUBLE WHEN age <= 7 THEN 0.85::DOUBLE WHEN age <= 14 THEN 0.65::DOUBLE
         WHEN age <= 30 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS fresh_part FROM gated),
  scored0 AS (SELECT *, len(hit)::DOUBLE / {len(skills)} AS skill_part, CAST(floor(100.0::DOUBLE * ({w[0]}::DOUBLE * (len(hit)::DOUBLE / {len(skills)})
    + {w[1]}::DOUBLE * title_part + {w[2]}::DOUBLE * fresh_part) + 0.5::DOUBLE) AS INTEGER) AS score FROM parts),
  scored AS (SELECT *, CASE WHEN score >= 70 THEN 'strong fit' WHEN score >= 45 THEN 'good fit' ELSE 'weak fit' END AS verdict,
    array_to_string(list_transform(hit[1:3], lambda s: 'matches skill "' || s || '" per posting text'), '; ') AS strengths,
    array_to_string(list_concat(list_transform(miss[1:3], lambda s: 'no mention of "' || s || '" in posting text'),
       list_filter([{flag}], lambda x: x IS NOT NULL))[1:4], '; ') AS gaps FROM scored0)"""


def flat(df):
    return df.withColumns({c: F.array_join(c, "; ") for c in ("strengths", "gaps")})


@query(
    "score_posting",
    f"{scored_sql(True)} SELECT id, round(skill_part, 6) AS skill_part, round(title_part, 6) AS title_part, fresh_part, score, verdict, strengths, gaps FROM scored",
)
def score_posting(spark, sf):
    d = S.score_posting(docs_gated(spark, sf, STUDENT), STUDENT.as_struct(), B.AS_OF)
    return flat(d).select(
        "id", F.round("skill_part", 6).alias("skill_part"), F.round("title_part", 6).alias("title_part"),
        "fresh_part", "score", "verdict", "strengths", "gaps",
    )


@query(
    "shortlist_top20",
    f"{scored_sql(False)} SELECT id, title, score, verdict, strengths, gaps FROM scored WHERE pass ORDER BY score DESC, pos LIMIT 20",
)
def shortlist_top20(spark, sf):
    top = S.shortlist(B.doc_postings(spark, sf), EXPERIENCED.as_struct(), B.AS_OF, 20)
    return flat(top).select("id", "title", "score", "verdict", "strengths", "gaps")


REASONS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN starts_with({c}, 'FAIL') THEN '{c[2:]}: ' || substr({c}, 6) END" for c in GATE_COLS
) + "], lambda x: x IS NOT NULL)"


@query(
    "rank_shortlist",
    f"{scored_sql(True)} SELECT id, CASE WHEN pass THEN score END AS score, CASE WHEN NOT pass THEN array_to_string({REASONS_SQL}, '; ') END AS reasons FROM scored",
)
def rank_shortlist(spark, sf):
    rows = S.rank_all(B.doc_postings(spark, sf), STUDENT.as_struct(), B.AS_OF, with_text=True)
    return rows.select("id", "score", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "factor_weights",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END AS skill,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END AS title,
  CASE c_custkey % 4 WHEN 0 THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END AS freshness FROM customer""",
)
def factor_weights(spark, sf):
    stage = B.choose(F.col("c_custkey") % 4, dict(enumerate(vocab.STAGES)))
    d = B.table(spark, sf, "customer").select("c_custkey", S.factor_weights(stage).alias("w"))
    return d.select("c_custkey", "w.skill", "w.title", "w.freshness")


@query(
    "skill_overlap",
    f"""WITH {B.DOC_SQL} SELECT id, array_to_string(list_filter(['Tion', 'of the', 'python', 'EEN'], lambda s: contains(lower(title || chr(10) || description), lower(s))), ',') AS hit,
  array_to_string(list_filter(['Tion', 'of the', 'python', 'EEN'], lambda s: NOT contains(lower(title || chr(10) || description), lower(s))), ',') AS miss FROM doc""",
)
def skill_overlap(spark, sf):
    skills = F.array(*[F.lit(s) for s in ("Tion", "of the", "python", "EEN")])
    d = B.doc_postings(spark, sf)
    d = d.select("id", S.skill_overlap(skills, F.concat("title", F.lit("\n"), "description")).alias("o"))
    return d.select("id", F.array_join("o.hit", ",").alias("hit"), F.array_join("o.miss", ",").alias("miss"))


@query(
    "title_match",
    f"""WITH {B.DOC_SQL} SELECT id, round(least(1.0::DOUBLE, (contains(lower(title), 'the')::INT + contains(lower(title), 'une')::INT
  + contains(lower(title), 'der')::INT + contains(lower(title), 'los')::INT)::DOUBLE / 3), 6) AS part, 0.5::DOUBLE AS no_skills FROM doc""",
)
def title_match(spark, sf):
    skills = F.array(*[F.lit(s) for s in ("The", "une", "der", "los")])
    none = F.array().cast("array<string>")
    return B.doc_postings(spark, sf).select(
        "id", F.round(S.title_match(F.col("title"), skills), 6).alias("part"), S.title_match(F.col("title"), none).alias("no_skills")
    )


@query(
    "freshness",
    f"""WITH {B.TRK_SQL}, a AS (SELECT application_id, DATE '1999-06-30' - date AS age FROM trk)
SELECT application_id, CASE WHEN age <= 3 THEN 1.0::DOUBLE WHEN age <= 7 THEN 0.85::DOUBLE WHEN age <= 14 THEN 0.65::DOUBLE
  WHEN age <= 30 THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS part FROM a""",
)
def freshness(spark, sf):
    return B.tracker(spark, sf).select("application_id", S.freshness("date", "1999-06-30").alias("part"))


FOUR_SQL = """part4 AS (SELECT p_partkey, CASE WHEN p_partkey % 23 <> 0 THEN CAST((p_partkey * 7) % 101 AS DOUBLE) END AS t,
  CAST((p_partkey * 11) % 101 AS DOUBLE) AS e, CAST((p_partkey * 13) % 101 AS DOUBLE) AS b, CAST((p_partkey * 17) % 101 AS DOUBLE) AS c,
  CASE p_partkey % 4 WHEN 0 THEN 'student' WHEN 1 THEN 'fresher' WHEN 2 THEN 'experienced' ELSE 'remote-global' END AS stage FROM part)"""


def overall_sql(stage_expr: str) -> str:
    def w(i):
        rows = " ".join(f"WHEN '{s}' THEN {v[i]}::DOUBLE" for s, v in vocab.STAGE_WEIGHTS.items())
        return f"(CASE {stage_expr} {rows} END)"

    return f"CAST(floor(0.0::DOUBLE + t * {w(0)} + e * {w(1)} + b * {w(2)} + c * {w(3)} + 0.500000001::DOUBLE) AS INTEGER)"


BAND_SQL = (
    "CASE WHEN {0} IS NULL THEN NULL WHEN {0} >= 75 THEN 'Strong Fit' WHEN {0} >= 60 THEN 'Good Fit' "
    "WHEN {0} >= 45 THEN 'Moderate Fit' WHEN {0} >= 30 THEN 'Weak Fit' ELSE 'Poor Fit' END"
)


@query(
    "overall_score",
    f"""WITH {FOUR_SQL}, s AS (SELECT p_partkey, stage, {overall_sql('stage')} AS score, t FROM part4)
SELECT p_partkey, stage, score, {BAND_SQL.format('score')} AS band,
  CASE WHEN t IS NULL THEN 'missing or non-numeric score ''technical''' END AS error FROM s""",
)
def overall_score(spark, sf):
    k = F.col("p_partkey")
    p = B.table(spark, sf, "part").select(
        "p_partkey",
        B.choose(k % 4, dict(enumerate(vocab.STAGES))).alias("stage"),
        F.struct(
            F.when(k % 23 != 0, ((k * 7) % 101).cast("double")).alias("technical"),
            ((k * 11) % 101).cast("double").alias("experience"),
            ((k * 13) % 101).cast("double").alias("behavioral"),
            ((k * 17) % 101).cast("double").alias("career"),
        ).alias("scores"),
    )
    p = p.withColumn("score", S.overall_score(F.col("scores"), F.col("stage")))
    return p.select("p_partkey", "stage", "score", S.band(F.col("score")).alias("band"), S.missing_dimension(F.col("scores")).alias("error"))


@query(
    "stage_weights",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END AS w_technical,
  CASE c_custkey % 4 WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 0.2::DOUBLE ELSE 0.25::DOUBLE END AS w_experience,
  0.15::DOUBLE AS w_behavioral, CASE c_custkey % 4 WHEN 0 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS w_career FROM customer""",
)
def stage_weights(spark, sf):
    c = B.table(spark, sf, "customer")
    c = c.select("c_custkey", B.choose(F.col("c_custkey") % 4, dict(enumerate(vocab.STAGES))).alias("stage"))
    return S.with_weights(c).drop("stage")


@query(
    "score_band",
    f"WITH {B.TRK_SQL}, s AS (SELECT application_id, try_cast(fit_rating AS INTEGER) AS score FROM trk) "
    f"SELECT application_id, {BAND_SQL.format('score')} AS band FROM s",
)
def score_band(spark, sf):
    t = B.tracker(spark, sf)
    return t.select("application_id", S.band(F.col("fit_rating").try_cast("int")).alias("band"))
