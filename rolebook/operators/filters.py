"""Row filters. A filter that narrows on a fact keeps rows not stating it,
except where the operator's docstring says the row must state it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.dates import age_days
from rolebook.functions.money import parse_salary
from rolebook.functions.text import col_of, contains_ci, let, squeeze

#: Columns a board's own phrase search looks at, joined by a space.
PHRASE_COLUMNS = {
    "greenhouse": ("title", "location"),
    "lever": ("title", "location"),
    "smartrecruiters": ("title", "city"),
    "weworkremotely": ("title", "company"),
    "arbeitnow": ("title", "company"),
}


def wants_internships(stage: str | None, kind: str | None) -> bool:
    if kind in ("internships", "jobs"):
        return kind == "internships"
    return stage == "student"


def stage_filter(
    df: DataFrame,
    as_of,
    location: str | None = None,
    stage: str | None = None,
    kind: str | None = None,
    max_age: int | None = None,
) -> DataFrame:
    """Career-stage filters. A NULL location never matches a place; undated
    postings survive the age cut."""
    out = df
    if location:
        out = out.filter(contains_ci(F.col("location"), location))
    elif stage == "remote-global":
        out = out.filter(contains_ci(F.col("location"), "remote"))
    if wants_internships(stage, kind):
        title = F.lower(F.col("title"))
        out = out.filter(title.rlike("|".join(vocab.INTERN_WORDS)))
    if max_age and max_age > 0:
        out = out.filter(F.coalesce(age_days("posted_date", as_of) <= max_age, F.lit(True)))
    return out


def match_phrase(df: DataFrame, phrase: str, columns: Sequence[str]) -> DataFrame:
    """Whole phrase inside the joined columns; a blank phrase keeps all."""
    if not phrase:
        return df
    hay = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.filter(contains_ci(hay, phrase))


def match_any_column(df: DataFrame, phrase: str, columns: Sequence[str], tags: str | None = None) -> DataFrame:
    """Whole phrase inside any one of the columns, or inside any tag."""
    hits = [F.coalesce(contains_ci(F.col(c), phrase), F.lit(False)) for c in columns]
    if tags:
        hits.append(F.coalesce(F.exists(F.col(tags), lambda t: contains_ci(t, phrase)), F.lit(False)))
    keep = hits[0]
    for hit in hits[1:]:
        keep = keep | hit
    return df.filter(keep)


def match_all_words(df: DataFrame, query: str, columns: Sequence[str], tags: str | None = None) -> DataFrame:
    """Every word of the query somewhere in the row; a blank query keeps all."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    if tags:
        parts.append(F.array_join(F.col(tags), " "))
    words = query.lower().split()
    if not words:
        return df
    wanted = F.array(*[F.lit(w) for w in words])
    hay = F.lower(F.concat_ws(" ", *parts))
    return df.filter(let(hay, lambda h: F.forall(wanted, lambda w: F.contains(h, w))))


def match_tag(df: DataFrame, tag: str, column: str = "tags") -> DataFrame:
    return df.filter(F.exists(F.col(column), lambda t: contains_ci(t, tag.strip())))


def match_category(df: DataFrame, category: str, column: str = "category") -> DataFrame:
    """Category ignoring hyphens and spaces; the row must state one."""
    def flat(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), r"[-\s]", "")

    return df.filter(F.contains(flat(F.col(column)), flat(F.lit(category))))


def match_location(df: DataFrame, wanted: str, policy: str = "remoteok") -> DataFrame:
    """``remoteok``: remote/any/all keep everything, worldwide and unstated
    rows are kept. ``remotive``: the row must state the place."""
    place = F.lower(F.coalesce(F.col("location"), F.lit("")))
    if policy == "remotive":
        return df.filter(F.contains(place, F.lit(wanted.lower())))
    want = wanted.strip().lower()
    if want in ("remote", "any", "all"):
        return df
    return df.filter(F.contains(place, F.lit("worldwide")) | (place == "") | F.contains(place, F.lit(want)))


def min_salary(df: DataFrame, minimum: float, column: str = "salary") -> DataFrame:
    return df.filter(F.coalesce(parse_salary(column) >= minimum, F.lit(True)))


def max_age(df: DataFrame, days: int, as_of, column: str = "posted_date") -> DataFrame:
    if not days or days <= 0:
        return df
    return df.filter(F.coalesce(age_days(column, as_of) <= days, F.lit(True)))


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule a row breaks (rules state what must hold)."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def split_valid(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined-with-``reject_reason``); together they are the input."""
    tagged = df.withColumn("reject_reason", reject_reason(rules))
    return (
        tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        tagged.filter(F.col("reject_reason").isNotNull()),
    )


def focus_filter(df: DataFrame, focus: str | None) -> DataFrame:
    """Substring over title, company, strengths and gaps."""
    if not focus:
        return df
    hay = F.concat_ws(" ", "title", "company", "strengths", "gaps")
    return df.filter(contains_ci(hay, focus))


#: Facet -> (column, whether the column holds an array).
FACETS = {
    "regions": ("regions", True),
    "countries": ("countries", True),
    "cities": ("cities", True),
    "skills": ("skills", True),
    "seniority": ("seniority", False),
    "category": ("category", False),
    "work_mode": ("work_mode", False),
    "company_slug": ("company_slug", False),
}


def facet_filter(
    df: DataFrame,
    as_of=None,
    experience_min: float | None = None,
    salary_min: float | None = None,
    posted_within: int | None = None,
    **facets,
) -> DataFrame:
    """OR within a facet, AND across facets."""
    out = df
    for name, values in facets.items():
        column, is_array = FACETS[name]
        values = [values] if isinstance(values, str) else list(values)
        wanted = F.array(*[F.lit(v) for v in values])
        out = out.filter(F.arrays_overlap(F.col(column), wanted) if is_array else F.col(column).isin(values))
    if experience_min is not None:
        out = out.filter(F.col("experience_min") >= experience_min)
    if salary_min is not None:
        out = out.filter(F.col("salary_min") >= salary_min)
    if posted_within:
        out = out.filter(age_days("posted_date", as_of) <= posted_within)
    return out


def hygiene_issues(text) -> Column:
    """Names of the parseability rules an extracted document text breaks.

    Patterns that need a rare character are tried only on texts holding it.
    """
    t = col_of(text)
    has = lambda part: F.contains(t, F.lit(part))
    low = F.lower(t)
    sections = sum((F.contains(low, F.lit(w)).cast("int") for w in vocab.ATS_SECTION_WORDS), F.lit(0))
    checks = (
        ("replacement-chars", has("\ufffd")),
        ("cid-markers", has("(cid:") & t.rlike(r"\(cid:\d+\)")),
        ("leaked-item-bracket", has("\\item") & t.rlike(r"\\item\s*\[")),
        ("leaked-macro", has("\\") & t.rlike(vocab.LEAKED_MACROS + r"(?!\w)")),
        ("no-email", ~(has("@") & t.rlike("(?U)" + vocab.EMAIL))),
        ("no-phone", ~(t.rlike("[0-9X]{2}") & t.rlike(vocab.PHONE))),
        ("few-sections", sections < 2),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def text_hygiene(df: DataFrame, column: str = "text", min_chars: int = 1, required: Sequence[str] = ()) -> DataFrame:
    """Adds ``issues`` (array) and ``ok``: hygiene rules, minimum length and
    required phrases after whitespace squeezing."""
    body = F.coalesce(F.col(column), F.lit(""))
    flat = squeeze(body)
    # A squeezed text is at least as long as its squeezed start, so most texts are
    # known to be long enough from their first characters.
    starts_long = F.length(squeeze(F.substring(body, 1, 4 * min_chars))) >= min_chars
    extra = [F.when(starts_long, F.lit(None).cast("string")).when(F.length(flat) < min_chars, F.lit("too-short"))]
    for phrase in required:
        want = " ".join(phrase.split())
        extra.append(F.when(~F.contains(flat, F.lit(want)), F.lit(f"missing: {want}")))
    issues = F.concat(F.array_compact(F.array(*extra)), hygiene_issues(body))
    return df.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)
