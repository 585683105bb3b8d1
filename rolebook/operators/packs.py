"""Keyword gaps and application packs. Every line traces to the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.text import let, pack_tokens

PROFILE_SCHEMA = (
    "name string, email string, phone string, location string, summary string, skills array<string>, "
    "experience array<struct<role:string,company:string,period:string,bullets:array<struct<text:string,source:string>>>>, "
    "education array<struct<degree:string,school:string,year:string>>, links array<string>"
)


def profile_issues(df: DataFrame) -> DataFrame:
    """Adds ``issue``: why a profile (PROFILE_SCHEMA columns) cannot be used."""
    def bad_job(e):
        missing = e["role"].isNull() | e["company"].isNull() | e["period"].isNull() | e["bullets"].isNull()
        return missing | F.exists(e["bullets"], lambda b: b["text"].isNull())

    def blank(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    issue = (
        F.when(blank("name"), "name is missing")
        .when(blank("email"), "email is missing")
        .when(F.col("skills").isNull() | F.exists("skills", lambda s: s.isNull()), "skills must be text")
        .when(F.col("experience").isNull() | F.exists("experience", bad_job), "experience is incomplete")
        .when(
            F.col("education").isNull() | F.exists("education", lambda e: e["degree"].isNull() | e["school"].isNull()),
            "education is incomplete",
        )
    )
    return df.withColumn("issue", issue)


#: Set behind title words while they are sorted; sorts before every character of a word.
MARK = "\x01"


def _runs(marked: Column) -> Column:
    """(word, weight) of each different word of sorted words, title words marked: one
    entry a word, as a marked run follows the unmarked one of its word."""
    starts = F.filter(F.sequence(F.lit(0), F.size(marked) - 1), lambda i: (i == 0) | (F.get(marked, i) != F.get(marked, i - 1)))

    def counted(at):
        def one(i, j):
            n = F.coalesce(F.get(at, j + 1), F.size(marked)) - i
            raw = F.get(marked, i)
            return F.struct(F.substring_index(raw, MARK, 1).alias("word"), F.when(F.endswith(raw, F.lit(MARK)), n * 4).otherwise(n).alias("weight"))

        return let(F.transform(at, one), merged)

    def merged(runs):
        def one(x, j):
            after = F.get(runs, j + 1)
            both = F.when(after["word"] == x["word"], x["weight"] + after["weight"]).otherwise(x["weight"])
            again = (j > 0) & (F.get(runs, j - 1)["word"] == x["word"])
            return F.when(~again, F.struct(x["word"].alias("word"), both.alias("weight")))

        return F.array_compact(F.transform(runs, one))

    return let(starts, counted)


def top_words(title: Column, description: Column, top: int = vocab.GAP_TOP) -> Column:
    """The heaviest words of a posting, heaviest first; ties keep the order of
    first appearance.

    A title word weighs 4 per occurrence, a description word 1. The words are
    counted inside the row: sorted as plain strings, equal words form runs, and a run's
    length is the word's weight. Only words as heavy as the last of the top are
    put in order of appearance. Nothing is shuffled.
    """
    return let(
        F.struct(pack_tokens(title).alias("t"), pack_tokens(F.coalesce(description, F.lit(""))).alias("d")),
        lambda w: let(F.concat(w["t"], w["d"]), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(_heaviest(w, ws, top))),
    )


def _heaviest(w: Column, words: Column, top: int) -> Column:
    def ranked(weighed):
        weights = F.sort_array(F.transform(weighed, lambda x: x["weight"]), asc=False)
        return let(F.get(weights, F.least(F.size(weights), F.lit(top)) - 1), lambda least: picked(weighed, least))

    def picked(weighed, least):
        above = F.transform(
            F.filter(weighed, lambda x: x["weight"] > least),
            lambda x: F.struct((-x["weight"]).alias("lightness"), F.array_position(words, x["word"]).alias("first"), x["word"].alias("word")),
        )
        level = F.transform(F.filter(weighed, lambda x: x["weight"] == least), lambda x: x["word"])
        first = F.transform(F.sort_array(above), lambda x: x["word"])
        # the intersection keeps the order of its first array
        return F.slice(F.concat(first, F.array_intersect(words, level)), 1, top)

    marked = F.concat(w["d"], F.transform(w["t"], lambda x: F.concat(x, F.lit(MARK))))
    return let(F.sort_array(marked), lambda s: let(_runs(s), ranked))


def with_keyword_gaps(df: DataFrame, skills: Column) -> DataFrame:
    """Adds ``covered`` and ``missing``: the twelve heaviest posting words,
    split by whether a skill contains or is contained in them; function words
    are never missing, and at most five are named."""
    prof = F.transform(skills, lambda s: F.lower(s))

    def known(w):
        return F.exists(prof, lambda s: F.contains(s, w) | F.contains(w, s))

    d = df.select("*", F.explode(F.array(top_words(F.col("title"), F.col("description")))).alias("_top"))
    missing = F.filter("_top", lambda w: ~known(w) & ~w.isin(*vocab.GAP_NOISE))
    return d.withColumns(
        {"covered": F.filter("_top", known), "missing": F.slice(missing, 1, vocab.GAP_MAX)}
    ).drop("_top")


def keyword_gaps(df: DataFrame, skills: Column, key: str = "id") -> DataFrame:
    """(key, covered, missing) of each posting."""
    return with_keyword_gaps(df, skills).select(key, "covered", "missing")


def pick_bullets(bullets: Column, job_no: Column, keywords: Column, take: int = 4) -> Column:
    """The bullets with most keyword hits, ties in profile order, each with
    the path it came from."""
    scored = F.transform(
        bullets,
        lambda b, i: F.struct(
            (-F.size(F.filter(keywords, lambda k: F.contains(F.lower(b["text"]), k)))).alias("rank"),
            i.alias("at"),
            b["text"].alias("claim"),
            F.concat(F.lit("experience["), job_no, F.lit("].bullets["), i, F.lit("]")).alias("source"),
        ),
    )
    return F.transform(F.slice(F.array_sort(scored), 1, take), lambda b: F.struct(b["claim"].alias("claim"), b["source"].alias("source")))


def build_packs(scored: DataFrame, profile: Column) -> DataFrame:
    """Adds ``pack`` to scored postings that have covered and missing words.

    Selection and ordering only, inside the row: no shuffle.
    """
    p, covered, missing = profile, F.col("covered"), F.col("missing")
    is_hit = lambda s: F.array_contains(covered, F.lower(s))
    skills = F.concat(F.filter(p["skills"], is_hit), F.filter(p["skills"], lambda s: ~is_hit(s)))
    jobs = F.transform(
        p["experience"],
        lambda e, i: F.struct(e["role"].alias("role"), e["company"].alias("company"), e["period"].alias("period"),
                              pick_bullets(e["bullets"], i, covered).alias("picked")),
    )
    nl = F.lit("\n")
    sections = F.array_join(
        F.transform(
            jobs,
            lambda j: F.concat(
                F.lit("### "), j["role"], F.lit(" — "), j["company"], F.lit(" ("), j["period"], F.lit(")"), nl,
                F.array_join(F.transform(j["picked"], lambda b: F.concat(F.lit("- "), b["claim"])), "\n"),
            ),
        ),
        "\n\n",
    )
    schooling = F.transform(
        p["education"],
        lambda e: F.concat(
            F.lit("- "), e["degree"], F.lit(", "), e["school"],
            F.when(F.coalesce(e["year"], F.lit("")) != "", F.concat(F.lit(" ("), e["year"], F.lit(")"))).otherwise(""),
        ),
    )
    links = F.coalesce(p["links"], F.array().cast("array<string>"))
    link_lines = F.when(
        F.size(links) > 0, F.concat(F.array(F.lit(""), F.lit("## Links")), F.transform(links, lambda s: F.concat(F.lit("- "), s)))
    ).otherwise(F.array().cast("array<string>"))
    contact = F.array_join(F.filter(F.array(p["email"], p["phone"], p["location"]), lambda c: F.coalesce(c, F.lit("")) != ""), " · ")
    summary = F.coalesce(p["summary"], F.lit(""))
    lines = F.concat(
        F.array(
            F.concat(F.lit("# "), p["name"]), contact, F.lit(""),
            F.when(summary != "", F.concat(summary, nl)).otherwise(F.lit("")),
            F.lit("## Skills"), F.array_join(skills, ", "), F.lit(""), F.lit("## Experience"), sections, F.lit(""), F.lit("## Education"),
        ),
        schooling, link_lines,
    )
    role = F.concat(F.col("title"), F.lit(" at "), F.col("company"))
    matches = F.concat(F.lit(vocab.PITCH_MATCHES), F.array_join(F.slice(covered, 1, 3), ", "), F.lit("."))
    pitch = F.concat(
        F.lit(vocab.PITCH_START), role, F.lit(": "),
        F.when(F.size(covered) > 0, matches).otherwise(F.lit(vocab.PITCH_GROWTH)),
        F.lit(" "), summary,
    )
    area = F.when(F.size(covered) > 0, F.array_join(F.slice(covered, 1, 2), " and ")).otherwise(vocab.FOLLOW_UP_AREA)
    follow_up = F.concat(
        F.lit(vocab.FOLLOW_UP_START), role, F.lit(vocab.FOLLOW_UP_MIDDLE),
        area, F.lit(vocab.FOLLOW_UP_END),
    )
    pack = F.struct(
        F.array_join(lines, "\n").alias("resume"),
        F.substring(pitch, 1, vocab.PITCH_CHARS).alias("pitch"),
        follow_up.alias("follow_up"),
        F.flatten(F.transform(jobs, lambda j: j["picked"])).alias("traces"),
        missing.alias("gaps"),
    )
    return scored.withColumn("pack", pack)
