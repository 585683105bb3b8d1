"""Scores, bands, shortlists and score history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.dates import age_days, as_of_col, strict_iso
from rolebook.functions.money import half_up
from rolebook.functions.text import canon_location, col_of, let, score_tokens
from rolebook.operators import gates as G


def canon_place(text: str) -> str:
    """A configured place, spelled as :func:`canon_location` spells columns."""
    out = text.lower()
    for alias, canon in vocab.LOCATION_ALIASES:
        out = out.replace(alias, canon, 1)
    return out


@dataclass(frozen=True)
class Candidate:
    """One candidate. ``locations`` empty means anywhere."""

    candidate_id: str = "me"
    stage: str = "experienced"
    skills: Sequence[str] = field(default_factory=tuple)
    locations: Sequence[str] = field(default_factory=tuple)
    grad_year: int | None = None
    stipend_floor: float | None = None
    ctc_floor: float | None = None
    market: str = "india"

    def __post_init__(self):
        if self.stage not in vocab.STAGES or self.market not in vocab.MARKETS:
            raise ValueError(f"unknown stage or market: {self.stage}, {self.market}")

    def as_struct(self) -> Column:
        def words(values):
            return F.array(*[F.lit(v) for v in values]).cast("array<string>")

        accept = [canon_place(v) for v in self.locations]
        return F.struct(
            words(accept).alias("accept"),
            F.lit(self.candidate_id).alias("candidate_id"),
            F.lit(self.stage).alias("stage"),
            words(self.skills).alias("skills"),
            words(self.locations).alias("locations"),
            F.lit(self.grad_year).cast("int").alias("grad_year"),
            F.lit(self.stipend_floor).cast("double").alias("stipend_floor"),
            F.lit(self.ctc_floor).cast("double").alias("ctc_floor"),
            F.lit(self.market).alias("market"),
        )


def factor_weights(stage: Column) -> Column:
    """Struct(skill, title, freshness) weights of a career stage."""
    def one(i):
        out = F.lit(vocab.FACTOR_WEIGHTS["experienced"][i])
        for name, row in vocab.FACTOR_WEIGHTS.items():
            out = F.when(stage == name, F.lit(row[i])).otherwise(out)
        return out

    return F.struct(one(0).alias("skill"), one(1).alias("title"), one(2).alias("freshness"))


def skill_overlap(skills: Column, text: Column) -> Column:
    """Struct(hit, miss): skills quoted in the text, in profile order."""
    return let(
        F.lower(text),
        lambda hay: F.struct(
            F.filter(skills, lambda s: F.contains(hay, F.lower(s))).alias("hit"),
            F.filter(skills, lambda s: ~F.contains(hay, F.lower(s))).alias("miss"),
        ),
    )


def title_match(title: Column, skills: Column) -> Column:
    """min(1, skills echoed by the title / min(skills, 3)); 0.5 without skills."""
    low, words = F.lower(title), score_tokens(title)
    hits = F.size(F.filter(skills, lambda s: F.contains(low, F.lower(s)) | F.array_contains(words, F.lower(s))))
    wanted = F.least(F.size(skills), F.lit(3))
    return F.when(F.size(skills) == 0, F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), F.try_divide(hits.cast("double"), wanted.cast("double")))
    )


def freshness(posted, as_of) -> Column:
    age = age_days(posted, as_of)
    out = F.lit(vocab.FRESHNESS_OLD)
    for days, value in reversed(vocab.FRESHNESS_STEPS):
        out = F.when(age <= days, F.lit(value)).otherwise(out)
    return F.when(age.isNull(), F.lit(vocab.FRESHNESS_UNDATED)).otherwise(out)


def fit_verdict(score: Column) -> Column:
    out = F.lit(vocab.FIT_VERDICT_ELSE)
    for floor, name in reversed(vocab.FIT_VERDICTS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def score_posting(df: DataFrame, cand: Column, as_of, with_text: bool = True, body: Column | None = None) -> DataFrame:
    """Adds ``score``, ``verdict``, ``strengths`` and ``gaps`` to gated rows.
    ``body`` replaces the description as the text that skills are sought in."""
    if body is None:
        body = F.col("description") if with_text else F.lit("")
    text = F.concat(F.col("title"), F.lit("\n"), F.coalesce(body, F.lit("")))
    n = F.size(cand["skills"])
    weights = factor_weights(cand["stage"])
    flags = F.transform(
        F.filter("gates", lambda g: (g["verdict"] == "FLAG") & (g["note"] != "")),
        lambda g: F.concat(g["gate"], F.lit(": "), g["note"]),
    )
    return (
        df.withColumn("_overlap", skill_overlap(cand["skills"], text))
        .withColumn(
            "skill_part",
            F.when(n == 0, F.lit(0.5)).otherwise(
                F.try_divide(F.size("_overlap.hit").cast("double"), n.cast("double"))
            ),
        )
        .withColumn("title_part", title_match(F.col("title"), cand["skills"]))
        .withColumn("fresh_part", freshness("posted_date", as_of))
        .withColumn(
            "score",
            half_up(
                F.lit(100.0)
                * (
                    weights["skill"] * F.col("skill_part")
                    + weights["title"] * F.col("title_part")
                    + weights["freshness"] * F.col("fresh_part")
                )
            ),
        )
        .withColumn("verdict", fit_verdict(F.col("score")))
        .withColumn(
            "strengths",
            F.transform(
                F.slice("_overlap.hit", 1, 3),
                lambda s: F.concat(F.lit('matches skill "'), s, F.lit('" per posting text')),
            ),
        )
        .withColumn(
            "gaps",
            F.slice(
                F.concat(
                    F.transform(
                        F.slice("_overlap.miss", 1, 3),
                        lambda s: F.concat(F.lit('no mention of "'), s, F.lit('" in posting text')),
                    ),
                    flags,
                ),
                1, 4,
            ),
        )
        .drop("_overlap")
    )


def fail_reasons() -> Column:
    return F.transform(
        F.filter("gates", lambda g: g["verdict"] == "FAIL"),
        lambda g: F.concat(g["gate"], F.lit(": "), g["note"]),
    )


def gated(
    postings: DataFrame,
    cand: Column,
    as_of,
    with_text: bool,
    max_age_days=vocab.RANK_MAX_AGE_DAYS,
) -> DataFrame:
    """Postings with ``gates`` and ``pass``; reads texts only when asked to."""
    if "facts" not in postings.columns:
        postings = G.with_text_facts(postings) if with_text else G.without_text(postings)
    return G.run_gates(postings, cand, as_of, max_age_days)


def rank_all(
    postings: DataFrame,
    cand: Column,
    as_of,
    with_text: bool = False,
    max_age_days=vocab.RANK_MAX_AGE_DAYS,
) -> DataFrame:
    """Every posting once: gates, ``pass``, and score for survivors or
    ``reasons`` for the rest. One narrow pass, no shuffle."""
    rows = gated(postings, cand, as_of, with_text, max_age_days)
    # Rejected rows get no score, so their texts are not searched for skills.
    body = F.when(F.col("pass"), F.col("description")) if with_text else None
    rows = score_posting(rows, cand, as_of, with_text, body)
    scored = ("score", "verdict", "strengths", "gaps")
    rows = rows.withColumns({c: F.when(F.col("pass"), F.col(c)) for c in scored})
    return rows.withColumn("reasons", F.when(~F.col("pass"), fail_reasons()))


def rank_shortlist(
    postings: DataFrame,
    cand: Column,
    as_of,
    with_text: bool = False,
    max_age_days=vocab.RANK_MAX_AGE_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """(ranked, rejected). Nothing is dropped: every input row is in one of
    them, rejected rows with ``reasons``. Ranked rows are unsorted; order them
    by :func:`shortlist_order`, with a limit where only the top is wanted.

    Both halves read the postings; where both are needed together use
    :func:`rank_all`.
    """
    rows = rank_all(postings, cand, as_of, with_text, max_age_days)
    return rows.filter("pass").drop("reasons"), rows.filter(~F.col("pass"))


def shortlist(
    postings: DataFrame,
    cand: Column,
    as_of,
    top: int,
    with_text: bool = True,
    max_age_days=vocab.RANK_MAX_AGE_DAYS,
) -> DataFrame:
    """The best ``top`` postings for a candidate.

    Postings the date or the place already rules out are filtered before any
    text is read: the filters reach the scan, and the text patterns run on
    the survivors only.
    """
    late = G.gate_stale("posted_date", max_age_days, as_of).fails
    away = G.gate_location("location", canon_location("location"), cand).fails
    rows = gated(postings.filter(~late & ~away), cand, as_of, with_text, max_age_days)
    scored = score_posting(rows.filter("pass"), cand, as_of, with_text)
    return scored.orderBy(*shortlist_order()).limit(top)


def shortlist_order() -> list[Column]:
    return [F.col("score").desc(), F.col("pos")]


def with_weights(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Adds the four canonical dimension weights of the row's stage."""
    out = df
    for i, dim in enumerate(vocab.DIMENSIONS):
        w = F.lit(None).cast("double")
        for name, row in vocab.STAGE_WEIGHTS.items():
            w = F.when(F.col(stage) == name, F.lit(row[i])).otherwise(w)
        out = out.withColumn(f"w_{dim}", w)
    return out


def band(score: Column) -> Column:
    out = F.lit(vocab.BANDS[-1][0])
    for name, floor in reversed(vocab.BANDS):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def missing_dimension(scores: Column) -> Column:
    """Error text for the first dimension without a number, else NULL."""
    out = F.lit(None).cast("string")
    for dim in reversed(vocab.DIMENSIONS):
        out = F.when(scores[dim].isNull(), F.lit(f"missing or non-numeric score '{dim}'")).otherwise(out)
    return out


def overall_score(scores: Column, stage="experienced") -> Column:
    """Weighted four-dimension score; NULL when a dimension is missing."""
    if isinstance(stage, str):
        weights = [F.lit(w) for w in vocab.STAGE_WEIGHTS[stage]]
    else:
        weights = []
        for i in range(len(vocab.DIMENSIONS)):
            w = F.lit(vocab.STAGE_WEIGHTS["experienced"][i])
            for name, row in vocab.STAGE_WEIGHTS.items():
                w = F.when(stage == name, F.lit(row[i])).otherwise(w)
            weights.append(w)
    total = F.lit(0.0)
    for dim, w in zip(vocab.DIMENSIONS, weights):
        total = total + scores[dim].cast("double") * w
    return half_up(total, 1e-9)


def is_urgent(deadline, as_of, days: int = vocab.URGENT_DAYS) -> Column:
    left = F.datediff(strict_iso(deadline), as_of_col(as_of))
    return F.coalesce(left.between(0, days), F.lit(False))


def vetoed() -> Column:
    return F.coalesce(F.col("location_verdict") == "FAIL", F.lit(False)) | F.coalesce(
        F.col("language_gate") == "FAIL", F.lit(False)
    )


def rank_report(scored: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(ranked, vetoed) of seen rows, both with ``urgent``; best first is
    ``rank_score`` desc, ``urgent`` desc, key."""
    rows = scored.withColumn("urgent", is_urgent("deadline", as_of))
    return rows.filter(~vetoed()), rows.filter(vetoed())


def push_history(history, score: Column, verdict: Column, date: Column, keep: int = vocab.HISTORY_KEEP) -> Column:
    """History with the previous score appended, last ``keep`` entries; rows
    never scored before keep their history."""
    entry = F.struct(score.alias("score"), verdict.alias("verdict"), date.alias("date"))
    past = F.coalesce(col_of(history), F.array().cast("array<struct<score:int,verdict:string,date:string>>"))
    grown = F.array_append(past, entry)
    start = F.greatest(F.size(grown) - keep + 1, F.lit(1))
    return F.when(score.isNull(), col_of(history)).otherwise(F.slice(grown, start, F.lit(keep)))


def movement(old_score: Column, new_score: Column) -> Column:
    """``band`` when the band changed, ``noise`` within five points, else
    ``drift``; NULL for a first score."""
    changed = band(old_score) != band(new_score)
    return (
        F.when(old_score.isNull(), F.lit(None).cast("string"))
        .when(changed, "band")
        .when(F.abs(new_score - old_score) <= vocab.NOISE_POINTS, "noise")
        .otherwise("drift")
    )
