"""Reports over postings, applications and the seen store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.text import canon_status


def source_notes(postings: DataFrame, sources: DataFrame, errors: DataFrame, cap: int) -> DataFrame:
    """One row per source: ok, rows, truncated, error. Sources that failed or
    returned nothing are rows too. ``sources`` has portal, ``errors`` portal
    and error."""
    counts = postings.groupBy("portal").agg(F.count(F.lit(1)).alias("rows"))
    failed = errors.groupBy("portal").agg(F.min("error").alias("error"))
    out = sources.select("portal").distinct().join(counts, "portal", "left").join(failed, "portal", "left")
    rows = F.coalesce("rows", F.lit(0))
    return out.select(
        "portal",
        F.col("error").isNull().alias("ok"),
        rows.cast("bigint").alias("rows"),
        (F.lit(cap > 0) & (rows >= cap)).alias("truncated"),
        "error",
    )


def health_lines(notes: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("health: "), "portal", F.lit(" — error: "), F.coalesce("error", F.lit("unknown")),
        F.when(F.col("truncated"), F.lit(" (truncated)")).otherwise(F.lit("")),
    )
    return notes.filter(~F.col("ok")).select("portal", line.alias("line"))


def status_lines(notes: DataFrame, skipped: Sequence[str] = (), fallback: Sequence[str] = ()) -> DataFrame:
    """What a run should say of its sources: skipped ones, fallbacks, then one
    health line per failed source. ``position`` orders the lines."""
    said = [(0, "skipped", skipped), (1, "fallback", fallback)]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"{name}: {', '.join(v)}").alias("line")) for i, name, v in said if v])
    lines = health_lines(notes).select(F.lit(2).alias("position"), "line")
    if not (skipped or fallback):
        return lines
    return notes.sparkSession.range(1).select(F.inline(rows)).unionByName(lines)


def rejections_by_gate(gated: DataFrame) -> DataFrame:
    """Postings failed per gate (a posting counts for every gate it fails)."""
    fails = gated.select(F.explode(F.filter("gates", lambda g: g["verdict"] == "FAIL")).alias("g"))
    return fails.groupBy(F.col("g.gate").alias("gate")).agg(F.count(F.lit(1)).alias("rejected"))


# --- salary -----------------------------------------------------------------------


def vs_baseline(index: Column, baseline: Column) -> Column:
    """Percent above the baseline; NULL for textual or absent indexes and a
    zero baseline."""
    i = index.try_cast("double")
    return F.try_divide(i - baseline, F.when(baseline != 0, baseline)) * 100


def salary_vs_baseline(df: DataFrame) -> DataFrame:
    """Adds ``vs_baseline`` and the shown forms of index and difference."""
    number = F.col("index").try_cast("double")
    pct = vs_baseline(F.col("index"), F.col("baseline"))
    shown = (
        F.when(F.col("index").isNull(), "N/A")
        .when(number.isNotNull(), F.round(number, 1).cast("decimal(38,1)").cast("string"))
        .otherwise(F.col("index"))
    )
    signed = F.concat(
        F.when(pct >= 0, "+").otherwise(""), F.round(pct, 1).cast("decimal(38,1)").cast("string"), F.lit("%")
    )
    return df.withColumns({"vs_baseline": pct, "index_shown": shown, "difference": signed})


def duplicate_companies(df: DataFrame) -> DataFrame:
    """(company, first_pos, pos) of every repeat of a name, ignoring case."""
    first = df.groupBy(F.lower("company").alias("_key")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("_n"))
    repeats = df.select("company", "pos", F.lower("company").alias("_key")).join(first.filter(F.col("_n") > 1), "_key")
    return repeats.filter(F.col("pos") > F.col("first_pos")).select("company", "first_pos", "pos")


# --- applications -----------------------------------------------------------------


def stage_rank(stage: Column) -> Column:
    """How far a stage proves an application got: a closed one was at least
    submitted, a declined offer was an offer. Unknown stages prove nothing."""
    s = canon_status(stage)
    out = F.lit(None).cast("int")
    for name, rank in vocab.STAGE_RANK.items():
        out = F.when(s == name, rank).otherwise(out)
    out = F.when(s == "offer_declined", vocab.STAGE_RANK["offer"]).otherwise(out)
    return F.when(s.isin("rejected", "no_response", "withdrawn"), vocab.STAGE_RANK["applied"]).otherwise(out)


def stage_reached(events: DataFrame, *extra: str) -> DataFrame:
    """Furthest stage of each application over its whole history; drafts that
    were never sent are left out."""
    reached = events.groupBy("application_id", *extra).agg(F.max(stage_rank(F.col("stage"))).alias("reached"))
    return reached.filter(F.col("reached") >= vocab.STAGE_RANK["applied"])


def funnel(events: DataFrame) -> DataFrame:
    """Applications that reached each stage, from history and not from the
    current status: one that interviewed and was rejected still interviewed."""
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("stage"),
                F.count_if(F.col("reached") >= vocab.STAGE_RANK[name]).alias("applications"),
            )
            for name in vocab.FUNNEL_STAGES
        ]
    )
    return stage_reached(events).agg(counts.alias("f")).select(F.inline("f"))


def rejection_rate(tracker: DataFrame) -> DataFrame:
    """Rejected (or unanswered) over closed applications. Declined offers and
    withdrawals are closed but no rejections; drafts and applications still
    running are in neither number."""
    s = canon_status("status")
    rejected = F.count_if(s.isin("rejected", "no_response"))
    closed = F.count_if(s.isin(*vocab.FINAL_STATUSES))
    return tracker.agg(
        rejected.alias("rejected"), closed.alias("closed"),
        F.try_divide(rejected.cast("double"), closed.cast("double")).alias("rate"),
    )


def portal_yield(events: DataFrame) -> DataFrame:
    """Applications, interviews and interview rate per portal, from history."""
    interviews = F.count_if(F.col("reached") >= vocab.STAGE_RANK["interview"])
    total = F.count(F.lit(1))
    return (
        stage_reached(events, "source")
        .groupBy("source")
        .agg(
            total.alias("applications"), interviews.alias("interviews"),
            F.try_divide(interviews.cast("double"), total.cast("double")).alias("interview_rate"),
        )
    )


# fixed values: bucket of each tracker status
STATUS_BUCKETS = {
    "drafted": "Drafted",
    "applied": "Applied",
    "interview": "Interview",
    "offer": "Offer",
    "hired": "Hired",
    "rejected": "Rejected/Closed",
    "no_response": "Rejected/Closed",
    "offer_declined": "Rejected/Closed",
    "withdrawn": "Rejected/Closed",
}


def status_bucket(status: Column) -> Column:
    """Bucket of a status in either spelling; anything else is closed."""
    s = canon_status(status)
    out = F.lit("Rejected/Closed")
    for name, bucket in STATUS_BUCKETS.items():
        out = F.when(s == name, bucket).otherwise(out)
    return out


def status_buckets(tracker: DataFrame) -> DataFrame:
    """Rows per bucket, and how many had an unrecognised status."""
    known = canon_status("status").isin(*STATUS_BUCKETS)
    return tracker.groupBy(status_bucket(F.col("status")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("applications"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("unrecognised"),
    )


def unrecognised_statuses(tracker: DataFrame) -> DataFrame:
    """Each unrecognised status once, with its rows."""
    s = canon_status("status")
    return tracker.filter(~F.coalesce(s.isin(*STATUS_BUCKETS), F.lit(False))).groupBy("status").agg(
        F.count(F.lit(1)).alias("applications")
    )


def gap_weights(merged: DataFrame) -> DataFrame:
    """Adds ``weight``: distance to a full fit. A blank or textual fit_rating
    falls back to the matched rank score; rows with neither get NULL, never a
    zero rating. Untracked rows need a moderate rank score."""
    fit, rank = F.col("fit_rating").try_cast("double"), F.col("rank_score").cast("double")
    used = F.when(F.col("tracked"), F.coalesce(fit, rank)).when(rank >= vocab.MODERATE_FLOOR, rank)
    return merged.withColumn("weight", (F.lit(100.0) - used) / F.lit(100.0))


def gap_heatmap(merged: DataFrame) -> DataFrame:
    """Weight of each gap over tracked and ranked postings, with provenance."""
    rows = gap_weights(merged).filter(F.col("weight").isNotNull())
    return (
        rows.select("weight", "provenance", F.explode("gaps").alias("gap"))
        .groupBy(F.lower("gap").alias("gap"))
        .agg(
            F.sum("weight").alias("weight"),
            F.count(F.lit(1)).alias("postings"),
            F.count_if(F.col("provenance") == "recorded").alias("recorded"),
            F.count_if(F.col("provenance") == "inferred").alias("inferred"),
        )
    )


def gap_coverage(merged: DataFrame) -> DataFrame:
    """How many rows the heatmap used, by source, and how many it skipped."""
    rows = gap_weights(merged)
    used = F.col("weight").isNotNull()
    return rows.agg(
        F.count_if(used & F.col("tracked")).alias("tracked"),
        F.count_if(used & ~F.col("tracked")).alias("ranked"),
        F.count_if(~used & F.col("tracked")).alias("skipped"),
    )


def batch_outcome(rows: DataFrame, ok: str = "ok") -> DataFrame:
    return rows.agg(
        F.count_if(F.col(ok)).alias("built"), F.count_if(~F.col(ok)).alias("failed"), F.count(F.lit(1)).alias("total")
    )
