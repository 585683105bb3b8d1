"""The seen store and the application tracker over time.

Updates are projections over one equi join on the key; nothing here groups a
whole store or reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.dates import as_of_col, strict_iso
from rolebook.functions.text import canon_status, is_open
from rolebook.operators import joins
from rolebook.operators import scoring as S
from rolebook.operators.filters import focus_filter
from rolebook.sources import sinks

STORE_VERSION = 1


def _stated(c: Column) -> Column:
    return F.when(c != "", c)


def select_candidates(
    seen: DataFrame, tracker: DataFrame, focus: str | None = None,
    limit: int = vocab.BATCH_LIMIT, everything: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(selected, report). New entries (or all but skipped ones) that are not
    tracked and match the focus; oldest first, the seven fields a scorer needs."""
    wanted = (F.coalesce("status", F.lit("")) != "skipped") if everything else (F.col("status") == "new")
    marked = joins.mark_tracked(seen.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), tracker)
    pool = focus_filter(marked.filter(F.col("_wanted") & ~F.col("tracked")), focus)
    fields = ["key", "title", "company", "url", "portal", "deadline", "posted_date"]
    selected = pool.orderBy("first_seen", "key").select(*fields)
    if limit > 0:
        selected = selected.limit(limit)
    hay = F.lower(F.concat_ws(" ", "title", "company", "strengths", "gaps"))
    in_focus = F.contains(hay, F.lit(focus.lower())) if focus else F.lit(True)
    eligible = F.count_if(F.col("_wanted") & ~F.col("tracked") & in_focus)
    deferred = F.greatest(eligible - limit, F.lit(0)) if limit > 0 else F.lit(0)
    report = marked.agg(
        eligible.alias("eligible"),
        deferred.cast("bigint").alias("deferred"),
        F.count_if(F.col("_wanted") & F.col("tracked")).alias("excluded_by_tracker"),
        F.count(F.lit(1)).alias("total_entries"),
    )
    return selected, report


def legacy_verdict(location: Column) -> Column:
    """A verdict an early store kept in ``location``, else NULL."""
    return F.when(location.isin(*vocab.VERDICTS), location)


def migrate_seen(seen: DataFrame, version: int = STORE_VERSION) -> DataFrame:
    """Move legacy verdicts out of ``location``; a newer store is refused."""
    if version > STORE_VERSION:
        raise ValueError(f"the seen store is version {version}, but only version {STORE_VERSION} is understood")
    legacy = legacy_verdict(F.col("location"))
    return seen.withColumns(
        {
            "location_verdict": F.when(legacy.isNotNull(), F.coalesce("location_verdict", legacy)).otherwise(F.col("location_verdict")),
            "location": F.when(legacy.isNull(), F.col("location")),
        }
    )


def apply_scores(seen: DataFrame, results: DataFrame, as_of, stage: str = "experienced") -> tuple[DataFrame, DataFrame]:
    """(store, errors): the store after scoring, with ``outcome`` ranked /
    expired / NULL and ``prev_score``, the stored score before.

    Absence is not a correction: a result without a deadline or language gate
    leaves the stored one. Results with an unknown key or a missing dimension
    are error rows and change nothing. Several results for one key are applied in
    the order of their position ``n``, each pushing the score before it into the
    history; without that column a repeated key is an error row and not applied.
    """
    if "n" not in results.columns:
        results = results.withColumn("n", F.lit(0))
    good, unknown = joins.join_scores(results, seen)
    gone = F.coalesce(F.col("status") == "expired", F.lit(False))
    judged = good.withColumn("_error", F.when(~gone, S.missing_dimension(F.col("scores"))))
    errors = unknown.unionByName(judged.filter("_error IS NOT NULL").select("key", F.col("_error").alias("error")))
    one = F.struct(
        "n",
        F.when(gone, "expired").otherwise("ranked").alias("outcome"),
        S.overall_score(F.col("scores"), stage).alias("score"),
        F.col("scores").alias("scores"),
        *[_stated(F.col(c)).alias(c) for c in ("location_verdict", "language_gate", "language_note", "deadline")],
        "strengths", "gaps",
    )
    fresh = judged.filter("_error IS NULL").groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("rs"))
    places = F.transform("rs", lambda r: r["n"])
    fresh = fresh.withColumn("_clash", F.size(F.array_distinct(places)) < F.size("rs"))
    clash = fresh.filter("_clash").select("key", F.lit("several results for one key at one position").alias("error"))
    joined = seen.join(fresh.filter("NOT _clash").drop("_clash"), "key", "left")
    # an expired result changes the status alone
    joined = joined.withColumn("_ranked", F.filter("rs", lambda r: r["outcome"] == "ranked"))
    outcome = F.element_at("rs", -1)["outcome"]
    ranked = F.coalesce(F.size("_ranked") > 0, F.lit(False))
    today = as_of_col(as_of)
    legacy = F.coalesce(_stated(F.col("location_verdict")), legacy_verdict(F.col("location")))
    texts = ("language_gate", "language_note", "deadline")
    start = F.struct(
        F.col("rank_score").cast("int").alias("score"), F.col("rank_verdict").alias("verdict"), F.col("rank_date").cast("string").alias("date"),
        F.col("rank_history").alias("history"), legacy.alias("location_verdict"), *texts, "strengths", "gaps",
    )

    def apply(had: Column, r: Column) -> Column:
        gate, note = r["language_gate"], F.coalesce(r["language_note"], had["language_note"])
        keep_note = F.when(gate.isNull(), had["language_note"]).when(gate != "PASS", note)
        return F.struct(
            r["score"].cast("int").alias("score"),
            S.band(r["score"]).alias("verdict"),
            today.cast("string").alias("date"),
            S.push_history(had["history"], had["score"], had["verdict"], had["date"]).alias("history"),
            F.coalesce(r["location_verdict"], had["location_verdict"]).alias("location_verdict"),
            F.coalesce(gate, had["language_gate"]).alias("language_gate"),
            keep_note.alias("language_note"),
            F.coalesce(r["deadline"], had["deadline"]).alias("deadline"),
            *[F.coalesce(F.slice(r[c], 1, 3), had[c]).alias(c) for c in ("strengths", "gaps")],
        )

    joined = joined.withColumn("_s", F.when(ranked, F.aggregate("_ranked", start, apply)))

    def old_unless(name: str, new: Column) -> Column:
        return F.when(ranked, new).otherwise(F.col(name))

    now = F.col("_s")
    updates = {
        "status": F.coalesce(outcome, F.col("status")),
        "location": F.when(ranked & legacy_verdict(F.col("location")).isNotNull(), F.lit(None).cast("string")).otherwise(F.col("location")),
        "location_verdict": old_unless("location_verdict", F.coalesce(now["location_verdict"], F.lit("PASS"))),
        **{c: old_unless(c, now[c]) for c in (*texts, "strengths", "gaps")},
        "rank_history": old_unless("rank_history", now["history"]),
        "rank_score": old_unless("rank_score", now["score"]),
        "rank_verdict": old_unless("rank_verdict", now["verdict"]),
        "rank_date": old_unless("rank_date", today),
    }
    out = joined.select(
        *[updates[c].alias(c) if c in updates else F.col(c) for c in seen.columns],
        outcome.alias("outcome"),
        F.when(ranked, F.col("rank_score")).alias("prev_score"),
    )
    return out, errors.unionByName(clash)


def score_store(spark: SparkSession, root: str, results: DataFrame, as_of, stage: str = "experienced") -> DataFrame:
    """:func:`apply_scores` on the written store, as a delta: only the entries that results name are read into
    the update, and only those that change are written. Returns the errors."""
    seen = sinks.read_seen(spark, root)
    asked = seen.join(results.select("key").distinct(), "key", "left_semi").select(*seen.columns)
    out, errors = apply_scores(asked, results, as_of, stage)
    sinks.write_delta(out.filter("outcome IS NOT NULL").select(*seen.columns), root)
    return errors


def _excluded(exclude: Sequence[str]) -> Column:
    return F.col("key").isin(*exclude) if exclude else F.lit(False)


def sweep_finding(as_of) -> Column:
    """What the sweep says of a ranked row: expired, closing (within seven
    days), unparseable, or ok. A blank deadline is left alone."""
    due = strict_iso("deadline")
    left = F.datediff(due, as_of_col(as_of))
    return (
        F.when(F.coalesce("deadline", F.lit("")) == "", "ok")
        .when(due.isNull(), "unparseable")
        .when(left < 0, "expired")
        .when(left <= vocab.URGENT_DAYS, "closing")
        .otherwise("ok")
    )


def sweep(seen: DataFrame, as_of, exclude: Sequence[str] = ()) -> DataFrame:
    """The swept rows with their ``sweep``. Only ranked rows are read, which
    on a store written by status is one partition."""
    rows = seen.filter(F.col("status") == "ranked").filter(~_excluded(exclude))
    return rows.withColumn("sweep", sweep_finding(as_of))


def apply_sweep(seen: DataFrame, as_of, exclude: Sequence[str] = ()) -> DataFrame:
    """The whole store after the sweep: expired rows carry that status."""
    ranked = F.coalesce(F.col("status") == "ranked", F.lit(False)) & ~_excluded(exclude)
    gone = ranked & (sweep_finding(as_of) == "expired")
    return seen.withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))


def compactable(as_of, exclude: Sequence[str] = (), older_than: int = vocab.COMPACT_AGE_DAYS) -> Column:
    """Whether a closed entry can never come back: no open deadline, dated,
    old enough, not excluded."""
    today, due, posted = as_of_col(as_of), strict_iso("deadline"), strict_iso("posted_date")
    past = due.isNull() | (due < today)
    old = F.coalesce(posted <= F.date_sub(today, older_than), F.lit(False))
    return past & old & ~_excluded(exclude)


def compact(seen: DataFrame, as_of, exclude: Sequence[str] = (), older_than: int = vocab.COMPACT_AGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped); together they are the store. Only skipped and expired
    rows can be dropped, so ``dropped`` reads just those partitions."""
    closed = F.col("status").isin("skipped", "expired")
    gone = compactable(as_of, exclude, older_than)
    return seen.filter(~(F.coalesce(closed, F.lit(False)) & gone)), seen.filter(closed).filter(gone)


# --- applications -----------------------------------------------------------------


def _quiet(tracker: DataFrame, activity: DataFrame, as_of) -> DataFrame:
    """Open, submitted applications with days since their last activity and
    how many follow-ups went out. ``activity`` has application_id, at, kind."""
    live = tracker.filter(is_open(F.col("status")) & (canon_status("status") != "drafted"))
    latest = activity.groupBy("application_id").agg(
        F.max("at").alias("_last"), F.count_if(F.col("kind") == "followup").alias("followups")
    )
    out = live.join(latest, "application_id", "left")
    last = F.greatest(F.col("date"), F.col("_last"))
    return out.withColumns(
        {
            "days_quiet": F.datediff(as_of_col(as_of), last),
            "followups": F.coalesce("followups", F.lit(0)),
        }
    ).drop("_last")


def followups_due(tracker: DataFrame, activity: DataFrame, as_of) -> DataFrame:
    """Quiet for seven days or more with fewer than two follow-ups sent."""
    q = _quiet(tracker, activity, as_of)
    return q.filter((F.col("days_quiet") >= vocab.FOLLOWUP_DAYS) & (F.col("followups") < vocab.FOLLOWUP_MAX))


def stale_applications(tracker: DataFrame, activity: DataFrame, as_of) -> DataFrame:
    """Quiet for thirty days or more."""
    return _quiet(tracker, activity, as_of).filter(F.col("days_quiet") >= vocab.STALE_DAYS)


def classify_signal(text: Column) -> Column:
    """interview, applied (an acknowledgement) or NULL: a view is noise."""
    low = F.lower(text)
    return (
        F.when(low.rlike(vocab.SIGNAL_NOISE), F.lit(None).cast("string"))
        .when(low.rlike(vocab.SIGNAL_INTERVIEW), "interview")
        .when(low.rlike(vocab.SIGNAL_ACK), "applied")
    )


def _rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in vocab.STAGE_RANK.items():
        out = F.when(canon_status(status) == name, rank).otherwise(out)
    return out


def advance_status(tracker: DataFrame, signals: DataFrame) -> DataFrame:
    """Tracker after message signals (application_id, at, text), with ``change``.

    A row only moves forward. An acknowledgement turns a draft into an
    application and sets its date. For a closed application it opens a new
    row (``change`` = reapplied) when it is later than the closed one.
    """
    kinds = signals.select("application_id", "at", classify_signal(F.col("text")).alias("signal")).filter("signal IS NOT NULL")
    best = kinds.groupBy("application_id").agg(
        F.max(_rank(F.col("signal"))).alias("signal_rank"),
        F.max(F.when(F.col("signal") == "applied", F.col("at"))).alias("ack_at"),
    )
    joined = tracker.join(best, "application_id", "left")
    signal = F.when(F.col("signal_rank") == vocab.STAGE_RANK["interview"], "interview").otherwise("applied")
    status = canon_status("status")
    final = status.isin(*vocab.FINAL_STATUSES)
    moves = ~final & F.coalesce(F.col("signal_rank") > _rank(F.col("status")), F.lit(False))
    sent = moves & (status == "drafted") & F.col("ack_at").isNotNull()
    again = final & F.coalesce(F.col("ack_at") > F.col("date"), F.lit(False))
    columns = [c for c in tracker.columns if c not in ("status", "date")]
    kept = F.struct(
        F.when(moves, signal).otherwise(status).alias("status"),
        F.when(sent, F.col("ack_at")).otherwise(F.col("date")).alias("date"),
        F.when(moves, "advanced").alias("change"),
    )
    extra = F.struct(F.lit("applied").alias("status"), F.col("ack_at").alias("date"), F.lit("reapplied").alias("change"))
    rows = F.when(again, F.array(kept, extra)).otherwise(F.array(kept))
    return joined.select(*columns, F.inline(rows))
