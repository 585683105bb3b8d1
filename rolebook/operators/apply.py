"""Batch applications: references to packs, one row for each entry of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.operators import joins, packs
from rolebook.operators import scoring as S


def apply_batch(
    entries: DataFrame, errors: DataFrame, postings: DataFrame, cand: Column, profile: Column, skills: Column, as_of,
    max_age_days: int = vocab.APPLY_MAX_AGE_DAYS,
) -> DataFrame:
    """Resolve, gate, score and pack each entry (ref, description) of a batch.

    One row per entry and per error row of the batch's reader: ``ok``, ``code`` and
    ``error`` say what failed; built rows have the gates, ``pass``, the score and the
    pack. A failed gate does not stop a pack. A description pasted with the entry
    replaces the posting's. Only postings that some entry names are read as texts.
    """
    resolved = joins.resolve_refs(entries.select("ref", F.col("description").alias("pasted")), postings)
    named = resolved.join(postings.withColumnRenamed("id", "posting_id"), "posting_id", "left")
    pasted = F.when(F.coalesce("pasted", F.lit("")) != "", F.col("pasted"))
    found = named.where("posting_id IS NOT NULL").withColumn("description", F.coalesce(pasted, "description"))
    scored = S.score_posting(S.gated(found, cand, as_of, True, max_age_days), cand, as_of)
    built = packs.build_packs(packs.with_keyword_gaps(scored.drop("gaps"), skills), profile)
    kept = ("ref", "posting_id", "gates", "pass", "score", "verdict", "pack")
    built = built.select(*kept, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"))
    lost = named.where("posting_id IS NULL").select(
        "ref", F.lit(False).alias("ok"), F.lit("apply-failed").alias("code"), F.concat(F.lit("cannot resolve posting: "), "ref").alias("error")
    )
    wrong = errors.select("ref", F.lit(False).alias("ok"), "code", "error")
    return built.unionByName(lost, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True)
