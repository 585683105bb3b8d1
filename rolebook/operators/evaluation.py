"""Measuring gates, dedupe and rankings against labels or a second run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook.operators.scoring import band


def _rates(rejected: Column, flagged: Column, label: Column) -> list[Column]:
    keep, reject = label != "REJECT", label == "REJECT"

    def share(part, whole, name):
        return F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole).cast("double")).alias(name)

    return [
        F.count(F.lit(1)).alias("postings"),
        share(rejected, keep, "false_reject_rate"),
        share(~rejected, reject, "false_accept_rate"),
        share(label == "KEEP_WITH_FLAG", flagged, "flag_precision"),
    ]


def evaluate_gates(gated: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates overall (gate ``all``) and per gate. ``labels`` has id and label
    KEEP, KEEP_WITH_FLAG or REJECT.

    The overall row and the seven gates come from one pass: each posting is
    expanded to eight small rows that aggregate before the shuffle.
    """
    whole = F.struct(
        F.lit("all").alias("gate"),
        (~F.col("pass")).alias("rejected"),
        F.exists("gates", lambda g: g["verdict"] == "FLAG").alias("flagged"),
    )
    each = F.transform(
        "gates",
        lambda g: F.struct(
            g["gate"].alias("gate"), (g["verdict"] == "FAIL").alias("rejected"), (g["verdict"] == "FLAG").alias("flagged")
        ),
    )
    rows = gated.select("id", F.array_append(each, whole).alias("r")).join(labels.select("id", "label"), "id")
    flat = rows.select("label", F.inline("r"))
    return flat.groupBy("gate").agg(*_rates(F.col("rejected"), F.col("flagged"), F.col("label")))


def evaluate_dedupe(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Precision and recall per pair kind. ``pairs`` has left_id, right_id,
    kind and label SAME / DIFFERENT; ``groups`` maps id to its group."""
    left = groups.select(F.col("id").alias("left_id"), F.col("group").alias("_l"))
    right = groups.select(F.col("id").alias("right_id"), F.col("group").alias("_r"))
    joined = pairs.join(left, "left_id").join(right, "right_id")
    same, said = F.col("label") == "SAME", F.col("_l") == F.col("_r")
    hit = F.count_if(same & said)
    return joined.groupBy("kind").agg(
        F.count(F.lit(1)).alias("pairs"),
        hit.alias("true_merges"),
        F.count_if(~same & said).alias("false_merges"),
        F.try_divide(hit.cast("double"), F.count_if(said).cast("double")).alias("precision"),
        F.try_divide(hit.cast("double"), F.count_if(same).cast("double")).alias("recall"),
    )


def _ranks(cells: DataFrame, score: str, out: str) -> DataFrame:
    """Rank of each distinct score, ties sharing their average rank, from (score, n)
    cells: at most 101 rows are ordered."""
    counts = cells.groupBy(score).agg(F.sum("n").alias("_n"))
    before = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(score, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(out))


def _score(c: str) -> Column:
    """An integer score of 0 to 100; anything else fails."""
    ok = F.col(c).between(0, 100) & (F.col(c) == F.floor(c))
    return F.when(ok | F.col(c).isNull(), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no integer score of 0 to 100: "), c)).cast("int"))


def rank_stability(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """One row comparing two rankings (id, score): Spearman rho, top-k overlap,
    band churn, and the root mean variance of a posting's two scores.

    Rows meet once, on id; everything else follows from how often each pair of
    scores occurs, at most 101 x 101 cells."""
    a = first.select("id", _score("score").alias("a"))
    b = second.select("id", _score("score").alias("b"))
    cells = a.join(b, "id").where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = cells.join(_ranks(cells, "a", "x"), "a").join(_ranks(cells, "b", "y"), "b")
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    total = both.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("postings"),
        *[F.sum(n * v).alias(c) for c, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))],
        F.coalesce(F.sum(F.when(band(F.col("a")) != band(F.col("b")), n).otherwise(0)), F.lit(0)).alias("band_churn"),
        F.sum(n * (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 2.0).alias("var"),
    )
    m = F.col("postings")
    spread = F.sqrt((m * F.col("sxx") - F.col("sx") * F.col("sx")) * (m * F.col("syy") - F.col("sy") * F.col("sy")))
    stats = total.select(
        "postings",
        F.try_divide(m * F.col("sxy") - F.col("sx") * F.col("sy"), spread).alias("spearman"),
        "band_churn",
        F.sqrt(F.try_divide("var", m)).alias("score_sigma"),
    )
    tops = (
        a.orderBy(F.col("a").desc(), "id").limit(k).select("id")
        .join(b.orderBy(F.col("b").desc(), "id").limit(k).select("id"), "id")
        .agg(F.count(F.lit(1)).alias("top_k_overlap"))
    )
    both_rows = stats.unionByName(tops, allowMissingColumns=True)
    return both_rows.agg(*[F.max(c).alias(c) for c in both_rows.columns])
