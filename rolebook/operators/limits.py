"""Limits, pages, per-source caps and row budgets, each saying what it cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolebook.session import cut, scratch_path


def limit_with_meta(df: DataFrame, order: Sequence, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, meta): the first rows by order and one row of total/truncated."""
    total = F.count(F.lit(1))
    cut = F.lit(False) if limit == 0 else total > limit
    meta = df.agg(total.alias("total"), cut.alias("truncated"))
    rows = df.orderBy(*order)
    return (rows if limit == 0 else rows.limit(limit)), meta


def page(df: DataFrame, order: Sequence, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """1-based page of ``size`` rows; ``truncated`` when rows follow it."""
    start = (max(1, number) - 1) * size
    rows = df.orderBy(*order)
    if size:
        rows = rows.offset(start).limit(size)
    total = F.count(F.lit(1))
    cut = (total > start + size) if size else F.lit(False)
    return rows, df.agg(total.alias("total"), cut.alias("truncated"))


class Pages:
    """Pages of an ordered table of any depth: the rows are sorted once into ranges, and a page
    reads only the one or two ranges it lies in.

    The ranges are written to the shared folder, a partition each, with the number of rows of each in
    the driver (``ranges`` numbers). Rows that the order does not tell apart stay in one range, in an order
    that is kept.
    """

    def __init__(self, df: DataFrame, order: Sequence, ranges: int = 200):
        spark = df.sparkSession
        self.path, self.columns, self.spark = scratch_path(spark, "pages"), df.columns, spark
        sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        # the id counts within a range, in its order
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        placed = sorted_.select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
        placed.write.partitionBy("_range").parquet(self.path)
        self.schema = placed.schema
        counts = spark.read.schema(self.schema).parquet(self.path).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()
        self.starts, total = [], 0
        for r in sorted(counts, key=lambda r: r["_range"]):
            self.starts.append((total, r["_range"], r["n"]))
            total += r["n"]
        self.total = total

    def page(self, number: int, size: int) -> DataFrame:
        """1-based page of ``size`` rows with their place in the order as ``row_no`` (from 1)."""
        lo = (max(1, number) - 1) * size
        wanted = [(start, part) for start, part, n in self.starts if start < lo + size and start + n > lo]
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("_range").isin([p for _, p in wanted]))
        first = F.lit(0).cast("bigint")
        for start, part in wanted:
            first = F.when(F.col("_range") == part, F.lit(start).cast("bigint")).otherwise(first)
        rows = rows.withColumn("row_no", first + F.col("_place") + 1)
        return rows.filter((F.col("row_no") > lo) & (F.col("row_no") <= lo + size)).orderBy("row_no").select(*self.columns, "row_no")


def source_cap(limit: int) -> int:
    """Rows wanted per source so that the later slice draws from every one."""
    return 50 if limit == 0 else min(200, max(limit * 3, 30))


def cap_per_source(df: DataFrame, limit: int, source: str = "portal", order: Sequence[str] = ("pos",)) -> DataFrame:
    """First rows of each source. The cap is small, so Spark trims each
    source's rows before the shuffle (window group limit). Adds ``pool_rank``."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= source_cap(limit))


def row_budget(df: DataFrame, budget: int, target: str = "pool_no") -> tuple[DataFrame, DataFrame]:
    """(rows, notes): whole sources in target order until their cumulative
    rows reach the budget; later sources are left out, and noted."""
    counts = cut(df.groupBy(target).agg(F.count(F.lit(1)).alias("rows")))  # counted once for both
    before = Window.orderBy(target).rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    taken = F.lit(True) if budget <= 0 else F.col("rows_before") < budget
    kept = df.join(plan.filter(taken).select(target), target, "left_semi")
    notes = plan.select(
        target, "rows", taken.alias("taken"),
        F.when(~taken, F.lit(f"row budget {budget} reached")).alias("note"),
    )
    return kept, notes
