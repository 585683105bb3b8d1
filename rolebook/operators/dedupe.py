"""Pools of postings: union, round-robin order, first-seen dedupe, collapse.

Postings carry ``pool_no`` (source order) and ``pos`` (unique within a pool).
No step gathers a whole pool, company or key in one task: positions are
counted per fixed span of ``pos`` and winners are picked by partial
aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolebook.functions.urls import dedupe_key, req_id
from rolebook.operators.gates import canonical_gate

#: Rows of one pool that may share a task: ``pos`` is unique within a pool, so
#: a span of this width can never hold more rows than this.
SPAN = 1 << 16


def union_pools(*pools: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)


#: Rows without a position that may share a task are a pool's such rows over this many.
UNPLACED = 1 << 12


#: What :func:`with_keys` adds.
KEYS = ("dedupe_key", "_merge", "_company", "_req", "_content")


def _content(df: DataFrame) -> Column:
    """A number from the whole row (maps have no hash and are left out)."""
    keys = KEYS if "_content" in df.columns else ()
    return F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name not in keys])


def same(pairs: dict[str, str]) -> Column:
    """Null-safe equality of columns named in pairs."""
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()])


def pool_rank(df: DataFrame, pool: str = "pool_no", pos: str = "pos", out: str = "pool_rank", span: int = SPAN) -> DataFrame:
    """1-based position of each row within its pool, for pools of any size.

    A plain ``row_number`` would sort a whole pool in one task. Here rows are
    numbered inside (pool, span) groups of bounded size and shifted by the
    number of rows in earlier spans; only the per-span counts are ordered by
    pool. Rows without a pool are a pool of their own; rows without a position come
    last in theirs, ordered by a hash of the row.
    """
    tagged = df.withColumn("_hash", _content(df)).withColumn("_late", F.col(pos).isNull())
    unplaced = F.pmod("_hash", F.lit(UNPLACED))
    tagged = tagged.withColumn("_span", F.when(F.col("_late"), unplaced).otherwise(F.floor(F.col(pos) / F.lit(span))).cast("bigint"))
    group = [pool, "_late", "_span"]
    inner = Window.partitionBy(*group).orderBy(pos, "_hash")
    counts = tagged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(pool).orderBy("_late", "_span").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col(pool).alias("_of_pool"), F.col("_late").alias("_of_late"), F.col("_span").alias("_of_span"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    numbered = tagged.withColumn("_local", F.row_number().over(inner))
    return (
        numbered.join(shift, same({pool: "_of_pool", "_late": "_of_late", "_span": "_of_span"}))
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_span", "_late", "_hash", "_local", "_shift", "_of_pool", "_of_late", "_of_span")
    )


def interleave(df: DataFrame) -> DataFrame:
    """Adds ``pool_rank``; (pool_rank, pool_no) is the round-robin order."""
    return pool_rank(df)


def round_robin_order() -> list[Column]:
    return [F.col("pool_rank").asc_nulls_last(), F.col("pool_no").asc_nulls_last()]


def with_dedupe_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", dedupe_key("url", "company", "title", "location"))


def round_robin_place() -> Column:
    """(pool_rank, pool_no) as one number, so that winners aggregate on plain longs; a row
    without a pool comes after the rows of its rank with one."""
    rank, pool = F.col("pool_rank"), F.coalesce(F.col("pool_no"), F.lit(1 << 16))
    place = F.shiftleft(rank.cast("bigint"), 17).bitwiseOR(pool.cast("bigint"))
    known = F.col("pool_no").isNull() | F.col("pool_no").between(0, 65535)
    return F.when(known, place).otherwise(F.raise_error(F.lit("pool_no must be 0 to 65535")).cast("bigint"))


def _short(c: Column) -> Column:
    """A text, or the digest of a long one: equal where the texts are."""
    return F.when(F.length(c) > 64, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def with_keys(df: DataFrame) -> DataFrame:
    """Adds what :func:`merge_pools` and :func:`collapse_spread` compare, as short columns.

    They compute it themselves where it is not there. Added before rows are dealt out, it spares
    the shuffles the texts that it comes from, unless the caller keeps those.
    """
    content = _content(df)
    keyed = with_dedupe_key(df).withColumns({"_merge": _short(F.col("dedupe_key")), "_content": content})
    return keyed.select("*", *spread_key())


def merge_pools(ranked: DataFrame) -> DataFrame:
    """First-seen row per dedupe key in round-robin order, with ``copies``.

    Winners are found on the key and the place alone; whole rows meet them in one join
    on both, as no two rows share a place. The number of duplicates is ``sum(copies - 1)``.
    """
    early = "_merge" in ranked.columns
    keyed = ranked if early else with_dedupe_key(ranked).withColumn("_merge", _short(F.col("dedupe_key")))
    keyed = keyed.withColumn("_place", round_robin_place())
    won = keyed.groupBy(F.col("_merge").alias("_key")).agg(F.min("_place").alias("_at"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(won, same({"_place": "_at", "_merge": "_key"})).drop("_place", "_at", "_key", "_merge")


def duplicate_count(merged: DataFrame) -> DataFrame:
    return merged.agg(F.sum(F.col("copies") - 1).alias("duplicates"), F.count(F.lit(1)).alias("kept"))


def spread_key() -> list[Column]:
    return [
        F.lower(F.col("company")).alias("_company"),
        _short(F.coalesce(req_id("url"), F.lower(F.col("title")))).alias("_req"),
    ]


def collapse_spread(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per company and requisition, other cities noted in ``location``.

    The first row wins; of rows with equal ordering columns the one with the least hash
    of its content. Rows are reduced to one per (group, location) before
    the group itself is formed, so a group holds its distinct places only.
    ``group_size`` counts the input rows of the group.
    """
    order = order or ["pool_rank", "pool_no", "id"]
    early = "_content" in df.columns
    columns = [c for c in df.columns if not early or c not in KEYS[1:]]
    df = df.withColumn("_hash", F.col("_content") if early else _content(df))
    order = [*order, "_hash"]
    keyed = (df if early else df.select("*", *spread_key())).withColumn("_place", F.coalesce("location", F.lit("")))
    rank = F.struct(*order)
    # winners and places on the ordering columns alone; whole rows meet them once
    places = keyed.groupBy("_company", "_req", "_place").agg(F.min(rank).alias("_rank"), F.count(F.lit(1)).alias("_n"))
    won = places.groupBy("_company", "_req").agg(
        F.min("_rank").alias("_first"),
        F.array_sort(F.collect_list(F.struct("_rank", "_place"))).alias("_places"),
        F.sum("_n").alias("group_size"),
    )
    won = won.select(*[F.col(f"_first.{c}").alias(f"_w_{c}") for c in order], "_places", "group_size")
    groups = df.join(won, same({c: f"_w_{c}" for c in order})).dropDuplicates(order)  # rows alike
    cities = F.col("_places._place")
    extra = F.size("_places") - 1
    spread = F.concat(
        cities[0], F.lit(" (+"), extra.cast("string"), F.lit(" cities: "),
        F.array_join(F.slice(cities, 2, F.greatest(extra, F.lit(1))), ", "), F.lit(")"),
    )
    return groups.select(
        *[c for c in columns if c != "location"],
        F.when(extra > 0, spread).otherwise(F.col("location")).alias("location"),
        "group_size",
    )


def diff_sets(expected: DataFrame, actual: DataFrame, by: list[str], column: str) -> DataFrame:
    """Names on one side only (aliases collapsed): ``side`` is missing or extra."""
    def canon(df):
        return df.select(*by, canonical_gate(F.col(column)).alias(column)).distinct()

    a, b = canon(expected), canon(actual)
    missing = a.join(b, [*by, column], "left_anti").withColumn("side", F.lit("missing"))
    extra = b.join(a, [*by, column], "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)
