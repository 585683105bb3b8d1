"""Sinks: versioned seen store and rendered posting lists."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LEDGER = "version bigint, seq bigint, folder string"


def _place(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the session's storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Sequence numbers that were ever taken, by the names of the ledger's files."""
    fs, where = _place(spark, f"{root}/ledger")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[6:-5]) for n in names if n.startswith("entry-") and n.endswith(".json"))


def ledger(spark: SparkSession, root: str) -> list:
    """(version, seq, folder) of every write, oldest first; a few rows a version. Reading
    writes nothing: a store that was never written has no entries."""
    if not _numbers(spark, root):
        return []
    rows = spark.read.schema(LEDGER).json(f"{root}/ledger").filter("folder IS NOT NULL").collect()
    return sorted(rows, key=lambda r: r.seq)


def _enter(spark: SparkSession, root: str, seq: int, version: int, folder: str) -> None:
    """Make a folder current under a number that nobody else has: the file is created only
    if it is not there, so the second of two writers fails and its folder stays unnamed."""
    fs, where = _place(spark, f"{root}/ledger/entry-{seq:010d}.json")
    try:
        out = fs.create(where, False)
    except Exception as e:
        raise RuntimeError(f"another writer took number {seq} of the store {root}") from e
    out.write(bytearray(json.dumps({"version": version, "seq": seq, "folder": folder}) + "\n", "utf-8"))
    out.close()


def write_seen(df: DataFrame, root: str, version: int) -> None:
    """Replace the whole store as a new version.

    Every write goes to a folder of its own and becomes current only when the ledger
    names it, so a failed write leaves the old store in place, also where it rewrites
    the current version. A version older than the current one is refused, and so is a write that another
    one overtook. Partitioned by ``status``: a sweep reads only ranked rows, a compaction only closed ones.
    """
    spark = df.sparkSession
    known, taken = ledger(spark, root), _numbers(spark, root)
    if known and version < known[-1].version:
        raise ValueError(f"version {version} is older than the store's version {known[-1].version}")
    folder = f"version={version}-{uuid.uuid4().hex}"
    df.write.partitionBy("status").parquet(f"{root}/data/{folder}")
    _enter(spark, root, taken[-1] + 1 if taken else 0, int(version), folder)


def write_delta(rows: DataFrame, root: str) -> None:
    """Whole new states of some entries, one row a key, beside the store: what is written grows with
    the rows, not with the store. They count as soon as the ledger names them; a write that fails before
    leaves the store as it was."""
    spark = rows.sparkSession
    known, taken = ledger(spark, root), _numbers(spark, root)
    if not known:
        raise ValueError("the store was never written")
    folder = f"delta-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/data/{folder}")
    _enter(spark, root, taken[-1] + 1, known[-1].version, folder)


def fold(spark: SparkSession, root: str, share: float = 0.1) -> bool:
    """Rewrite the store with its deltas in it once they have over ``share`` of its rows; whether it did."""
    base, deltas = _folders(spark, root, None)
    if not deltas:
        return False
    count = lambda names: spark.read.parquet(*[f"{root}/data/{n}" for n in names]).count()
    if count(deltas) <= share * count([base]):
        return False
    write_seen(read_seen(spark, root), root, current_version(spark, root))
    return True


def current_version(spark: SparkSession, root: str) -> int:
    rows = ledger(spark, root)
    if not rows:
        raise ValueError("the store was never written")
    return rows[-1].version


def _folders(spark: SparkSession, root: str, version: int | None) -> tuple[str, list[str]]:
    """(folder of the last whole write, folders of the deltas after it, oldest first)."""
    rows = [r for r in ledger(spark, root) if version in (None, r.version)]
    whole = [i for i, r in enumerate(rows) if not r.folder.startswith("delta-")]
    if not whole:
        raise ValueError(f"the store has no version {version}" if version is not None else "the store was never written")
    return rows[whole[-1]].folder, [r.folder for r in rows[whole[-1] + 1 :]]


def read_seen(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version of the store (or a named one, as last written), with the last delta of
    each key in place of its row. The store itself is the streamed side of a join with the deltas' keys
    and is not shuffled for a few of them; a filter on ``status`` still reads its partitions alone."""
    base, deltas = _folders(spark, root, version)
    store = spark.read.parquet(f"{root}/data/{base}")
    if not deltas:
        return store
    parts = [spark.read.schema(store.schema).parquet(f"{root}/data/{d}").withColumn("_seq", F.lit(i)) for i, d in enumerate(deltas)]
    every = reduce(DataFrame.unionByName, parts)
    last = every.groupBy("key").agg(F.max_by(F.struct(*[c for c in store.columns if c != "key"]), "_seq").alias("_row"))
    kept = store.join(every.select("key").distinct(), "key", "left_anti")
    return kept.select(*store.columns).unionByName(last.select("key", "_row.*").select(*store.columns))


def _cell(name: str, missing: str | None = None):
    c = F.col(name).cast("string")
    if missing is not None:
        c = F.coalesce(c, F.lit(missing))
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


TABLE_HEAD = "TITLE | COMPANY | LOCATION | DATE | URL"


def render(df: DataFrame, fmt: str) -> DataFrame:
    """Adds ``line``: a JSON object, a pipe-table row or plain text.

    In the table pipes are escaped and newlines folded; a missing place reads
    ``unspecified`` and a missing date ``undated``.
    """
    if fmt == "json":
        fields = [c for c in ("id", "title", "company", "location", "url", "portal", "source") if c in df.columns]
        date = F.col("posted_date").cast("string").alias("postedDate")
        return df.withColumn("line", F.to_json(F.struct(*fields, date), {"ignoreNullFields": "false"}))
    place, day = ("location", "unspecified"), ("posted_date", "undated")
    if fmt == "table":
        return df.withColumn("line", F.concat_ws(" | ", _cell("title"), _cell("company"), _cell(*place), _cell(*day), _cell("url")))
    if fmt == "plain":
        where = F.coalesce("location", F.lit(place[1]))
        when = F.coalesce(F.col("posted_date").cast("string"), F.lit(day[1]))
        return df.withColumn(
            "line", F.concat("title", F.lit(" — "), "company", F.lit(" ("), where, F.lit(", "), when, F.lit(")\n"), "url")
        )
    raise ValueError(f"format must be json, table or plain, not {fmt}")


def write_rendered(df: DataFrame, fmt: str, path: str) -> None:
    render(df, fmt).select("line").write.mode("overwrite").text(path)
