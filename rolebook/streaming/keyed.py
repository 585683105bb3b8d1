"""The seen store as keyed state of a stream: one state a posting, timers for its deadline.

Landed rows are postings or score results. The state of a key holds what the store would
(first sight, deadline, status, score), so a batch reads and writes the keys it names and no
table is searched. Older rows that land late move the first sight back; rows that
land again change nothing. A deadline sets a timer; when the clock of the landings
passes it, a ranked posting expires, with no row needed for it.

The clock is the latest ``landed_at``, when a row reached the landing folder. No row is late: the
watermark runs ``SLACK_DAYS`` behind the clock, and timers are set as much earlier. Changes are appended to a folder, those of a batch replaced as a whole when the batch
runs again; the state of the table is each key's last change.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolebook.operators.dedupe import with_dedupe_key
from rolebook.operators.scoring import band

LANDED_SCHEMA = (
    "id string, title string, company string, location string, posted_date string, url string, portal string, "
    "deadline string, score int, key string, seen_at timestamp, landed_at timestamp"
)
FIELDS = ("id", "title", "company", "location", "posted_date", "url", "portal")
CHANGE_SCHEMA = (
    f"key string, {', '.join(f'{c} string' for c in FIELDS)}, deadline string, status string, score int, "
    "first_seen timestamp, change string, version long"
)
STATE_SCHEMA = f"{', '.join(f'{c} string' for c in FIELDS)}, deadline string, status string, score int, first_seen long, version long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Days that the watermark lags, so that a row landed with any clock of that time is taken.
SLACK_DAYS = 10_000


def last_moment(deadline: str | None) -> int | None:
    """The first millisecond (UTC) after the day of an ISO deadline, as the watermark tells
    it; anything else has none."""
    try:
        day = dt.datetime.strptime(deadline or "", "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
    except ValueError:
        return None
    return int((day + dt.timedelta(days=1 - SLACK_DAYS)).timestamp() * 1000)


class SeenEntry(StatefulProcessor):
    """One posting: new, ranked, expired."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE_SCHEMA)

    def _changed(self, key, entry: dict, change: str) -> Row:
        entry["version"] += 1
        self.entry.update(tuple(entry[c] for c in (*FIELDS, "deadline", "status", "score", "first_seen", "version")))
        return Row(key=key, **{c: entry[c] for c in FIELDS}, deadline=entry["deadline"], status=entry["status"], score=entry["score"],
                   first_seen=entry["first_seen"], change=change, version=entry["version"])

    def _read(self) -> dict | None:
        if not self.entry.exists():
            return None
        got = self.entry.get()
        names = (*FIELDS, "deadline", "status", "score", "first_seen", "version")
        return dict(zip(names, tuple(got), strict=True))

    def _timer(self, before: str | None, now: str | None) -> None:
        old, new = last_moment(before), last_moment(now)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        key = key[0]
        postings, scores = [], []
        for r in rows:
            (postings if r["score"] is None else scores).append(r)
        entry = self._read()
        for r in sorted(postings, key=lambda r: (r["seen_at"], r["id"] or "")):
            if entry is None:
                entry = {c: r[c] for c in FIELDS} | {"deadline": r["deadline"], "status": "new", "score": None, "first_seen": r["seen_at"], "version": 0}
                self._timer(None, entry["deadline"])
                yield self._changed(key, entry, "new")
            elif (r["seen_at"], r["id"] or "") < (entry["first_seen"], entry["id"] or ""):
                # the first sight counts; a deadline once stated stays
                deadline = r["deadline"] or entry["deadline"]
                self._timer(entry["deadline"], deadline)
                entry |= {c: r[c] for c in FIELDS} | {"deadline": deadline, "first_seen": r["seen_at"]}
                yield self._changed(key, entry, "seen earlier")
        for r in sorted(scores, key=lambda r: (r["seen_at"], r["score"])):
            if entry is None:
                none = {c: None for c in FIELDS}
                yield Row(key=key, **none, deadline=None, status=None, score=r["score"], first_seen=None, change="unknown key", version=0)
                continue
            if entry["status"] == "ranked" and entry["score"] == r["score"]:
                continue
            if entry["status"] != "expired":
                entry |= {"status": "ranked", "score": r["score"]}
                due = last_moment(entry["deadline"])
                if due is not None:
                    self.handle.registerTimer(due)  # it may have gone by while the posting was new
                yield self._changed(key, entry, "ranked")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self._read()
        if entry is not None and entry["status"] == "ranked":
            entry["status"] = "expired"
            yield self._changed(key[0], entry, "expired")

    def close(self) -> None:
        pass


def changes(landed: DataFrame) -> DataFrame:
    """The stream of changes of a stream of landed rows."""
    rows = with_dedupe_key(landed).withColumn("key", F.coalesce("key", "dedupe_key")).drop("dedupe_key")
    # moments travel as numbers, free of any worker's time zone
    clocked = rows.withWatermark("landed_at", f"{SLACK_DAYS} days").withColumn("seen_at", F.unix_micros("seen_at"))
    kind = CHANGE_SCHEMA.replace("first_seen timestamp", "first_seen long")
    out = clocked.groupBy("key").transformWithState(SeenEntry(), kind, "Update", "EventTime")
    return out.withColumn("first_seen", F.timestamp_micros("first_seen"))


def write_changes(batch: DataFrame, batch_id: int, out: str) -> None:
    """A batch's changes in a folder of its own: running it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def run(spark: SparkSession, path: str, out: str, files_per_trigger: int = 1000):
    """Start the stream over what has landed and return its query. Offsets and state are kept
    beside the changes; the state store is RocksDB, so state need not fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    landed = spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return (
        changes(landed).writeStream.foreachBatch(lambda df, batch_id: write_changes(df, batch_id, out))
        .outputMode("update").option("checkpointLocation", f"{out}/_offsets").trigger(availableNow=True).start()
    )


def history(spark: SparkSession, out: str) -> DataFrame:
    """All changes, with the ``batch`` they were made in."""
    return spark.read.schema(f"{CHANGE_SCHEMA}, batch long").parquet(out)


def entries(spark: SparkSession, out: str) -> DataFrame:
    """The store: each key's last change, with its verdict."""
    known = history(spark, out).filter("version > 0")
    last = known.groupBy("key").agg(F.max_by(F.struct(*[c for c in known.columns if c not in ("key", "batch")]), "version").alias("e"))
    return last.select("key", "e.*").withColumn("verdict", band(F.col("score")))
