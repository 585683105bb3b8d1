"""Repeated scrapes into the seen table, as a stream.

Landed posting files flow in; each new posting becomes one ``new`` row of an
append-only table, partitioned by a bucket of its key and by ingest batch. A batch
reads the keys of the buckets it touches. A replayed batch overwrites its own
partitions, so a restart adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolebook.operators import joins
from rolebook.operators.dedupe import with_dedupe_key
from rolebook.operators.state import migrate_seen

LANDED_SCHEMA = (
    "id string, title string, company string, location string, posted_date string, url string, "
    "portal string, deadline string, ingested_at timestamp"
)
TABLE_SCHEMA = (
    "key string, title string, company string, location string, posted_date string, url string, portal string, "
    "deadline string, status string, location_verdict string, first_seen date, bucket int, ingest_batch bigint"
)
#: Folders that keys are dealt over; fixed for the life of a table.
BUCKETS = 64


def create_table(spark: SparkSession, out: str) -> None:
    """An empty table where there is none; an existing one is left alone."""
    spark.createDataFrame([], TABLE_SCHEMA).write.mode("ignore").partitionBy("bucket", "ingest_batch").parquet(out)


def read_table(spark: SparkSession, out: str) -> DataFrame:
    """The ingested seen table."""
    return spark.read.schema(TABLE_SCHEMA).parquet(out)


def keyed(landed: DataFrame) -> DataFrame:
    rows = with_dedupe_key(landed).withColumnRenamed("dedupe_key", "key")
    return rows.withColumns({"status": F.lit("new"), "location_verdict": F.lit(None).cast("string")})


def upsert_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Append the rows whose key the table does not hold yet.

    Rows of the same batch id are ignored when looking for known keys, so a
    replay stores the same keys as the first run.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    # at most BUCKETS numbers
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
    earlier = read_table(spark, out).filter(F.col("bucket").isin(touched) & (F.col("ingest_batch") < batch_id))
    first = batch.groupBy("key").agg(
        F.min_by(F.struct(*[c for c in batch.columns if c != "key"]), F.struct("ingested_at", "id")).alias("_row")
    ).select("key", "_row.*")
    fresh = migrate_seen(joins.only_new(first, earlier, key="key"))
    rows = fresh.select(
        "key", "title", "company", "location", "posted_date", "url", "portal", "deadline", "status",
        "location_verdict", F.col("ingested_at").cast("date").alias("first_seen"), "bucket", F.lit(batch_id).cast("bigint").alias("ingest_batch"),
    )
    # only the partitions of this batch are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "ingest_batch").parquet(out)


def stream_ingest(
    spark: SparkSession, path: str, out: str, checkpoint: str | None = None, files_per_trigger: int = 1000,
):
    """Start the ingest over what has landed and return its query.

    Duplicates are found in the batch and in the key buckets of the table that it touches;
    :mod:`rolebook.streaming.keyed` keeps them as state instead. Offsets are kept beside the table by default, because batch
    numbers only mean something together with it.
    """
    create_table(spark, out)
    landed = (
        spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
    return (
        keyed(landed).writeStream.foreachBatch(lambda df, batch_id: upsert_batch(df, batch_id, out))
        .option("checkpointLocation", checkpoint or f"{out}/_offsets")
        .trigger(availableNow=True)
        .start()
    )
