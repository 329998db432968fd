"""Incremental build of the visitor mart (B3) with Structured Streaming.

The dashboard reads ``fact_events`` (sessions per day, funnel stage and
traffic source; a session is a distinct user-day).  When event files keep
arriving, this job reads only new files (file stream source) and, batch by
batch, keeps two tables under ``out_path``:

* ``user_days``: the (day, stage, source, user) rows that no earlier batch had,
  in ``batch`` and ``day`` directories.  A batch is compared with earlier rows
  of the days that it touches only; other days are not read.
* ``counts``: how many users these rows add per day, stage and source.

The rows of different batches are disjoint, so the mart is the sum of the
counts and never reads events or user-days again.  There is no watermark: a row
that arrives late counts on its own day, a repeated one adds nothing, and the
mart equals the batch build whatever the order of arrival.

A batch writes directories of its own number only.  The checkpoint replays an
unfinished batch with the same number and files, which overwrites what the lost
try left, so nothing counts twice.  Checkpoint and ``out_path`` belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warung.functions.scalars import day_ts
from warung.sources.marts import funnel_stage_of, traffic_source_of

KEYS = ["tanggal", "event_type", "traffic_source"]


def user_days(events: DataFrame) -> DataFrame:
    """(day, stage, source, user) of an event frame."""
    return events.select(day_ts(F.col("ts")).alias("tanggal"),
                         funnel_stage_of(F.col("event_type")).alias("event_type"),
                         traffic_source_of(F.col("user_id")).alias("traffic_source"),
                         "user_id")


def _day(tanggal):
    """The directory name of a day; rows without a time share one."""
    return F.coalesce(F.date_format(tanggal, "yyyy-MM-dd"), F.lit("none"))


def _seen(spark: SparkSession, out_path: str, like: DataFrame, batch_id: int, days: list[str]) -> DataFrame:
    """The user-days that earlier batches kept for these days."""
    schema = ", ".join(f"{n} {t}" for n, t in like.dtypes) + ", batch long, day string"
    return (spark.read.schema(schema).option("basePath", f"{out_path}/user_days").parquet(f"{out_path}/user_days")
            .where((F.col("batch") < batch_id) & F.col("day").isin(days)))


def add_batch(events: DataFrame, batch_id: int, out_path: str) -> None:
    """Keep the user-days of one batch that are new, and count them.

    The days of a batch (a calendar domain) come to the driver, so that the
    files of other days are pruned; the users of a hot day are spread by the
    whole key."""
    spark = events.sparkSession
    rows = user_days(events)
    fresh = rows.distinct()
    if batch_id > 0:
        days = [r["day"] for r in rows.select(_day(F.col("tanggal")).alias("day")).distinct().collect()]
        old = _seen(spark, out_path, rows, batch_id, days).select(*[F.col(c).alias(f"old_{c}") for c in rows.columns])
        same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in rows.columns]
        fresh = fresh.join(old, same, "left_anti")
    kept, counts = (f"{out_path}/{name}/batch={batch_id}" for name in ("user_days", "counts"))
    (fresh.withColumn("day", _day(F.col("tanggal"))).hint("rebalance", F.col("day"))
     .write.mode("overwrite").partitionBy("day").parquet(kept))
    added = spark.read.schema(rows.schema).parquet(kept).groupBy(*KEYS).agg(F.count("user_id").alias("sessions"))
    added.write.mode("overwrite").parquet(counts)


def start_events_stream(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                        glob: str = "events*.parquet",
                        available_now: bool = True, max_files_per_trigger: int | None = None
                        ) -> StreamingQuery:
    """Start the incremental job: new event files under ``src_dir`` matching
    ``glob`` -> new user-days and their counts under ``out_path``."""
    schema = spark.read.parquet(f"{src_dir.rstrip('/')}/{glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (reader.parquet(src_dir).writeStream
              .foreachBatch(lambda events, batch_id: add_batch(events, batch_id, out_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def fact_events_from_sink(spark: SparkSession, out_path: str) -> DataFrame:
    """The mart: the counts of all batches, added up."""
    schema = "tanggal timestamp_ntz, event_type string, traffic_source string, sessions long, batch long"
    return (spark.read.schema(schema).parquet(f"{out_path}/counts")
            .groupBy(*KEYS)
            .agg(F.sum("sessions").alias("sessions")))


def refresh_fact_events(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                        glob: str = "events*.parquet") -> DataFrame:
    """Process every file not yet seen, then return the up-to-date mart."""
    q = start_events_stream(spark, src_dir, out_path, checkpoint, glob, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced by awaitTermination
        raise q.exception()
    return fact_events_from_sink(spark, out_path)
