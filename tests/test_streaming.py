import os
import shutil
import tempfile

from pyspark.sql import functions as F

from warung.sources import marts as M
from warung.streaming import events as ST

SRC = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.select(*ST.KEYS, "sessions").collect())


def test_stream_equals_batch_and_resumes(spark):
    base = tempfile.mkdtemp(prefix="warung-stream-")
    feed = os.path.join(base, "feed")
    os.makedirs(feed)
    full = spark.read.parquet(f"{SRC}/events.parquet")
    # split the feed into two files that arrive one after the other
    first = full.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second = full.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    first.coalesce(1).write.parquet(os.path.join(base, "p1"))
    second.coalesce(1).write.parquet(os.path.join(base, "p2"))
    part1 = [f for f in os.listdir(os.path.join(base, "p1")) if f.endswith(".parquet")][0]
    part2 = [f for f in os.listdir(os.path.join(base, "p2")) if f.endswith(".parquet")][0]
    shutil.copy(os.path.join(base, "p1", part1), os.path.join(feed, "events-1.parquet"))
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    after_first = ST.refresh_fact_events(spark, feed, out, ck, glob="events-*.parquet")
    assert _rows(after_first) == _rows(M.build_fact_events(first))
    shutil.copy(os.path.join(base, "p2", part2), os.path.join(feed, "events-2.parquet"))
    after_second = ST.refresh_fact_events(spark, feed, out, ck, glob="events-*.parquet")
    assert _rows(after_second) == _rows(M.build_fact_events(full))
    # a rerun with no new file adds nothing
    again = ST.refresh_fact_events(spark, feed, out, ck, glob="events-*.parquet")
    assert _rows(again) == _rows(after_second)


def _events(spark, rows):
    schema = spark.read.parquet(f"{SRC}/events.parquet").schema
    part = spark.createDataFrame(rows, "ts string, user_id long, event_type string")
    part = part.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schema])


def test_late_rows_are_kept(spark):
    """A row of day D that arrives after rows of day D+1 still counts."""
    base = tempfile.mkdtemp(prefix="warung-stream-late-")
    feed = os.path.join(base, "feed")
    os.makedirs(feed)
    events = lambda rows: _events(spark, rows)
    first = events([("2024-01-01 10:00:00", 1, "view"), ("2024-01-02 00:05:00", 1, "view")])
    late = events([("2024-01-01 23:59:00", 2, "view"), ("2024-01-02 10:00:00", 3, "view"), ("2024-01-01 10:30:00", 1, "view")])
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    for k, part in enumerate((first, late)):
        part.coalesce(1).write.parquet(os.path.join(base, f"p{k}"))
        name = [f for f in os.listdir(os.path.join(base, f"p{k}")) if f.endswith(".parquet")][0]
        shutil.copy(os.path.join(base, f"p{k}", name), os.path.join(feed, f"events-{k}.parquet"))
        mart = ST.refresh_fact_events(spark, feed, out, ck, glob="events-*.parquet")
    assert _rows(mart) == _rows(M.build_fact_events(first.unionByName(late)))


def test_a_batch_writes_and_reads_only_the_days_it_touches(spark):
    """Repeated and late rows, rows without a time or user; a replayed batch
    overwrites its own first try."""
    out = os.path.join(tempfile.mkdtemp(prefix="warung-stream-days-"), "out")
    parts = [_events(spark, [("2024-01-01 10:00:00", 1, "view"), ("2024-01-01 11:00:00", 1, "view"),
                             ("2024-01-02 09:00:00", 1, "view"), (None, 4, "view"), ("2024-01-03 09:00:00", None, "click")]),
             _events(spark, [("2024-01-02 10:00:00", 2, "click"), ("2024-01-02 12:00:00", 1, "view"), (None, 4, "view")]),
             _events(spark, [("2024-01-01 23:00:00", 1, "view"), ("2024-01-01 10:00:00", 5, "purchase")])]
    for k, part in enumerate(parts):
        ST.add_batch(part, k, out)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    want = {tuple(r) for r in M.build_fact_events(whole).select(*ST.KEYS, "sessions").collect()}
    got = lambda: {tuple(r) for r in ST.fact_events_from_sink(spark, out).select(*ST.KEYS, "sessions").collect()}
    assert got() == want
    days = lambda k: {p for p in os.listdir(f"{out}/user_days/batch={k}") if p.startswith("day=")}
    assert days(1) == {"day=2024-01-02"} and days(2) == {"day=2024-01-01"}
    assert spark.read.parquet(f"{out}/user_days/batch=1").count() == 1
    ST.add_batch(parts[2], 2, out)                      # replayed after a lost try
    assert got() == want
    ST.add_batch(parts[0], 3, out)                      # a file that comes twice adds nothing
    assert got() == want and not days(3)
    files = ST._seen(spark, out, ST.user_days(whole), 4, ["2024-01-02"]).inputFiles()
    plan = ST._seen(spark, out, ST.user_days(whole), 4, ["2024-01-02"])._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
