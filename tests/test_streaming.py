"""Streams against their batch forms on the same rows."""

import uuid

from pyspark.sql import functions as F

from folioscope.operators import state
from folioscope.sources import fixtures
from folioscope.streaming import pages

DIR = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, make, mode="update"):
    """The last row of every key of a stream over df's files."""
    path, name = f"{tmp_path}/in", "q" + uuid.uuid4().hex[:8]
    df.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    kept = []
    q = make(stream).writeStream.outputMode(mode).queryName(name).foreachBatch(lambda d, k: kept.append(d.toPandas())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return kept


def test_page_states(spark, tmp_path):
    scan = fixtures.scan(spark, DIR).where("session_id < 40")
    at = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    events = scan.select("session_id", "page_num", at.alias("at"), "event", (F.col("event_id") % 7 == 0).alias("truncated"), F.lit(0).alias("warnings"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))
    batch = {(r.session_id, r.page_num): (r.state, r.attempts, r.error) for r in state.page_states(events, ["at"]).collect()}
    last = {}
    for frame in run(spark, tmp_path, events, pages.page_states):
        for r in frame.itertuples():
            last[r.session_id, r.page_num] = (r.state, r.attempts, r.error)
    assert last == batch


def test_reduced(spark, tmp_path):
    scan = fixtures.scan(spark, DIR).where("session_id < 40")
    at = F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    events = scan.select("session_id", "page_num", at.alias("at"), (F.floor(F.col("event_id") / 400) + 1).cast("int").alias("attempt"), "event", (F.col("event_id") % 11).cast("int").alias("det_index"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), (F.col("event_id") % 13 == 0).alias("truncated"))
    batch = {(r.session_id, r.page_num): (r.attempts, r.detections, r.markdown, r.truncated, r.error) for r in state.reduce_events(events, ["at"]).collect()}
    last = {}
    for frame in run(spark, tmp_path, events, pages.reduced):
        for r in frame.itertuples():
            last[r.session_id, r.page_num] = (r.attempts, r.detections, r.markdown, r.truncated, r.error)
    assert last == batch


def test_windows_and_duplicates(spark, tmp_path):
    scan = fixtures.scan(spark, DIR)
    twice = scan.withColumn("seq", F.col("event_id")).union(scan.withColumn("seq", F.col("event_id")))
    kept = run(spark, tmp_path, twice.repartition(1), lambda s: pages.newest(s, ["session_id", "page_num"], "100 days"), "append")
    assert sum(map(len, kept)) == scan.count()
    counted = run(spark, tmp_path / "w", scan, pages.summaries, "update")
    assert counted and set(counted[0].columns) == {"window", "event", "n"}


def test_idle_pages_are_given_up(spark, tmp_path):
    """With event time the state of a page goes after its idle time: a page that comes back begins anew, and text keys pass."""
    rows = [("s", 1, 0), ("t", 1, 1), ("u", 1, 9000), ("u", 2, 9001), ("s", 1, 9002)]
    path = f"{tmp_path}/in"
    for k, (session, page, second) in enumerate(rows):
        frame = spark.createDataFrame([(session, page, f"{second:06d}", "page_start", False, 0, None)], "session_id string, page_num int, at string, event string, truncated boolean, warnings int, message string")
        frame.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + second))).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    schema = spark.read.parquet(f"{path}/0").schema
    for timed, attempts in ((None, 2), ("ts", 1)):
        kept = []
        for k in range(len(rows)):  # a file at a time, in their order
            spark.read.parquet(f"{path}/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/now-{timed}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/now-{timed}")
            made = pages.page_states(stream, timed, "1 second", 60_000)
            q = made.writeStream.outputMode("update").foreachBatch(lambda d, n, kept=kept: kept.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/cp-{timed}").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
        assert [r.attempts for r in kept if r.session_id == "s"][-1] == attempts
