from datetime import datetime, timedelta

from pyspark.sql import functions as F

from normspark.streaming import jobs, lifecycle

START = datetime(2024, 1, 1)


def states(spark, events, minutes=1000):
    rows = [(job, e, START + timedelta(minutes=m) if m is not None else None, kind) for job, e, m, kind in events]
    df = spark.createDataFrame(rows, "job string, event string, at timestamp, kind string")
    out = jobs.job_lifecycle(df, "job", "event", "kind", "at", F.lit(START + timedelta(minutes=minutes)))
    return {r.job: (r.status, r.stage, r.attempts, r.claimable) for r in out.collect()}


def test_rules(spark):
    tries = lambda job, n: [(job, f"{i:02}{k}", 10 * i, k) for i in range(n) for k in ("claimed", "failed")]
    events = [
        ("new", "1", 0, "queued"),
        ("late", "2", 9, "succeeded"), ("late", "1", 1, "claimed"), ("late", "3", 20, "claimed"),
        ("dead", "1", 1, "claimed"), ("dead", "2", 2, "unavailable"), ("dead", "3", 3, "queued"),
        ("held", "1", 998, "claimed"), ("lost", "1", 990, "claimed"), ("soon", "1", 1000, "claimed"), ("soon", "2", 1000, "failed"),
        ("odd", "1", 1, "other"), ("odd", "2", None, "queued"),
        *tries("four", 4), *tries("five", 5), *tries("six", 6),
    ]
    assert states(spark, events) == {
        "new": ("queued", "queued", 0, True), "late": ("succeeded", "succeeded", 1, False), "dead": ("failed", "failed", 1, False),
        "held": ("running", "claimed", 1, False), "lost": ("running", "claimed", 1, True), "soon": ("queued", "retry_wait", 1, False),
        "four": ("queued", "retry_wait", 4, True), "five": ("failed", "failed", 5, False), "six": ("failed", "failed", 5, False),
    }
    assert states(spark, []) == {}


def streamed(spark, tmp_path, *batches):
    """Rows that the stream emits, batch by batch; a batch lists (job, event, minute, kind)."""
    kind = "job string, event string, at timestamp, kind string"
    for i, events in enumerate(batches):
        rows = [(j, e, START + timedelta(minutes=m), k) for j, e, m, k in events]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with lifecycle.rocksdb(spark):
            build = lambda s: lifecycle.job_lifecycle_stream(s, "job", "event", "kind", "at", "10 minutes")
            out = jobs.drained(spark, f"{tmp_path}/in", kind, build, "update", f"{tmp_path}/state", f"{tmp_path}/out")
        yield sorted((r.job, r.status, r.stage, r.attempts, r.claimable) for r in out.where(f"batch > {getattr(streamed, 'last', -1)}").distinct().collect())
        streamed.last = out.agg(F.max("batch")).first()[0] or -1


def test_timers_without_further_events(spark, tmp_path):
    """A lease of five minutes and a wait of fifteen seconds end while only another job's events arrive."""
    streamed.last = -1
    clock = lambda m: ("clock", str(m), m, "queued")
    got = list(streamed(
        spark, tmp_path,
        [("held", "2", 3, "claimed"), ("held", "1", 1, "queued"), ("fails", "1", 1, "claimed"), ("fails", "2", 2, "failed"), ("done", "1", 1, "claimed"), ("done", "2", 2, "succeeded"), clock(14)],
        [clock(19)], [("done", "3", 18, "claimed"), ("done", "0", 1, "claimed"), clock(40)],
    ))
    first, second, third = ([x for x in g if x[0] != "clock"] for g in got)
    # the watermark stands at minute 4: the lease is held, the wait of 15 seconds after minute 2 is over
    assert first == [("done", "succeeded", "succeeded", 1, False), ("fails", "queued", "retry_wait", 1, True), ("held", "running", "claimed", 1, False)]
    assert second == [("held", "running", "claimed", 1, True)]
    # a closed job takes no more events, and one behind the watermark has no effect
    assert third == [("done", "succeeded", "succeeded", 1, False)]


def test_stream_keeps_jobs_in_buckets(spark):
    """One state and timer a job took milliseconds each (150,000 jobs did not end in five minutes): the stream groups by bucket, and any number of buckets gives the same rows."""
    source = spark.readStream.format("rate").load().selectExpr("value as job", "cast(value as string) as event", "timestamp as at", "'queued' as kind")
    out = lifecycle.job_lifecycle_stream(source, "job", "event", "kind", "at", "1 minute")
    assert out.schema["job"].dataType.simpleString() == "bigint"
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "__bucket" in plan


def test_stream_as_batch(spark, tmp_path):
    """Large job ids, a null time, a null job and unknown kinds; few buckets, so that many jobs share one."""
    big = 2**60
    kinds = ("claimed", "failed", "queued", "claimed", "failed", "other", "claimed", "succeeded")
    events = [(big + j, f"{j}-{i}", START + timedelta(minutes=7 * i + j % 5), kinds[(i * (j + 1)) % len(kinds)]) for j in range(40) for i in range(6)]
    events += [(big, "n", None, "succeeded"), (None, "x", START, "claimed"), (big + 99, "u", START, "other")]
    df = spark.createDataFrame(events, "job long, event string, at timestamp, kind string")
    for part, clock in ((0, 0), (1, 5000)):
        rows = df.where(F.pmod(F.crc32(F.col("event")), F.lit(2)) == part)
        tick = spark.createDataFrame([(None, "c", START + timedelta(minutes=clock), "clock")], df.schema)
        rows.unionByName(tick).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with lifecycle.rocksdb(spark):
        build = lambda s: lifecycle.job_lifecycle_stream(s, "job", "event", "kind", "at", "100 minutes", give_up=2, buckets=3)
        out = jobs.drained(spark, f"{tmp_path}/in", df.schema, build, "update", f"{tmp_path}/state", f"{tmp_path}/out", files=1)
    cols = ("status", "stage", "attempts", "lease_until", "retry_at", "claimable")
    last = out.groupBy("job").agg(F.max_by(F.struct(*cols), "batch").alias("x")).select("job", "x.*")
    want = jobs.job_lifecycle(df, "job", "event", "kind", "at", F.lit(START + timedelta(minutes=4900)), give_up=2)
    want = want.select("job", "status", "stage", "attempts", F.unix_micros("lease_until").alias("lease_until"), F.unix_micros("retry_at").alias("retry_at"), "claimable")
    key = lambda r: (r.job is None, r.job)
    assert sorted(map(tuple, sorted(last.collect(), key=key)), key=str) == sorted(map(tuple, sorted(want.collect(), key=key)), key=str)
