"""Streaming queries over ``events`` and ``orders``, run until the files are read, against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normspark.plans.registry import Tables, query
from normspark.storage import shared_dir
from normspark.streaming import jobs as I  # noqa: E741
from normspark.streaming import lifecycle


def _folder(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"stream-{name}")


def _landed(rows: DataFrame, name: str, files: int = 4) -> str:
    """The rows as files of a folder that a stream can read."""
    path = _folder(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    return path


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def i1_incremental_feed(t: Tables) -> DataFrame:
    """The orders land twice over; the feed applies each key once."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    source, target = _landed(rows.unionByName(rows.where("o_orderkey % 3 = 0")), "feed"), _folder(t.spark, "target")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    I.feed(stream, "o_orderkey", target, _folder(t.spark, "state")).awaitTermination()
    return t.spark.read.parquet(target).select("o_orderkey", "o_orderstatus")


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT event_id, user_id FROM events")
def i2_deduplicated(t: Tables) -> DataFrame:
    rows = _events(t)
    source = _landed(rows.unionByName(rows), "twice", 6)  # an event and its repeat mostly land in different files
    out = I.drained(t.spark, source, rows.schema, lambda s: I.deduplicated(s, "event_id", "ts", "400 days"), "append", _folder(t.spark, "state"), _folder(t.spark, "out"), files=2)
    return out.select("event_id", "user_id")


_WINDOW = """
WITH w AS (SELECT event_type AS scope, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY ALL)
SELECT scope, strftime(s, '%Y-%m-%d %H:%M') AS window_start, n, n > CASE scope WHEN 'click' THEN 3 ELSE 5 END AS over_limit FROM w"""


def _budget(rows: DataFrame, watermark: str | None = None) -> DataFrame:
    out = I.budgets(rows, "ts", "event_type", {"click": 3}, 5, 3600, watermark)
    return out.select("scope", "window_start", "n", "over_limit")


@query(_WINDOW)
def i3_request_budget(t: Tables) -> DataFrame:
    return _budget(_events(t)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(_WINDOW)
def i3_request_budget_stream(t: Tables) -> DataFrame:
    """The same counts from a stream in update mode: the last emitted row of a window holds."""
    rows = _events(t)
    out = I.drained(t.spark, _landed(rows, "events", 3), rows.schema, _budget, "update", _folder(t.spark, "state"), _folder(t.spark, "out"))
    last = out.groupBy("scope", "window_start").agg(F.max_by(F.struct("n", "over_limit"), "batch").alias("x"))
    return last.select("scope", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "x.n", "x.over_limit")


@query("""
WITH b AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), a AS (SELECT max(ts) AS as_of FROM events)
SELECT user_id, (floor(epoch(as_of)) - floor(epoch(last)))::BIGINT AS age, CASE WHEN floor(epoch(as_of)) - floor(epoch(last)) > 86400 THEN 'stale' ELSE 'fresh' END AS health FROM b, a""")
def i4_heartbeats(t: Tables) -> DataFrame:
    rows = _events(t)
    as_of = rows.agg(F.max("ts").alias("as_of")).first()["as_of"]  # one value
    return I.heartbeats(rows, "user_id", "ts", F.lit(as_of), 86400).select("user_id", "age", "health")


_FOLD = "SELECT user_id, arg_max(event_type, (ts, event_id::VARCHAR)) AS status, count(*) AS events FROM events GROUP BY 1"


@query(_FOLD)
def i5_job_states(t: Tables) -> DataFrame:
    rows = _events(t).withColumn("event_id", F.col("event_id").cast("string"))
    return I.job_states(rows, "user_id", "event_id", "event_type", "ts").select("user_id", "status", "events")


#: Events of 90-day leases made of the lines of an order.
_LIFE = ("claimed", "claimed", "claimed", "claimed", "claimed", "failed", "queued", "failed", "succeeded", "cancelled", "unavailable", "started")


def _lives(t: Tables) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in _LIFE))
    kind = F.get(kinds, ((F.col("l_partkey") + F.col("l_linenumber")) % len(_LIFE)).cast("int"))
    return t.lineitem.select(F.col("l_orderkey").alias("job"), F.col("l_shipdate").alias("at"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), kind.alias("kind"))


_LIVES = """
WITH e AS (SELECT l_orderkey AS job, l_shipdate AS ts, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  ['claimed','claimed','claimed','claimed','claimed','failed','queued','failed','succeeded','cancelled','unavailable','started'][((l_partkey + l_linenumber) % 12)::INTEGER + 1] AS kind FROM lineitem),
n AS (SELECT *, sum((kind = 'claimed')::INTEGER) OVER (PARTITION BY job ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS n FROM e WHERE kind <> 'started'),
f AS (SELECT *, kind IN ('succeeded', 'cancelled', 'unavailable') OR (kind = 'failed' AND n >= 3) AS ends FROM n),
l AS (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY job ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM f),
r AS (SELECT * FROM l WHERE NOT past QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, id DESC) = 1),
s AS (SELECT job, n::BIGINT AS attempts,
  CASE WHEN kind = 'claimed' THEN 'running' WHEN kind = 'failed' AND NOT ends THEN 'queued' WHEN kind = 'unavailable' THEN 'failed' ELSE kind END AS status,
  CASE WHEN kind = 'failed' AND NOT ends THEN 'retry_wait' WHEN kind = 'unavailable' THEN 'failed' ELSE kind END AS stage,
  CASE WHEN kind = 'claimed' THEN epoch(ts)::BIGINT + 7776000 END AS lease_until,
  CASE WHEN kind = 'failed' AND NOT ends THEN epoch(ts)::BIGINT + least(3600, 15 * 2 ** greatest(n - 1, 0))::BIGINT END AS retry_at FROM r)
"""


@query(_LIVES + """SELECT *, (status = 'queued' OR coalesce(lease_until <= 883612800, false)) AND coalesce(retry_at, 0) <= 883612800 AS claimable FROM s""")
def i5_job_lifecycle(t: Tables) -> DataFrame:
    out = I.job_lifecycle(_lives(t), "job", "id", "kind", "at", F.timestamp_seconds(F.lit(883612800)), lease=7776000, give_up=3)
    return out.select("job", "status", "stage", "attempts", F.unix_seconds("lease_until").alias("lease_until"), F.unix_seconds("retry_at").alias("retry_at"), "claimable")


#: Days that an event may lie under way, and days from the last event to the end of the stream.
_LATE, _AFTER = 60, 30


@query(_LIVES + f""", o AS (SELECT epoch(max(l_shipdate))::BIGINT + {_AFTER} * 86400 AS as_of FROM lineitem)
SELECT s.*, (status = 'queued' OR coalesce(lease_until <= as_of, false)) AND coalesce(retry_at, 0) <= as_of AS claimable FROM s, o""")
def i5_job_lifecycle_stream(t: Tables) -> DataFrame:
    """The events arrive up to 60 days late and out of order in four batches; leases of 90 days end between and after them by timers alone."""
    rows = _lives(t).withColumn("at", F.col("at").cast("timestamp"))
    arrives = F.date_add(F.col("at").cast("date"), F.pmod(F.crc32("id"), F.lit(_LATE)).cast("int"))
    source = _folder(t.spark, "lives")
    last = rows.agg(F.max("at").alias("m")).first()["m"]  # one value
    edges = ["1000-01-01", "1994-01-01", "1996-01-01", "1997-06-01", "9999-01-01"]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows.where((arrives >= F.lit(low)) & (arrives < F.lit(high))).repartition(2).write.mode("append").parquet(source)
    # a row of no job moves the watermark to the end
    clock = F.lit(last) + F.make_interval(days=F.lit(_AFTER + _LATE + 1), secs=F.lit(1))
    t.spark.range(1).select(F.lit(None).cast("bigint").alias("job"), clock.alias("at"), F.lit("").alias("id"), F.lit("clock").alias("kind")).write.mode("append").parquet(source)
    with lifecycle.rocksdb(t.spark):
        build = lambda s: lifecycle.job_lifecycle_stream(s, "job", "id", "kind", "at", f"{_LATE + 1} days", lease=7776000, give_up=3)
        out = I.drained(t.spark, source, rows.schema, build, "update", _folder(t.spark, "state"), _folder(t.spark, "out"), files=2)
    seconds = lambda c: F.floor(F.col(c) / 1_000_000).cast("long").alias(c)
    x = out.select("job", "batch", F.struct("status", "stage", "attempts", seconds("lease_until"), seconds("retry_at"), "claimable").alias("x"))
    return x.groupBy("job").agg(F.max_by("x", "batch").alias("x")).select("job", "x.*")


@query(_FOLD)
def i5_job_states_stream(t: Tables) -> DataFrame:
    rows = _events(t)
    build = lambda s: I.job_states_stream(s, "user_id", "event_id", "event_type", "ts")
    out = I.drained(t.spark, _landed(rows, "jobs", 3), rows.schema, build, "update", _folder(t.spark, "state"), _folder(t.spark, "out"))
    return out.groupBy("user_id").agg(F.max_by("status", F.struct("events", "batch")).alias("status"), F.max("events").alias("events"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND NOT value > 50 ORDER BY ts, event_id LIMIT 100")
def i6_due_items(t: Tables) -> DataFrame:
    return I.due(_events(t), "ts", F.col("value") > 50, F.expr("timestamp '2024-01-20'"), "event_id", 100).select("event_id")


_DEPTH = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


@query(_DEPTH)
def i7_depth(t: Tables) -> DataFrame:
    return I.depth(t.events, "event_type")


@query(_DEPTH)
def i7_depth_stream(t: Tables) -> DataFrame:
    rows = _events(t)
    out = I.drained(t.spark, _landed(rows, "depth", 3), rows.schema, lambda s: I.depth(s, "event_type"), "update", _folder(t.spark, "state"), _folder(t.spark, "out"))
    return out.groupBy("event_type").agg(F.max("n").alias("n"))


_CUT = "2024-01-10"


@query(f"SELECT count(*) FILTER (ts < TIMESTAMP '{_CUT}') AS late, count(*) FILTER (ts >= TIMESTAMP '{_CUT}') AS in_time FROM events")
def i8_late_rows(t: Tables) -> DataFrame:
    return I.late_rows(_events(t), "ts", F.expr(f"timestamp '{_CUT}'"))


def _late_stream(t: Tables, progress: list | None = None) -> DataFrame:
    """Each day's last count. Events from the cut on land first and move the watermark past it; those before it come behind and are dropped."""
    rows = _events(t)
    source = _folder(t.spark, "late")
    late = F.col("ts") < F.expr(f"timestamp '{_CUT}'")
    rows.where(~late).repartition(1).write.parquet(source)
    span = rows.where(~late).agg(F.datediff(F.max("ts"), F.lit(_CUT)).alias("d")).first()["d"] or 0  # one number
    build = lambda s: I.daily(I.seen(s), "ts", f"{span} days")
    target, state = _folder(t.spark, "out"), _folder(t.spark, "state")
    I.drained(t.spark, source, rows.schema, build, "update", state, target, progress=progress)
    rows.where(late).repartition(2).write.mode("append").parquet(source)
    out = I.drained(t.spark, source, rows.schema, build, "update", state, target, progress=progress)
    return out.groupBy("day").agg(F.max_by("n", "batch").alias("n"))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE::VARCHAR AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY 1")
def i8_late_rows_stream(t: Tables) -> DataFrame:
    return _late_stream(t).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(f"SELECT count(*) FILTER (ts < TIMESTAMP '{_CUT}') AS late, count(*) FILTER (ts >= TIMESTAMP '{_CUT}') AS in_time FROM events")
def i8_counted_late_rows(t: Tables) -> DataFrame:
    """Dropped and counted events as the stream itself reports them."""
    progress: list = []
    return I.late_counts(progress, _late_stream(t, progress))
