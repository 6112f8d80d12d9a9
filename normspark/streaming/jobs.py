"""Structured Streaming forms of catalog feeds, budgets, heartbeats and job states, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from normspark.functions import scalars as S


def feed(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append rows with unseen keys to the table at ``target``. A replayed batch changes nothing.

    Seen keys are the stream's state for ever, as a catalog's key may come again at any time; ``deduplicated`` is the form with a horizon.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # a batch overwrites its own partition, so writing it again is harmless
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__batch").parquet(target)

    return stream.dropDuplicates([key]).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """A redelivered event within the watermark has no second effect."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def budgets(events: DataFrame, at: str, scope: str, limits: dict[str, int], default: int, seconds: int = 60, watermark: str | None = None) -> DataFrame:
    """Requests per scope and fixed window, whether they exceed the scope's limit. Works on streams and tables."""
    rows = events.withWatermark(at, watermark) if watermark else events
    counts = rows.groupBy(F.window(at, f"{seconds} seconds").alias("w"), F.col(scope).alias("scope")).agg(F.count("*").alias("n"))
    limit = F.lit(default)
    for name, most in limits.items():
        limit = F.when(F.col("scope") == name, most).otherwise(limit)
    return counts.select("scope", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", (F.col("n") > limit).alias("over_limit"))


def seconds_left(at: Column, seconds: int = 60) -> Column:
    return F.lit(seconds) - F.unix_seconds(at) % seconds


def heartbeats(beats: DataFrame, consumer: str, at: str, as_of: Column, limit: int = 90) -> DataFrame:
    last = beats.groupBy(consumer).agg(F.max(at).alias("last_beat"))
    age = F.unix_seconds(as_of) - F.unix_seconds("last_beat")
    return last.select(consumer, "last_beat", age.alias("age"), F.when(F.col("last_beat").isNull(), "unavailable").when(age > limit, "stale").otherwise("fresh").alias("health"))


def job_states(events: DataFrame, job: str, event: str, status: str, at: str) -> DataFrame:
    """Batch fold: the status of the latest event (ties by event id), attempts and the time."""
    last = F.max(F.struct(F.col(at).alias("at"), F.col(event).alias("id"), F.col(status).alias("status")))
    out = events.groupBy(job).agg(last.alias("l"), F.count("*").alias("events"))
    return out.select(job, F.col("l.status").alias("status"), F.col("l.at").alias("at"), "events")


STATE = "at long, id string, status string, n long"


def job_states_stream(events: DataFrame, job: str, event: str, status: str, at: str) -> DataFrame:
    """The same fold as a stateful stream: events may arrive out of order, state is one row a job."""
    kind = events.schema[job].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        when, name, now, n = state.get if state.exists else (-(2**62), "", "", 0)
        for pdf in batches:
            for t, i, s in zip(pdf["__at"], pdf["__id"], pdf["__status"], strict=True):
                n += 1
                if (t, i) > (when, name):
                    when, name, now = int(t), i, s
        state.update((when, name, now, n))
        yield pd.DataFrame({job: [key[0]], "status": [now], "at_us": [when], "events": [n]})

    rows = events.select(job, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), F.col(event).cast("string").alias("__id"), F.col(status).alias("__status"))
    return rows.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, status string, at_us long, events long", STATE, "update", "NoTimeout")


#: Kinds of events that end a job at once; ``failed`` ends it only when its attempts are used up.
ENDS = ("succeeded", "cancelled", "unavailable")


def job_lifecycle(events: DataFrame, job: str, event: str, kind: str, at: str, as_of: Column, lease: int = 300, give_up: int = 5) -> DataFrame:
    """Status, stage, attempts, lease and retry time of every job at ``as_of``.

    Kinds are queued, claimed, failed, unavailable (a source that has no text: no retry), succeeded, cancelled.
    Events fold by time, ties by event id. A claim is an attempt and holds the job for ``lease`` seconds; a
    failure waits for its retry until ``give_up`` attempts are used. What comes after a terminal event has no
    effect. A job of unknown kinds alone, or of null times, has no row; a repeated event counts again.
    """
    known = events.where(F.col(kind).isin("queued", "claimed", "failed", *ENDS) & F.col(at).isNotNull())
    rows = known.select(job, F.col(at).cast("timestamp").alias("__at"), F.col(event).alias("__id"), F.col(kind).alias("__kind"))
    # running counts stream through the sort of a job; the last row before the end comes from an aggregate
    so_far = Window.partitionBy(job).orderBy("__at", "__id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.count_if(F.col("__kind") == "claimed").over(so_far))
    ends = F.col("__kind").isin(*ENDS) | ((F.col("__kind") == "failed") & (F.col("__n") >= give_up))
    rows = rows.withColumn("__ends", ends).withColumn("__ended", F.count_if("__ends").over(so_far))
    effective = rows.where((F.col("__ended") == 0) | (F.col("__ends") & (F.col("__ended") == 1)))
    last = effective.groupBy(job).agg(F.max(F.struct("__at", "__id", "__n", "__ends", "__kind")).alias("l"))
    what, ended, n, when = (F.col(f"l.{c}") for c in ("__kind", "__ends", "__n", "__at"))
    later = lambda seconds: F.timestamp_seconds(F.unix_seconds(when) + seconds)
    waits = (what == "failed") & ~ended
    state = last.select(
        job,
        F.when((what == "queued") | waits, "queued").when(what == "claimed", "running").when(what.isin("failed", "unavailable"), "failed").otherwise(what).alias("status"),
        F.when(waits, "retry_wait").when(what == "unavailable", "failed").otherwise(what).alias("stage"),
        n.alias("attempts"),
        F.when(what == "claimed", later(F.lit(lease))).alias("lease_until"),
        F.when(waits, later(S.retry_delay(F.greatest(n, F.lit(1)), give_up=give_up))).alias("retry_at"),
    )
    free = (F.col("status") == "queued") | F.coalesce(F.col("lease_until") <= as_of, F.lit(False))
    return state.withColumn("claimable", free & (F.coalesce("retry_at", as_of) <= as_of))


def due(items: DataFrame, available: str, dispatched: Column, as_of: Column, tie: str, n: int) -> DataFrame:
    return items.where((F.col(available) <= as_of) & ~dispatched).orderBy(available, tie).limit(n)


def depth(events: DataFrame, status: str) -> DataFrame:
    return events.groupBy(status).agg(F.count("*").alias("n"))


def late_rows(batch: DataFrame, at: str, watermark: Column) -> DataFrame:
    """Rows behind a watermark and rows in time, counted."""
    return batch.agg(F.count_if(F.col(at) < watermark).alias("late"), F.count_if(F.col(at) >= watermark).alias("in_time"))


def daily(events: DataFrame, at: str, watermark: str) -> DataFrame:
    """Events by day; days that the watermark has passed take no more rows."""
    return events.withWatermark(at, watermark).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def seen(stream: DataFrame) -> DataFrame:
    """``stream`` whose batches report how many rows they read, before any watermark takes some."""
    return stream.observe("seen", F.count("*").alias("n"))


def late_counts(progress: list, in_time: DataFrame, n: str = "n") -> DataFrame:
    """Rows that a stream with ``seen`` read but that are in no window of its result: those that came behind the watermark.

    ``in_time`` holds each window's last count. The numbers of dropped rows in the progress itself are of partial
    aggregates, not of events. Sums a few numbers a batch; streams of over a hundred batches need
    ``spark.sql.streaming.numRecentProgressUpdates`` raised to keep them all.
    """
    read = sum(p.observedMetrics["seen"]["n"] for p in progress if "seen" in p.observedMetrics)
    return in_time.agg(F.coalesce(F.sum(n), F.lit(0)).alias("in_time")).select((F.lit(read) - F.col("in_time")).alias("late"), "in_time")


def drained(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], mode: str, checkpoint: str, target: str, files: int | None = None, progress: list | None = None) -> DataFrame:
    """Run ``build`` over the files at ``path`` as a stream until all are read, ``files`` of them a batch; every emitted row is in the result table.

    ``progress`` gets the progress of the run's batches.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    out = build(stream)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    query = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, batch long").parquet(target)
