"""The life of jobs as a stream: leases run out, retries come due and jobs close by event-time timers, without a further event.

The batch twin is ``jobs.job_lifecycle``. Events may arrive out of order within the watermark: they wait in a job's
state until the watermark has passed them and then fold by (time, id), so the stream says what the batch says of the
events up to the watermark. State is one entry a job and the events that wait.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from normspark.streaming.jobs import ENDS

#: In the order of their names, so that codes sort as kinds do.
KINDS = tuple(sorted(("queued", "claimed", "failed", *ENDS)))
_CLAIMED, _FAILED, _QUEUED = (KINDS.index(k) for k in ("claimed", "failed", "queued"))
_ENDS = frozenset(KINDS.index(k) for k in ENDS)
#: Of a bucket of jobs: last effective kind, attempts, end of lease or wait and whether that end was told, by job; then the events that wait. Times are microseconds.
STATE = "jobs array<string>, lasts array<int>, attempts array<int>, dues array<long>, told array<boolean>, ats array<long>, ids array<string>, kinds array<int>, owners array<string>"
_NEVER = -(2**63)


def _ended(life: list) -> bool:
    return life[0] in _ENDS or (life[0] == _FAILED and life[2] is None)


def _step(life: list, at: int, kind: int, lease: int, give_up: int, base: int = 15, most: int = 3600) -> None:
    """One more event of a job that has not ended."""
    attempts = life[1] + (kind == _CLAIMED)
    due = None
    if kind == _CLAIMED:
        due = at + lease * 1_000_000
    elif kind == _FAILED and attempts < give_up:
        due = at + min(most, int(base * 2 ** (max(attempts, 1) - 1))) * 1_000_000
    life[:] = [kind, attempts, due, due is None]


def _row(job: str | None, life: list, now: int) -> tuple:
    kind, attempts, due, _ = life
    over, waits = due is None or due <= now, kind == _FAILED and due is not None
    name = KINDS[kind]
    status = "queued" if waits else "running" if kind == _CLAIMED else "failed" if name == "unavailable" else name
    stage = "retry_wait" if waits else "failed" if name == "unavailable" else name
    return (job, status, stage, attempts, due if kind == _CLAIMED else None, due if waits else None, over and (waits or kind in (_CLAIMED, _QUEUED)), now)


def job_lifecycle_stream(events: DataFrame, job: str, event: str, kind: str, at: str, delay: str, lease: int = 300, give_up: int = 5, buckets: int = 1024) -> DataFrame:
    """A row for a job whenever its folded state changes or its lease or waiting time ends; times are microseconds, ``as_of`` is the watermark.

    Jobs share state by ``buckets`` of a hash: asking for state and timers job by job took milliseconds for each one. A bucket has one
    timer, for what comes first in it: a waiting event, the end of a lease or of a wait. A task holds one bucket's jobs at a time,
    and a checkpoint belongs to the number of buckets that it began with.
    """
    names = [job, "status", "stage", "attempts", "lease_until", "retry_at", "claimable", "as_of"]

    def live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        jobs, lasts, attempts, dues, told, *late = state.get if state.exists else [()] * 9
        lives = {j: list(x) for j, *x in zip(jobs, lasts, attempts, dues, told, strict=True)}
        waiting = list(zip(*late, strict=True))
        if not state.hasTimedOut:
            for pdf in batches:
                rows = zip(*(pdf[c].tolist() for c in ("__at", "__id", "__kind", "__job")), strict=True)
                waiting += [r for r in rows if r[2] >= 0 and r[0] != _NEVER]
        if not waiting and not lives:
            return
        waiting.sort(key=lambda e: e[:3])
        ready = bisect_right(waiting, now, key=lambda e: e[0])
        changed = {}
        for t, _, k, j in waiting[:ready]:
            life = lives.setdefault(j, [-1, 0, None, True])
            if not _ended(life):
                _step(life, t, k, lease, give_up)
            changed[j] = life
        timers = [e[0] for e in waiting[ready : ready + 1]]
        first = None
        for j, life in lives.items():
            if not life[3]:
                if life[2] <= now:
                    life[3] = True
                    changed[j] = life
                elif first is None or life[2] < first:
                    first = life[2]
        columns = [list(c) for c in zip(*waiting[ready:], strict=True)] or [[], [], [], []]
        state.update((list(lives), *([x[i] for x in lives.values()] for i in range(4)), *columns))
        if first is not None:
            timers.append(first)
        if timers:
            # a bucket times out when the watermark is past this, an event is ready when the watermark is at its time
            state.setTimeoutTimestamp(max(1, -(-min(timers) // 1000) - 1))
        if changed:
            out = zip(*(_row(j, life, now) for j, life in changed.items()), strict=True)
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, out, strict=True)})

    code = F.coalesce(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col(kind)), F.lit(0)) - 1
    rows = events.withWatermark(at, delay).select(
        F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int").alias("__bucket"), F.col(job).cast("string").alias("__job"), F.col(at),
        F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(_NEVER)).alias("__at"), F.coalesce(F.col(event).cast("string"), F.lit("")).alias("__id"), code.cast("int").alias("__kind"),
    )
    named = f"`{job}` string, status string, stage string, attempts long, lease_until long, retry_at long, claimable boolean, as_of long"
    out = rows.groupBy("__bucket").applyInPandasWithState(live, named, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(job, F.col(job).cast(events.schema[job].dataType))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, so that it need not fit an executor's memory; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
