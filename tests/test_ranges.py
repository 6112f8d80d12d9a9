"""Order within groups over several ranges, against plain loops; chunks are made small so that states pass many of them."""

import random

import pytest
from pyspark.sql import functions as F

from normspark.operators import ranges
from normspark.operators.catalog import order_breaks
from normspark.operators.reports import cumulative_bins


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables keep their ranges; otherwise they would be put together into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "b", "b", "b", "b"]), i, rng.choice([None, 0, 1, 2, 5, 9, 30, 500])) for i in range(n)]


def by_group(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize(("max_rows", "chunk", "fan"), [(1, 1, 2), (3, 3, 2), (7, 10, 3), (50, 60, 256), (500, 20_000, 256)])
def test_greedy(spark, max_rows, chunk, fan):
    data = rows(240)
    want = []
    for g in by_group(data).values():
        batch = n = total = 0
        for r in g:
            s = r[2] or 0
            if n and (n >= max_rows or total + s > 40):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            want.append((*r, batch))
    df = spark.createDataFrame(data, "g string, k int, s int").withColumn("extra", F.lit("x"))
    got = ranges.greedy(df, "g", ["k"], "s", max_rows, 40, chunk, fan)
    assert got.columns == ["g", "k", "s", "extra", "batch"]
    assert sorted((tuple(r) for r in got.drop("extra").collect()), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_greedy_of_nothing(spark):
    assert ranges.greedy(spark.createDataFrame([], "g int, k int, s int"), "g", ["k"], "s", 5, 10).collect() == []
    with pytest.raises(ValueError):
        ranges.greedy(spark.createDataFrame([], "g int, k int, s int"), "g", ["k"], "s", 0, 10)


def test_breaks_and_bins_of_one_hot_group(spark):
    data = [(g, k, s) for g, k, s in rows(300, 2)]
    df = spark.createDataFrame(data, "g string, k int, s int")
    want = set()
    for g in by_group(data).values():
        want |= {(b[1], a[2]) for a, b in zip(g, g[1:], strict=False) if a[2] is not None and b[2] is not None and a[2] >= b[2]}
    assert {(r.k, r.previous) for r in order_breaks(df, "g", ["k"], "s").collect()} == want
    want = {}
    for g in by_group(data).values():
        before = 0
        for r in g:
            if r[2] is not None:
                want[r[1]] = before // 100
                before += r[2]
    assert {r.k: r.bin for r in cumulative_bins(df.where("s is not null"), "g", ["k"], "s", 100).collect()} == want
    parts = ranges.ranged(df.repartition(4), "g", ["k"])
    assert parts.where("g = 'b'").select(ranges.PART).distinct().count() > 1  # the hot group is in several ranges
