import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from normspark.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def rows_of(seed=1, n=150, dim=32):
    rnd = random.Random(seed)
    rows = [(i * 3, [round(rnd.gauss(0, 0.2), 3) for _ in range(dim)], rnd.choice([0, 1, 2, None])) for i in range(n)]
    same = [0.25] * dim
    return rows + [(1000 + i, same, 7) for i in range(80)]


def brute(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        to = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), t in zip(kept, to, strict=True) if t[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, by = [], {}
    for i, v, label in kept:
        got = [near(v, p) for p in range(parts)]
        err = sum(d for d, _ in got)
        by[label] = by.get(label, 0) + err
        out.append((i, "".join(f"{k:02x}" for _, k in got), err, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=str)


def result(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = rows_of()
    assert result(V.digest(spark.createDataFrame(rows, KIND).repartition(7))) == brute(rows)


def test_nulls_repeats_and_ties(spark):
    rows = rows_of(2, 40, 16)
    rows += [rows[0], rows[0], (3, [0.5] * 16, 1), (None, [0.1] * 16, None), (None, [0.1] * 16, 1)]
    bad = [(7, None, 1), (8, [0.1] * 15 + [None], 1), (-5, [float("nan")] * 16, 1), (-6, [0.0] * 15 + [float("-inf")], 1)]
    assert result(V.digest(spark.createDataFrame(rows + bad, KIND))) == brute(rows)


def test_other_lengths_and_sizes_are_dropped(spark):
    rows = rows_of(3, 30, 16)
    odd = [(5000, [0.1] * 32, 1), (5001, [0.1] * 17, 1), (5002, [], 1), (5003, [3e38] * 16, 1)]
    assert result(V.digest(spark.createDataFrame(rows + odd, KIND))) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i, [float(((i * 37 + j * 11) % 97 - 48) * 8192) for j in range(16)], 0) for i in range(90)]
    assert result(V.digest(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], KIND)
    assert V.digest(empty).collect() == [] and V.digest(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert V.digest(spark.createDataFrame([(None, [0.5] * 16, 1)], KIND)).collect() == []
    rows = rows_of(4, 20, 16)
    more = spark.createDataFrame(rows, KIND).select("*", *(F.lit(1).alias(c) for c in ("code", "error", "entry", "salt", "x", "position", "__label")))
    assert result(V.digest(more)) == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_rounds_and_owners(spark, rounds):
    """Other numbers of rounds, with owners of three members each."""
    rows = rows_of(5, 60, 16)
    kept, start = V.learn(spark.createDataFrame(rows, KIND), rounds=0)
    got = V.lloyd(kept, start, 16, rounds, owned=3, salts=1)
    assert V.books_sha256(got) == brute(rows, rounds=rounds)[0][4]


def test_only_changed_parts_move(spark):
    """Against the codebooks that made the first assignment every part stays; against others those that change have another entry."""
    rows = rows_of(6, 100, 16)
    kept, books = V.learn(spark.createDataFrame(rows, KIND), rounds=0)
    members = V._members(kept, books, 16, 4)
    assert V._judged(members, books).where("to <> entry").count() == 0
    moved = V._judged(members, V._updated(members, books)).where("to <> entry").count()
    assert 0 < moved < members.count()
