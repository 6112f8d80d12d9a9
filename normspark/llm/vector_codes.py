"""Vector code compression: product codes learned by Lloyd rounds whose members stay where they are.

Components become integers, ``floor(SCALE * x)``; a vector is cut into ``PARTS`` equal parts and each part position
has a codebook of at most ``ENTRIES`` entries. After the first assignment every part moves once to the *owner* of
its (position, entry, salt); the salts split each entry, so that the copies of one frequent vector have many owners.
A round then updates each entry from partial sums that the owners make of their resident members, judges
the residents where they are against the new codebooks, and sends on only the parts whose entry has changed.
Codebooks (``ENTRIES`` integer vectors, whatever the input) travel with the tasks. The final codes are one narrow pass
over the vectors: no update follows, so no part needs to move for them.

All arithmetic is exact: distances, sums and floors are integers.

Defined results: a vector that is null, empty, or holds a null or non-finite component is dropped, and so is one whose
length differs from that of the smallest vec_id's vector or is no multiple of ``PARTS``, or with a component so large
(``magnitude``) that a squared distance would not fit 64 bits. Codebooks start from distinct ids: rows that repeat a vec_id start one entry
(of the smallest vector, if they differ), null ids start none but are coded; with fewer than ``ENTRIES`` ids the codebooks are smaller, and without
any the result is empty. Ties in distance go to the lower index. An error sum of a label beyond 64 bits is null. Repeated rows repeat
their result; an empty table gives an empty result; columns of any name may come along, they are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts of one position that an owner holds on average at most, and owners of an entry at least.
OWNED, SALTS = 50_000, 16
#: Numbers of one distance table in a task.
CELLS = 2_000_000

RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def magnitude(dim: int) -> int:
    """The largest component, as an integer, with which squared distances of ``dim`` components fit 64 bits."""
    return math.isqrt((2**63 - 1) // dim) // 2


def usable(rows: DataFrame, vector: str, parts: int = PARTS) -> DataFrame:
    """Rows whose ``vector`` has a length that can be cut and only finite components of measurable size."""
    v = F.col(vector).cast("array<double>")
    most = F.lit(float(2**63 - 1))
    bound = F.floor(F.sqrt(most / F.size(v)) / 2) / SCALE - 1
    return rows.where((F.size(v) > 0) & (F.size(v) % parts == 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= bound)))


def first_ids(kept: DataFrame, n: int) -> list[int]:
    """The ``n`` smallest distinct ids: a top-n per pass; repeated ids cost more passes, never a shuffle."""
    ids: list[int] = []
    while len(ids) < n:
        rest = kept.where(F.col("vec_id") > ids[-1]) if ids else kept.where(F.col("vec_id").isNotNull())
        more = {r[0] for r in rest.select("vec_id").orderBy("vec_id").limit(n).collect()}
        if not more:
            break
        ids = sorted({*ids, *more})[:n]
    return ids


def whole(vectors: pa.Array, dim: int, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, components) integers of an Arrow column of lists."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, parts, dim // parts)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance: ``x`` (rows, positions, components), ``books`` (positions, entries, components)."""
    entry, error = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    step = max(1, CELLS // (books.shape[0] * books.shape[1]))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        distance = np.zeros((*part.shape[:2], books.shape[1]), np.int64)
        for j in range(x.shape[2]):
            distance += (part[:, :, None, j] - books[None, :, :, j]) ** 2
        entry[i : i + step] = distance.argmin(2)
        error[i : i + step] = distance.min(2)
    return entry, error


def _nested(x: np.ndarray) -> pa.Array:
    """Rows of integers as an Arrow list column."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


MEMBER = "position int, entry int, salt int, x array<long>"


def _members(kept: DataFrame, books: np.ndarray, dim: int, salts: int) -> DataFrame:
    """Every part of every vector with its first entry; salts take turns within a task."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for start in range(0, len(batch), 4096):
                x = whole(batch.column(0).slice(start, 4096), dim, parts)
                entry = nearest(x, books)[0]
                n = len(x)
                position = np.tile(np.arange(parts, dtype=np.int32), n)
                salt = np.repeat((np.arange(n) + turn) % salts, parts).astype(np.int32)
                turn = (turn + n) % salts
                yield pa.RecordBatch.from_arrays([pa.array(position), pa.array(entry.ravel().astype(np.int32)), pa.array(salt), _nested(x.reshape(n * parts, -1))], names=["position", "entry", "salt", "x"])

    return kept.select("embedding").mapInArrow(run, MEMBER)


def _judged(resident: DataFrame, books: np.ndarray) -> DataFrame:
    """Residents with the entry ``to`` that is nearest now; nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(0).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(len(batch), books.shape[2])
            to = np.empty(len(batch), np.int32)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                to[at] = nearest(x[at][:, None], books[p : p + 1])[0][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=[*batch.schema.names, "to"])

    return resident.mapInArrow(run, f"{MEMBER}, to int")


def _updated(resident: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of its members; at most one partial sum per owner is shuffled."""
    width = books.shape[2]
    sums = resident.groupBy("position", "entry").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)))
    new = books.copy()
    for r in sums.collect():  # at most one row an entry
        new[r["position"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return new


def lloyd(kept: DataFrame, books: np.ndarray, dim: int, rounds: int = ROUNDS, owned: int = OWNED, salts: int = SALTS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds of assignment and update."""
    if not rounds:
        return books
    n = kept.count()
    salts = max(salts, -(-n // owned))
    owner = ["position", "entry", "salt"]
    shuffles = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resident = stored(_members(kept, books, dim, salts).repartition(shuffles, *owner), "resident")
    books = _updated(resident, books)
    for _ in range(rounds - 1):
        judged = stored(_judged(resident, books), "judged")
        stay = judged.where("to = entry").select(*owner, "x")
        moved = judged.where("to <> entry").select("position", F.col("to").alias("entry"), "salt", "x").repartition(shuffles, *owner)
        resident = stay.unionByName(stored(moved, "moved"))
        books = _updated(resident, books)
    return books


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """The rows that can be coded and the final codebooks (positions, entries, components); None if no id can start one."""
    kept = usable(rows, "embedding", parts)
    ids = first_ids(kept, 1)
    if not ids:
        return kept, None
    dim = min(len(r[0]) for r in kept.where(F.col("vec_id") == ids[0]).select("embedding").distinct().limit(1000).collect())
    kept = kept.where(F.size("embedding") == dim)
    ids = first_ids(kept, entries)
    seeds = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    start = whole(pa.array([r["embedding"] for r in seeds], pa.list_(pa.float64())), dim, parts)
    return kept, lloyd(kept, start.transpose(1, 0, 2).copy(), dim, rounds)


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: the nearest entries of all parts, in one narrow pass."""
    parts, dim = books.shape[0], books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for start in range(0, len(batch), 4096):
                entry, error = nearest(whole(batch.column(2).slice(start, 4096), dim, parts), books)
                text = np.ascontiguousarray(entry.astype(np.uint8)).tobytes().hex()
                codes.append(pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()))
                errors.append(error.sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.concat_arrays(codes), pa.array(np.concatenate(errors))], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' components by part, entry and place, in decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(rows: DataFrame) -> DataFrame:
    """The columns of query ``op11_vector_codes``."""
    kept, books = learn(rows)
    if books is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    codes = stored(coded(kept, books), "codes")
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    sums = small_side(stored(sums, "label-sums"), 200_000)  # a label and a number each
    found = codes.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left")
    return found.select("vec_id", "code", "error", F.expr("try_cast(__sum AS bigint)").alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``digest`` where no id repeats."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
dist{r} AS (SELECT rid, m.pos, b.entry, sum((m.v - b.v) * (m.v - b.v))::BIGINT AS d FROM comp m JOIN book{r} b ON m.pos = b.pos AND m.j = b.j GROUP BY ALL),
near{r} AS (SELECT rid, pos, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM dist{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (SELECT pos, entry, j, floor(sum(v) / count(*))::BIGINT AS v FROM near{r} JOIN comp USING (rid, pos) GROUP BY ALL),
book{r + 1} AS (SELECT b.pos, b.entry, b.j, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (pos, entry, j))""")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT rid, vec_id, len(embedding) // {parts} AS w, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM kept),
comp AS (SELECT rid, vec_id, i // w AS pos, i % w AS j, floor({SCALE}::DOUBLE * x)::BIGINT AS v FROM flat),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS (SELECT pos, entry, j, v FROM comp JOIN first USING (rid)),{','.join(steps)},
code AS (SELECT rid, string_agg(format('{{:02x}}', entry::INTEGER), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY pos, entry, j)) FROM book{rounds}) AS codebooks_sha256
FROM code JOIN kept USING (rid)"""
