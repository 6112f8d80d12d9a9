"""Phrase collocation mining per language: Misra-Gries summaries find every frequent n-gram, a last pass counts exactly.

Texts are lower-cased (A-Z only) and cut into pieces at punctuation and line ends, pieces into words at blanks. An n-gram
is a hash of its words and the language; hashes are dealt to hash partitions by their leading bits. A
map task merges the n-grams of its texts into summaries without loss (sorted hashes with counts, one row per hash
partition). For each hash partition the summaries are then merged to at most ``mass // threshold + 1`` counters, the
mass being the partition's number of occurrences. Such a Misra-Gries summary cuts off less than ``threshold`` in all, so
what reaches the threshold survives; what even with the cut stays below it is left out. Survivors become a
bitmap of bounded size. First words and pairs are summarised, then the n-grams of three and four words all of whose
pairs survive. The last pass counts by text what the bitmap lets through; equal hashes of unequal words or a full bitmap
cost counting of some rare n-grams, never a result. Scores, absorption by longer phrases and ranks are joins of exact counts.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count as often as they occur; ties
in score go by count, then by phrase in UTF-8 byte order; texts of any length are read whole, in blocks cut
between pieces (one piece stands alone, however long); an empty table gives an empty result; columns of any name may come along, they are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, release, scratch, small_batches, small_side, stored

WORDS, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that contains it has this share of its count, in hundredths.
ABSORBED = 80
SCORE = 2_000_000
#: Parts in which a language's phrases are ranked before they meet.
SALTS = 32
#: Counters of one hash partition at most, as planned from the size of the texts.
COUNTERS = 1 << 18
#: Bits of a bitmap of survivors at most, as a power of two (32 MB).
BITS = 28
#: Leading bits of a hash that summaries keep (whole bytes): n-grams that share them are counted as one there, which can only keep more.
KEY = 48
#: Bytes of text handled at once, and n-grams that a map task holds before it hands on summaries.
BLOCK, HELD = 1_500_000, 600_000

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


_BASE = 0x9E3779B97F4A7C15
_power: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse modulo 2**64."""
    if len(_power[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _power[i] = np.multiply.accumulate(x)
    return _power


class Block:
    """Words of some texts as byte ranges, with the ``piece`` and the language's number of each."""

    def __init__(self, texts: list[bytes], langs: list[int]):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind = _KIND[data]
        self.letter = kind == 0
        turn = np.flatnonzero(self.letter[1:] != self.letter[:-1]) + 1
        if len(data) and self.letter[0]:
            turn = np.concatenate(([0], turn))
        self.data, self.start, self.end = _LOWER[data], turn[::2], turn[1::2]  # the data end in a separator
        first = np.zeros(len(self.start) + 1, bool)
        first[np.searchsorted(self.start, np.flatnonzero(kind == 2))] = True
        self.piece = np.cumsum(first[:-1])
        edges = np.searchsorted(self.start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.lang = np.repeat(np.array(langs, np.int64), np.diff(edges))

    def hashes(self, seeds: np.ndarray) -> np.ndarray:
        """A hash of each word with its language, whose seed is ``seeds[lang]``: differences of one running sum over the bytes."""
        power, inverse = _powers(len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * power[: len(self.data)], out=run[1:])
        return mix64((run[self.end] - run[self.start]) * inverse[self.start] + seeds[self.lang])

    def words(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word and the distinct words by number."""
        offsets = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.letter])])
        coded = column.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())

    def grams(self, hashes: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: hashes of so many words from each word on, and which of them lie within a piece."""
        out, size = [(hashes, np.ones(len(hashes), bool))], len(hashes)
        total = hashes * _ODD[0]
        for n in range(1, most):
            size = max(0, size - 1)
            total = total[:size] + hashes[n : n + size] * _ODD[n]
            out.append((total, self.piece[:size] == self.piece[n : n + size]))
        return out


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``BLOCK`` bytes that end behind a piece."""
    start = 0
    while len(text) - start > BLOCK:
        look = np.frombuffer(text, np.uint8, offset=start + BLOCK)
        stop = next((start + BLOCK + i + int(at[0]) for i in range(0, len(look), BLOCK) if len(at := np.flatnonzero(_KIND[look[i : i + BLOCK]] == 2))), len(text))
        yield text[start:stop]
        start = stop
    yield text[start:]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[str]]]:
    """The (lang, text) rows of a task in blocks, each with its languages' names."""
    texts, langs, names, size = [], [], {}, 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part in _cut(text.as_py() or b""):
                if texts and size + len(part) > BLOCK:
                    yield Block(texts, langs), list(names)
                    texts, langs, names, size = [], [], {}, 0
                texts.append(part)
                langs.append(names.setdefault(name, len(names)))
                size += len(part) + 1
    if texts:
        yield Block(texts, langs), list(names)


def _seeds(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(n.encode(), 1) for n in names], np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def cut_down(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The Misra-Gries step: at most ``capacity`` counters, all less by the largest count that does not fit."""
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > cut
    return keys[left], counts[left] - cut, cut


class Bitmap:
    """Bits by the leading bits of a hash, as ``bitmap_construct_agg`` lays them out."""

    def __init__(self, bits: int, data: np.ndarray):
        self.shift, self.data = np.uint64(64 - bits), data

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.shift
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


SUMMARY = "part int, mass long, keys binary, counts binary"


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """The ``width`` lower bytes of numbers, byte by byte: leading bytes of sorted hashes and upper bytes of counts compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, kind: type, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


def summaries(docs: DataFrame, sizes: tuple[int, ...], parts: int, known=None) -> DataFrame:
    """Rows of ``SUMMARY``: the n-grams of a task's texts by hash partition, merged without loss.

    ``known`` is a broadcast bitmap; only n-grams all of whose pairs it holds are taken.
    """
    shift, short = np.uint64(KEY - int(math.log2(parts))), np.uint64(64 - KEY)

    def handed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        edges = np.searchsorted(keys >> shift, np.arange(parts + 1))
        rows = [(p, keys[a:b], counts[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([int(r[2].sum()) for r in rows], pa.int64()), pa.array([_planes(r[1], KEY // 8) for r in rows], pa.binary()), pa.array([_planes(r[2]) for r in rows], pa.binary())], names=["part", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for block, names in blocks(batches):
            grams = block.grams(block.hashes(_seeds(names)), max(sizes))
            if known is not None:
                pairs, ok = grams[1]
                linked = ok & known.value.has(pairs)
            for n in sizes:
                keys, ok = grams[n - 1]
                if known is not None:
                    for j in range(n - 1):
                        ok = ok & linked[j : j + len(ok)]
                held.append(counted(keys[ok] >> short))
                total += len(held[-1][0])
            if total > HELD:
                held = [counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                total = len(held[0][0])
                if total > HELD // 2:
                    yield handed(*held[0])
                    held, total = [], 0
        if total:
            yield handed(*counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))
        release()

    return docs.mapInArrow(run, SUMMARY)


def merged(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """``key`` of every n-gram that may occur ``least`` times: one Misra-Gries summary per hash partition."""
    mass = rows.groupBy("part").agg(F.sum("mass").alias("total"))
    dealt = rows.join(small_side(mass, 100_000), "part").select("part", "total", "keys", "counts")
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, capacity, cut, size = -1, 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def shrunk() -> None:
            nonlocal held, cut, size
            keys, counts, less = cut_down(*counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])), capacity)
            held, cut, size = [(keys, counts)], cut + less, len(keys)

        def kept() -> pa.RecordBatch:
            shrunk()
            (keys, counts), *_ = held
            return pa.RecordBatch.from_arrays([pa.array((keys[counts + cut >= least] << np.uint64(64 - KEY)).view(np.int64))], names=["key"])

        for batch in batches:
            for p, total, keys, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                if p.as_py() != part:
                    if held:
                        yield kept()
                    part, capacity, cut, size, held = p.as_py(), total.as_py() // least + 1, 0, 0, []
                held.append((_unplanes(keys.as_py(), np.uint64, KEY // 8), _unplanes(counts.as_py(), np.int64)))
                size += len(held[-1][0])
                if size > 2 * capacity + HELD // 4:
                    shrunk()
        if held:
            yield kept()
        release()

    return dealt.mapInArrow(run, "key long")


def bitmap(keys: DataFrame, n: int, most: int = BITS) -> Bitmap:
    """The ``n`` hashes of ``keys`` as bits, at least 64 a hash unless there are too many; its size is bounded by ``most``."""
    bits = min(most, max(16, (64 * n).bit_length()))
    rows = keys.select((F.shiftrightunsigned("key", 64 - bits) + 1).alias("at")).select(F.expr("bitmap_bucket_number(at)").alias("b"), F.expr("bitmap_bit_position(at)").alias("i"))
    data = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for r in rows.groupBy("b").agg(F.expr("bitmap_construct_agg(i)").alias("bits")).toLocalIterator():
        piece = np.frombuffer(r["bits"], np.uint8)
        at = (r["b"] - 1) * 4096
        data[at : at + len(piece)] = piece[: len(data) - at]
    return Bitmap(bits, data)


def exact(docs: DataFrame, known) -> DataFrame:
    """``lang, phrase, n``: partial counts of what the bitmap lets through, by words; the phrase '' counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names in blocks(batches):
            lang = pa.array(names, pa.string())
            total = np.bincount(block.lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([lang, pa.array([""] * len(names), pa.string()), pa.array(total)], names=["lang", "phrase", "n"])
            ids, text = block.words()
            for n, (keys, ok) in enumerate(block.grams(block.hashes(_seeds(names)), WORDS), 1):
                at = np.flatnonzero(ok)
                at = at[known.value.has(keys[at])]
                if not len(at):
                    continue
                of, counts = _groups(keys[at], [block.lang[at], *(ids[at + j] for j in range(n))])
                first = at[of]
                parts = [text.take(pa.array(ids[first + j])) for j in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(block.lang[first])), phrase.cast(pa.string()), pa.array(counts)], names=["lang", "phrase", "n"])
        release()

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def _groups(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A member of each group of rows with equal ``columns``, and the group's size; ``keys`` is a hash of the columns."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    sizes = np.diff(np.append(start, len(keys)))
    head = order[start]
    if all(np.array_equal(c[order], np.repeat(c[head], sizes)) for c in columns):
        return head, sizes
    order = np.lexsort(columns)  # two n-grams share a hash
    new = np.zeros(len(keys), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    start = np.flatnonzero(new)
    return order[start], np.diff(np.append(start, len(keys)))


def planned_parts(docs: DataFrame, least: int, counters: int = COUNTERS) -> int:
    """Hash partitions, a power of two: a text of b bytes has at most (b + 1) / 2 words, and two n-grams a word are counted at once."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return 1 << max(6, math.ceil(math.log2(max(1, size / (least * counters)))))


def counts(docs: DataFrame, least: int = LEAST, counters: int = COUNTERS, bits: int = BITS) -> DataFrame:
    """``lang, phrase, n`` of every n-gram of one to ``WORDS`` words with at least ``least`` occurrences, and of '' (all words)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parts = planned_parts(rows, least, counters)
    with small_batches(spark, 500):
        with scratch(summaries(rows, (1, 2), parts), "summaries") as made:
            found = stored(merged(made, least), "survivors")
        pairs = spark.sparkContext.broadcast(bitmap(found, found.count(), bits))
        with scratch(summaries(rows, (3, 4), parts, pairs), "summaries") as made:
            found = found.unionByName(stored(merged(made, least), "survivors"))
        known = spark.sparkContext.broadcast(bitmap(found, found.count(), bits))
        return stored(exact(rows, known).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == "")), "counts")


def _big(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    every = counts(docs, least)
    totals = every.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = every.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cand = known.where(F.size("w") > 1)
    word = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", word(F.lit(1), F.col("k")).alias("left"), word(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"(CAST(a AS decimal(20,0)) * {SCORE}) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inside = known.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("a")) * absorbed))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # the first of a language are among the first of each of its salts, so that the last sort has at most SALTS * top rows
    first = scored.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op12_phrases``."""
    return phrases(docs)


def oracle_sql(least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> str:
    """DuckDB SQL for ``digest``: every n-gram, counted plainly."""
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {n - 1}], ' ') AS phrase, {n} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces WHERE len(w) >= {n})" for n in range(1, WORDS + 1))
    return f"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS a, string_split(phrase, ' ') AS w FROM ({grams}) GROUP BY lang, phrase, size HAVING count(*) >= {least}),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, ({SCORE}::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN subs USING (lang, phrase) JOIN totals USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < {absorbed}::HUGEINT * a
QUALIFY rank <= {top}"""
