"""Near-duplicate texts by DartMinHash signatures, banded joins and exact verification.

A text is the multiset of its shingles of ``WORDS`` words (words are runs without ASCII blanks; a text of
fewer words is one shingle), a shingle's weight being its number of occurrences. Similarity is the weighted
Jaccard of two multisets. The plane of each element, weight by time, is cut into strips of weight [0, 1),
[1, 2), [2, 4), [4, 8), ...; into each strip fall hashed darts as a Poisson process in time, as dense as the strip is
wide, each at a hashed weight and aimed at one of ``BANDS * ROWS`` coordinates. A text takes the darts below its
weight and keeps, per coordinate, the earliest. Two texts keep the same dart with a probability of their
similarity, and a text of any weight needs about k ln k darts, not k per element.

Texts with equal word sequences (by a 128-bit hash) form a class by hash aggregation. Classes that share a band are
linked to a leader there (the one that shares most bands with others), verified on their whole shingle multisets.
What shares a bucket and is still apart is paired by its rarest cells within the bucket (an exact prefix
filter), so no link of a bucket is lost and no cap is needed. Connected groups get the smallest doc_id as class id.

Defined results: null and empty texts (no words) are groups of their own row, never linked; rows with a
null doc_id are kept with themselves as class id null; repeated rows fall into one group; rows that share a doc_id
but not the text are judged each by its text; a group's id is its smallest doc_id; an empty table stays empty; very
long texts are compared whole, at about 150 bytes of working memory a code point; columns of any name may come along.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, per_text, shared_dir, slices, small_side, stored

WORDS, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**24 = 0.9999.
BANDS, ROWS = 24, 5

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, sorted within each text; the text of each; words by text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    n = len(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    start = np.flatnonzero(~blank & before)
    stop = np.flatnonzero(blank & ~before)
    power, inverse = _powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    word = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    owner = np.searchsorted(ends, start, "right")
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    # shingles start at every word that has WORDS - 1 more of its text behind it; a short text has one
    long = np.maximum(count - WORDS + 1, np.minimum(count, 1))
    begin = np.repeat(first[:-1], long) + (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long))
    of = np.repeat(np.arange(n), long)
    shingle = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        part = np.where(k < count[of], padded[begin + k], np.uint64(0))
        shingle = mix64(shingle * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(k + 1))
    return shingle[np.lexsort((shingle, of))], of, count


def elements(shingle: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text, weight."""
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(new)
    return shingle[run], of[run], np.diff(np.append(run, len(shingle)))


def cells(shingle: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A multiset as a set: the j-th occurrence of a shingle in a text gets a hash of its own. Sorted within each text."""
    _, _, weight = elements(shingle, of)
    nth = np.arange(len(shingle)) - np.repeat(np.cumsum(weight) - weight, weight)
    cell = np.where(nth > 0, mix64(shingle + nth.astype(np.uint64) * np.uint64(_BASE)), shingle)
    return cell[np.lexsort((cell, of))]


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers between 0 and 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def darts(element: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """The signature of each of ``n`` texts: per coordinate the identity of the earliest dart (all 0 for a text without elements)."""
    out = np.zeros((n, k), np.uint64)
    # strips of each element up to its weight: number, lower edge, width
    strips = np.where(weight > 1, np.frexp(np.maximum(weight - 1, 1).astype(np.float64))[1] + 1, 1)
    each = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(each)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip > 0, 2.0 ** (strip - 1), 0.0)
    wide = np.maximum(low, 1.0)
    seed, text, top = mix64(element[each] + strip.astype(np.uint64) * np.uint64(_BASE)), of[each], weight[each].astype(np.float64)
    mass = np.bincount(of, weight, n)
    todo, spare = np.flatnonzero(mass), 4.0
    while len(todo):
        # horizon of time within which a text of this weight gets k (ln k + spare) darts on average
        horizon = np.zeros(n)
        horizon[todo] = k * (np.log(k) + spare) / mass[todo]
        at = np.flatnonzero(horizon[text] > 0)
        time = np.zeros(len(at))
        got_time, got_at, got_id = [], [], []
        turn = 0
        while len(at):
            turn += 1
            h = mix64(seed[at] + np.uint64(turn * 0x9E3779B97F4A7C15 & _M64))
            time = time - np.log(_unit(h)) / wide[at]
            alive = time < horizon[text[at]]
            at, time, h = at[alive], time[alive], h[alive]
            dart = mix64(h ^ np.uint64(0xA0761D6478BD642F))
            hit = low[at] + wide[at] * _unit(mix64(dart + np.uint64(1))) < top[at]
            got_time.append(time[hit])
            got_at.append(text[at[hit]] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            got_id.append(dart[hit])
        when, place, name = np.concatenate(got_time), np.concatenate(got_at), np.concatenate(got_id)
        order = np.argsort(-when, kind="stable")  # the earliest is written last
        flat = np.zeros(n * k, np.uint64)
        flat[place[order]] = name[order] | np.uint64(1)
        flat = flat.reshape(n, k)
        full = (flat != 0).all(axis=1)
        done = todo[full[todo]]
        out[done] = flat[done]
        todo, spare = todo[~full[todo]], spare * 2
    return out


def word_key(text: str | None) -> bytes | None:
    """A 128-bit hash of the word sequence; None without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _bands(signature: np.ndarray) -> np.ndarray:
    grid = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), grid.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + grid[:, :, r])
    return key.view(np.int64)


#: Bytes of text whose darts fly at once.
AT_ONCE = 500_000


def _signatures(texts: list[str | None]) -> tuple[list, list, list]:
    words, bands = [], []
    for s in slices([len(t or "") for t in texts], AT_ONCE):
        shingle, of, count = shingles(texts[s])
        got = _bands(darts(*elements(shingle, of), len(count)))
        words += count.tolist()
        bands += [list(b) if c else None for b, c in zip(got, count.tolist(), strict=True)]
    return words, list(map(word_key, texts)), bands


def _packed(texts: list[str | None]) -> list[list]:
    out = []
    for s in slices([len(t or "") for t in texts], AT_ONCE):
        shingle, of, count = shingles(texts[s])
        cell = cells(shingle, of).view(np.int64)
        cut = np.searchsorted(of, np.arange(len(count) + 1))
        out += [cell[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [list(map(word_key, texts)), out]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of distinct cells."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


def _rows(lists) -> list[np.ndarray]:
    """The lists of an Arrow column as views of its values."""
    values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _verify(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """``a, b`` of ``pairs`` whose similarity is at least ``least``. A hot side's join partitions are split by size."""
    import pyarrow as pa

    one = packed.select(F.col("rep").alias("a"), F.col("cells").alias("cells_a"))
    two = packed.select(F.col("rep").alias("b"), F.col("cells").alias("cells_b"))
    rows = small_side(pairs, IDS // 2).join(one, "a").join(two, "b").select("a", "b", "cells_a", "cells_b")

    def run(batches):
        for batch in batches:
            one, two = _rows(batch.column(2)), _rows(batch.column(3))
            keep = [similarity(x, y) >= least for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``group``: the smallest node of each connected component of ``a, b`` (longs).

    Large-star / small-star rounds on tables in the shared folder; a hub's edges are aggregated to minima
    before they are joined back. The driver sees two counts a round.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of a node gets the smallest of the node's neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours get the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("group")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct())


def classes_of(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs``: ``doc_id, words, key``; and one per text with words: ``key``, ``copy_class`` (its smallest
    doc_id), ``class_id`` (the smallest doc_id of its group) and ``kept_key`` (the group's text that has this doc_id)."""
    sig = stored(per_text(docs, ["doc_id"], "words long, key binary, bands array<long>", _signatures).select("__keep.doc_id", "words", "key", "bands"), "signatures")
    # equal words have equal bands, so any row's stand for the class; classes get numbers, as doc_ids may repeat
    classes = sig.where("words > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("words").alias("words"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # the band's number is part of its hash
    banded = classes.select("rep", F.greatest(F.col("words") - (WORDS - 1), F.lit(1)).alias("n"), F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = banded.join(crowded, "bucket").select("bucket", "rep", "n", "c")
    # a text in the middle of its group shares more bands with more texts, so it makes the better leader
    members = stored(members, "members")
    middle = stored(members.groupBy("rep").agg(F.sum("c").alias("degree")), "degrees")
    members = stored(members.join(middle, "rep").select("bucket", "rep", "n", "degree"), "buckets")
    # multisets are made once, for the classes that share a bucket with another
    wanted = stored(classes.select("rep", "first", "key").join(middle.select("rep"), "rep", "left_semi"), "wanted")
    texts = docs.join(small_side(wanted.select(F.col("first").alias("doc_id")).distinct(), IDS), "doc_id", "left_semi")
    packed = per_text(texts, ["doc_id"], "key binary, cells array<long>", _packed).select(F.col("__keep.doc_id").alias("first"), "key", "cells")
    packed = packed.join(small_side(wanted, IDS), ["first", "key"]).select("rep", "cells")
    packed = stored(packed.groupBy("rep").agg(F.first("cells").alias("cells")), "cells")
    joined = _linked(members, packed, least).select(F.col("node").alias("rep"), "group")
    named = classes.select("rep", "key", "first").join(joined, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    named = stored(named, "named")
    # stored, so that the adaptive skew join can split a large group
    chosen = stored(named.groupBy("group").agg(F.min(F.struct("first", "key")).alias("one"), F.count("*").alias("n")).where("n > 1"), "chosen")
    by_key = named.join(chosen, "group", "left").select("key", F.col("first").alias("copy_class"), F.coalesce("one.first", "first").alias("class_id"), F.coalesce("one.key", "key").alias("kept_key"))
    return sig.select("doc_id", "words", "key"), stored(by_key, "by-key")


def groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``copy_class`` (smallest doc_id with the same words) and ``class_id`` (smallest doc_id of the near-duplicate group), one row per row of ``docs``."""
    rows, by_key = classes_of(docs, least)
    own = F.col("words").eqNullSafe(0) | F.col("doc_id").isNull()
    joined = rows.join(by_key, "key", "left")
    return joined.select("doc_id", *(F.when(own, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("copy_class", "class_id")))


#: Rows of ids (8 or 16 bytes each) that a broadcast may have; more are joined by a shuffle.
IDS = 2_000_000

#: Rounds with one leader a bucket before the rest of the buckets' members is joined by rare cells.
LEADER_ROUNDS = 1


def _linked(members: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """``node``, ``group`` of all links of at least ``least`` between members of a bucket.

    A leader meets the members of its bucket that are not connected with it so far. After a few such rounds
    the members of buckets that still hold several groups are joined by ``_rare_pairs``, which misses no link.
    """
    spark = members.sparkSession
    edges_at, seen_at = shared_dir(spark, "links"), shared_dir(spark, "seen")
    spark.createDataFrame([], "a long, b long").write.parquet(edges_at)
    spark.createDataFrame([], "a long, b long").write.parquet(seen_at)
    read = lambda path: spark.read.schema("a long, b long").parquet(path)
    split = members.withColumn("group", F.col("rep"))
    for _ in range(LEADER_ROUNDS):
        lead = split.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"), "n", "group")).alias("l"))
        lead = lead.select("bucket", (-F.col("l.r")).alias("b"), F.col("l.n").alias("n_b"), F.col("l.group").alias("group_b"))
        pairs = split.join(lead, "bucket").where("group <> group_b").where("least(n, n_b) >= %r * greatest(n, n_b)" % least)
        pairs = pairs.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct().join(read(seen_at), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            break
        _verify(pairs, packed, least).write.mode("append").parquet(edges_at)
        pairs.write.mode("append").parquet(seen_at)
        now = components(read(edges_at))
        grouped = members.join(now.select(F.col("node").alias("rep"), "group"), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
        grouped = stored(grouped.select("bucket", "rep", "n", "degree", "group"), "grouped")
        # buckets within one group are done; leaders that are through step aside
        still = grouped.join(grouped.groupBy("bucket").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("bucket"), "bucket", "left_semi")
        led = lead.select("bucket", F.col("b").alias("rep"), F.lit(True).alias("led"))
        split = stored(still.join(led, ["bucket", "rep"], "left").withColumn("degree", F.when(F.col("led"), 0).otherwise(F.col("degree"))).drop("led"), "split")
    rest = stored(_rare_pairs(split.select("bucket", "rep", "group"), packed, least).join(read(seen_at), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        _verify(rest, packed, least).write.mode("append").parquet(edges_at)
    return components(read(edges_at))


def _rare_pairs(rows: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of different groups in one bucket that may have the similarity ``least``; no such pair is missed.

    With all cells in one order, rarest first, two texts that similar share a cell among the first
    n - ceil(least * n) + 1 of each, and their first shared cell leaves room for the overlap they need. Texts
    that differ from all others in many cells have only cells of their own there and meet nobody; texts of common
    cells alone meet within their bucket only. In each cell's list there, members of its largest group are not
    paired with each other.
    """
    rows = stored(rows, "apart")
    each = packed.join(small_side(rows.select("rep").distinct(), IDS), "rep", "left_semi").select("rep", F.size("cells").alias("n"), F.explode("cells").alias("cell"))
    # counts are made where the cells are, and only those of shared cells go back to them
    shared = stored(each.groupBy("cell").agg(F.count("*").alias("df")).where("df > 1"), "shared-cells")
    counted = each.join(shared, "cell", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    placed = counted.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("df", "cell")) - 1)
    prefix = placed.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least)) & (F.col("df") > 1))
    prefix = stored(prefix.select("rep", "n", "cell", "at").join(rows, "rep"), "prefix")
    place = ["bucket", "cell"]
    main = prefix.groupBy(*place, "group").agg(F.count("*").alias("m")).groupBy(*place).agg(F.max(F.struct("m", "group")).alias("g"), F.count("*").alias("groups")).where("groups > 1").select(*place, F.col("g.group").alias("main"))
    outer = stored(prefix.join(main, place).where("group <> main").select(*place, *(F.col(c).alias(f"x_{c}") for c in ("rep", "group", "n", "at"))), "outer")
    need = F.ceil((F.col("n") + F.col("x_n")) * (least / (1 + least)) - 1e-9)
    fits = (F.col("group") != F.col("x_group")) & (F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) >= need)
    pairs = prefix.join(outer, place).where(fits)
    return pairs.select(F.greatest("rep", "x_rep").alias("a"), F.least("rep", "x_rep").alias("b")).distinct()


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op6_near_dup``."""
    return groups(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group one row stays, the text with the smallest doc_id; rows without words or doc_id stay.

    Ids alone are joined to the texts. Only rows that repeat a doc_id are told apart by their word sequences.
    """
    rows, by_key = classes_of(docs)
    found = rows.where("words > 0 and doc_id is not null").join(by_key, "key")
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("kept_key"))
    found = stored(found.select("doc_id", "key", stays.alias("stays")), "decisions")
    again = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    gone = small_side(stored(found.where("not stays").select("doc_id").join(small_side(again, IDS), "doc_id", "left_anti"), "gone"), IDS)
    single = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return single
    single = single.join(small_side(again, IDS), "doc_id", "left_anti").select(*docs.columns)
    more = per_text(docs.join(small_side(again, IDS), "doc_id", "left_semi").select(*docs.columns), docs.columns, "key binary", lambda texts: [list(map(word_key, texts))])
    more = more.withColumn("doc_id", F.col("__keep.doc_id"))
    right = found.where("stays").select("doc_id", "key").distinct()
    texts = more.join(small_side(right, IDS // 4), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").agg(F.first("__keep").alias("__keep"))
    return single.unionByName(texts.select("__keep.*")).unionByName(more.where("key is null").select("__keep.*"))
