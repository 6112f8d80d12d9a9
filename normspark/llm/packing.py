"""Packing of tokenised documents by shortest-pack-first over the histogram of lengths.

A document's ids are the tokenizer's ids of its whole text followed by ``END_ID``. Documents longer than
``CAPACITY`` are cut there; every piece is described by one small row. The histogram of piece lengths (at
most ``CAPACITY`` rows, whatever the input) is packed on the driver: lengths are placed longest first,
each into the pack pattern that is shortest so far and still has room, and only counts of patterns are
updated. Patterns go back to the pieces by the rank of a piece among those of its length; ranks come from
two levels (row numbers within salted buckets, offsets from bucket counts), so that one frequent length
is no single sort.

Defined results: a null text counts as empty and yields the piece of ``END_ID`` alone; repeated rows are
packed as often as they occur; an empty table gives an empty result; ties in rank go by doc_id and start;
very long texts are tokenised whole and cut into pieces; columns of any name may come along, they are dropped.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Known, model, per_text, slices, stored

CAPACITY, END_ID = 4096, 2
#: Bytes of remembered words per Python worker.
CACHE = 64_000_000
#: What a remembered word takes besides its characters and ids.
ENTRY = 100


class WordIds:
    """Ids of whole texts, looked up blank-separated word by word.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words; each
    distinct word goes through the tokenizer once while it stays cached.
    """

    def __init__(self, path: str, memory: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normal = self.tokenizer.normalizer
        self.known = Known(memory)
        self.plain: set[str] = set()
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the tokenizer must mark the ends of words")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split) - self.known.keys()
        if new:
            # a new word may bring its core along as an entry of its own
            if self.known.room(sum(map(len, new)) * 4 + 2 * ENTRY * len(new)):
                new = set().union(*split)
            self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, new: set[str]) -> None:
        """Ids of new words. The tokenizer folds case and cuts between letters and marks, so a word of
        letters is tokenized once for all its spellings with capitals and a mark behind it."""
        core = {w: self._core(w) for w in new}
        todo = ({c for c, _ in core.values()} | {m for _, m in core.values()}) - self.known.keys()
        plain = [w for w in todo if w.isalpha()]
        rest = [w for w in todo if not w.isalpha()]
        # words of letters are tokenized many at a time and told apart by the tokens that end a word
        groups = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update(zip(group, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
            else:
                rest += group
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = array("I", got.ids).tobytes()
        for word, (c, mark) in core.items():
            self.known[word] = self.known[c] + self.known[mark]

    def _core(self, word: str) -> tuple[str, str]:
        """A word as (part to tokenize, mark behind it). A mark comes off only where the tokenizer sees letters alone before it:
        some letters it normalises to a letter and a combining sign, which joins the mark."""
        letters, mark = (word[:-1], word[-1]) if word[-1:] in (*".,;:!?",) else (word, "")
        if letters.isascii() and letters.isalpha():
            return letters.lower(), mark
        if mark and letters.isalpha() and (self.plain.issuperset(letters) or self._stay_letters(letters)):
            return letters, mark
        return word, ""

    def _stay_letters(self, letters: str) -> bool:
        for c in letters:
            if c not in self.plain:
                if not (self.normal.normalize_str(c) if self.normal else c).isalpha():
                    return False
                self.plain.add(c)
        return True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, memory: int = CACHE) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: one row per piece, made in one pass over the texts."""
    path = path or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def run(texts: list[str | None]) -> tuple[list, list]:
        ids, sizes, sums = model(("words", path, memory), lambda: WordIds(path, memory)), [], []
        for s in slices([len(t or "") for t in texts], 2_000_000):
            for raw in ids.encode([t or "" for t in texts[s]]):
                raw += end
                sizes.append(len(raw) // 4)
                sums.append([zlib.crc32(raw[i : i + 4 * capacity]) for i in range(0, len(raw), 4 * capacity)])
        return sizes, sums

    rows = per_text(docs, ["doc_id"], "doc_tokens long, sums array<long>", run)
    rows = rows.select("__keep.doc_id", "doc_tokens", F.posexplode("sums").alias("i", "ids_crc32"))
    start = F.col("i").cast("long") * capacity
    return rows.select("doc_id", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens")


Pattern = tuple[tuple[int, int], ...]


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Packs as (pattern, count); a pattern lists (length, copies) in order of placement.

    The shortest pattern with room takes one more document in as many of its packs as are needed; a new
    pack takes as many documents of the length as fit.
    """
    room: dict[int, dict[Pattern, int]] = {}

    def put(pattern: Pattern, left: int, n: int) -> None:
        if n:
            group = room.setdefault(left, {})
            group[pattern] = group.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            left = max(room, default=0)
            if left < length:
                break
            pattern, n = next(iter(room[left].items()))
            del room[left][pattern]
            if not room[left]:
                del room[left]
            used = min(n, todo)
            *head, last = pattern
            grown = (*head, (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(pattern, left, n - used)
            put(grown, left - length, used)
            todo -= used
        each = capacity // length
        put(((length, each),), capacity - each * length, todo // each)
        if rest := todo % each:
            put(((length, rest),), capacity - rest * length, 1)
    return [(p, n) for left in sorted(room) for p, n in sorted(room[left].items())]


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, copies per sequence, offset of the first copy)."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, copies, offset))
            ranks[length] = rank + n * copies
            offset += length * copies
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rank``, 0 upwards within each length, by buckets of at most about 50,000 rows."""
    buckets = max(16, total // 50_000)
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = sizes.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    return salted.withColumn("within", within).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, memory: int = CACHE) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    import pyarrow as pa

    rows = stored(pieces(docs, path, capacity, memory), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(slots(pack(histogram, capacity)))  # bounded by the capacity, not the input
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                table = places.value[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                i = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + i // row[:, 2], row[:, 3] + i % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    source = ranked(rows, sum(histogram.values())).select(*names, "rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return source.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op3_packing``."""
    return packed(docs)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the documents kept, packed."""
    return packed(docs)
