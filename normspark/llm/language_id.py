"""Language identification by cross-parsing against suffix automata.

A bounded sample of labelled rows per language (``train_rows`` rows, of each one passage of ``passage`` code
points from a hashed place in the whole text) is folded to letters and single spaces and turned into a suffix
automaton. A text is parsed greedily against each automaton into longest matches ("phrases"; a symbol that
the sample lacks is a phrase of its own); the language that needs the fewest phrases wins, ties going to the
language first in alphabetical order.

The parse is exact. Blocks of all texts advance together as numpy vectors, each as if a phrase began at its
start; where the block before ends inside a phrase, the parse of the block is mended from there until both
parses begin a phrase at the same symbol, after which they agree. Transitions are sparse: an automaton's edges
lie in one array, each state's at its own displacement, so memory follows the sample and not the alphabet.

Bounds, both parameters: ``train_rows`` labelled rows per language and ``passage``; every language is learned
and every text is parsed whole.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when nothing could be
learned; score = 1 - (fewest phrases / second fewest), 1.0 with a single learned language; a null doc_id
is never held out and never learned from; repeated rows repeat their result; an empty table stays empty;
very long texts are parsed whole, at about 40 bytes of working memory a code point; columns of any name may
come along. The stage drops ``und`` and writes the prediction into ``lang`` where there is such a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import model, per_text, slices

BLOCK = 256
#: Blocks over which parses are mended as vectors; what is still open then (texts of one period) is mended symbol by symbol.
MEND = 2
#: Folded codes besides the learned letters: after the text's end, the space, letters of no sample.
PAD, SPACE, OTHER = 0, 1, 2


def fold(text: str) -> str:
    """Lower-case letters, with each run of anything else as one space; a letter's fold does not hang on its neighbours."""
    return " ".join("".join(letter(c) if c.isalpha() else " " for c in text).split())


def letter(c: str) -> str:
    """What samples and texts know a letter as: the first code point of its lower-case form."""
    return c.lower()[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``codes``; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return steps


class Edges:
    """A suffix automaton's edges in one array of cells. A state is a displacement of its own: its edge for code c
    is at ``state + c``, if the upper half of the cell there is the state; the lower half is the next state.
    The start, where no phrase is open, is 0 and owns no cell: its edges are in ``root``."""

    def __init__(self, steps: list[dict[int, int]], width: int):
        edges = sum(map(len, steps)) - len(steps[0])
        size = 2 * (width + edges) + 64
        base, free, taken = np.zeros(len(steps), np.int64), np.ones(size, bool), {0}
        rnd = np.random.default_rng(1)
        # states of several edges first, the fullest first, at random places where all their cells are free
        for s in sorted(range(1, len(steps)), key=lambda s: -len(steps[s])):
            if len(steps[s]) == 1:
                break
            codes, tries = np.fromiter(steps[s], np.int64, len(steps[s])), 0
            while True:
                at = int(rnd.integers(1, len(free) - width))
                if at not in taken and free[at + codes].all():
                    break
                tries += 1
                if tries % 200 == 0:  # a crowded array grows
                    free = np.append(free, np.ones(len(free), bool))
            base[s] = at
            taken.add(at)
            free[at + codes] = False
        # a state of one edge takes any free cell that gives it a displacement of its own
        todo = np.array([s for s in range(1, len(steps)) if len(steps[s]) == 1], np.int64)
        code = np.array([next(iter(steps[s])) for s in todo], np.int64)
        while len(todo):
            place = np.flatnonzero(free)
            place = rnd.permutation(place[place > width])[: len(todo)]
            if len(place) < len(todo):
                free = np.append(free, np.ones(len(free), bool))
                continue
            want = place - code
            _, first = np.unique(want, return_index=True)
            good = np.zeros(len(todo), bool)
            good[first] = True
            good &= ~np.isin(want, np.fromiter(taken, np.int64, len(taken)))
            base[todo[good]] = want[good]
            taken.update(want[good].tolist())
            free[place[good]] = False
            todo, code = todo[~good], code[~good]
        spare = iter(range(1, len(steps) + len(taken) + 2))
        for s in range(1, len(steps)):
            if not steps[s]:
                base[s] = next(x for x in spare if x not in taken)
                taken.add(int(base[s]))
        self.cell = np.full(max(len(free), int(base.max()) + 1) + width, -1, np.int64)
        for s in range(1, len(steps)):
            for c, t in steps[s].items():
                self.cell[base[s] + c] = base[s] << 32 | base[t]
        self.root = np.zeros(width, np.int64)
        for c, t in steps[0].items():
            self.root[c] = base[t]

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether the phrase goes on; where not, one begins (or the text has ended)."""
        got = self.cell[state + code]
        on = got >> 32 == state
        return np.where(on, got & 0xFFFFFFFF, self.root[code]), on


class CrossParser:
    """The automata of all languages, and the codes of letters in any of the samples."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        folded = [fold(text) for _, text in samples]
        letters = sorted(set("".join(folded)) - {" "})
        code = {c: OTHER + 1 + i for i, c in enumerate(letters)} | {" ": SPACE}
        self.edges = [Edges(suffix_automaton([code[c] for c in text]), OTHER + 1 + len(letters)) for text in folded]
        kind = np.uint8 if len(code) < 250 else np.uint16 if len(code) < 65_000 else np.int32
        self.codes, self.letter = np.full(0x110000, SPACE, kind), np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                self.letter[cp] = True
                self.codes[cp] = code.get(letter(c), OTHER)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and whether the text has a letter."""
        n = len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.fromiter(map(len, texts), np.int64, n))
        codes = self.codes[points]
        has = np.bincount(owner, self.letter[points], n) > 0 if len(points) else np.zeros(n, bool)
        # runs of anything but letters become one space, none at the ends
        keep = codes != SPACE
        keep[1:] |= (codes[:-1] != SPACE) & (owner[1:] == owner[:-1])
        codes, owner = codes[keep], owner[keep]
        if len(codes):
            last = np.append(owner[1:] != owner[:-1], True)
            keep = ~(last & (codes == SPACE))
            codes, owner = codes[keep], owner[keep]
        sizes = np.bincount(owner, minlength=n)
        blocks = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        grid = np.zeros(first[-1] * BLOCK, codes.dtype)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        grid[np.arange(len(codes)) + np.repeat(first[:-1] * BLOCK - starts, sizes)] = codes
        grid = np.ascontiguousarray(grid.reshape(-1, BLOCK).T)
        of = np.repeat(np.arange(n), blocks)
        follows = np.append(of[1:] == of[:-1], False)[: len(of)]  # whether the next block is the same text's
        total = np.zeros((n, len(self.edges)), np.int64)
        for i, edges in enumerate(self.edges):
            total[:, i] = np.bincount(of, _begun(edges, grid, follows), n)[:n]
        return total, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        given = [t or "" for t in texts]
        for s in slices([len(t) for t in given], 2_000_000):
            counts, has = self.phrases(given[s])
            for i, (row, letters) in enumerate(zip(counts, has, strict=True), s.start):
                if not letters or not self.languages:
                    names.append("und")
                    continue
                best = int(row.argmin())
                names.append(self.languages[best])
                rest = np.delete(row, best)
                scores[i] = 1.0 - row[best] / rest.min() if len(rest) and rest.min() else float(not len(rest))
        return names, scores


def _begun(edges: Edges, grid: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block (a column of ``grid``), the parse running on from block to block of one text."""
    size, n = grid.shape
    on, state = np.zeros((size, n), bool), np.zeros(n, np.int64)
    for j in range(size):
        state, on[j] = edges.step(state, grid[j].astype(np.int64))
    # where a phrase runs over the end of a block, go on with it until both parses begin one at the same symbol
    block = np.flatnonzero(follows & (state != 0))
    now = state[block]
    block = block + 1
    for turn in range(MEND * size):
        j = turn % size
        if turn and not j:
            going = follows[block]
            block, now = block[going] + 1, now[going]
        if not len(block):
            break
        code = grid[j, block].astype(np.int64)
        now, goes = edges.step(now, code)
        was = on[j, block]
        on[j, block] = goes
        going = (goes | was) & (code != PAD)
        if not going.all():
            block, now = block[going], now[going]
    if len(block):
        going = follows[block]
        _one_by_one(edges, grid, follows, on, dict(zip((block[going] + 1).tolist(), now[going].tolist(), strict=True)))
    return (~on & (grid != PAD)).sum(axis=0, dtype=np.int64)


def _one_by_one(edges: Edges, grid: np.ndarray, follows: np.ndarray, on: np.ndarray, waiting: dict[int, int]) -> None:
    """The same, symbol by symbol from the left, for blocks that the parse of ``waiting`` states enters; one that passes another's start takes over."""
    for block in sorted(waiting):
        state = waiting.pop(block, None)
        while state is not None:
            for j in range(len(grid)):
                code = int(grid[j, block])
                got = int(edges.cell[state + code])
                goes = got >> 32 == state
                state = got & 0xFFFFFFFF if goes else int(edges.root[code])
                was, on[j, block] = on[j, block], goes
                if code == PAD or not (goes or was):
                    state = None
                    break
            if state is not None:
                block += 1
                if not follows[block - 1]:
                    break
                waiting.pop(block, None)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_rows: int = 64, passage: int = 400) -> tuple[tuple[str, str], ...]:
    """A bounded sample of labelled text by language: at most ``train_rows`` rows, of each one passage of ``passage`` code points."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").alias("lang"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("text").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # reads no text
    if not sizes:
        return ()
    # about eight times the wanted rows pass the hash threshold, and the window cuts that small remainder exactly
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 8 * train_rows / n)))))
    some = rows.where((F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - passage, F.lit(0)) + 1) + 1
    some = some.select("lang", "doc_id", "h", F.substr("text", place.cast("int"), F.lit(passage)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    got = some.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= train_rows).select("lang", "rn", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rn"])):
        samples.setdefault(r["lang"], []).append(fold(r["text"]))
    return tuple(sorted((k, " ".join(v)) for k, v in samples.items()))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], keep: list[str]) -> DataFrame:
    """``__keep`` (struct of the ``keep`` columns), ``lang_pred`` and ``score``; only ``text`` is read for the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    return per_text(docs, keep, "lang_pred string, score double", lambda texts: model(("language", sent.value), lambda: CrossParser(sent.value)).predict(texts))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query ``op10_language_id``."""
    return predict(docs, learn(docs), ["doc_id"]).select("__keep.doc_id", held_out(F.col("__keep.doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Pipeline stage: documents without a recognised language (``und``) or, where ``languages`` names those wanted, of another go.

    The prediction takes the place of ``lang``, so that later stages and readers have one for every document.
    """
    pred = predict(docs, learn(docs), docs.columns)
    fits = F.col("lang_pred") != "und"
    if languages is not None:
        fits = fits & F.col("lang_pred").isin(*languages)
    return pred.where(fits).select(*(F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang") if c == "lang" else F.col("__keep")[c].alias(c) for c in docs.columns))
