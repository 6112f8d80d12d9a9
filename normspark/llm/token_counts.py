"""Token counts without tokens: an Aho-Corasick automaton lists the vocabulary's matches in a word and a
dynamic programme carries the best score and its number of pieces, under the tie rules of ``pieces``.

Defined results: null and empty texts have 0 tokens and score 0; a character outside the vocabulary counts
as many tokens as its UTF-8 form has bytes; repeated rows repeat; an empty table stays empty. Very long
words are counted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, model, per_text
from .pieces import Vocabulary, default_model, vocabulary, words

#: Bytes of remembered words per Python worker, and what one takes besides its characters.
CACHE, ENTRY = 96_000_000, 250


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary: Vocabulary = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary.score.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = Known(CACHE)

    def word(self, word: str) -> tuple[int, float, int]:
        """(pieces, score, unknown characters) of the best segmentation of one word."""
        size = len(word)
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for last, (n, score) in self.automaton.iter(word):
            by_end[last].append((n, score))
        score, count, odd = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            matches = by_end[end - 1]
            best = None
            # the longest match starts first; a later start must be strictly better
            for n, s in sorted(matches, reverse=True):
                total = score[end - n] + s
                if best is None or total > best:
                    best, count[end], odd[end] = total, count[end - n] + 1, odd[end - n]
            if not any(n == 1 for n, _ in matches):
                total = score[end - 1] + self.vocabulary.unknown
                if best is None or total > best:
                    best = total
                    count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    odd[end] = odd[end - 1] + 1
            score[end] = best
        return count[size], score[size], odd[size]

    def count(self, text: str) -> tuple[int, float, int]:
        n = unknown = 0
        score = 0.0
        known = self.known
        for w in words(text):
            got = known.get(w)
            if got is None:
                known.room(4 * len(w) + ENTRY)
                got = known[w] = self.word(w)
            n += got[0]
            score += got[1]
            unknown += got[2]
        return n, score, unknown


def counter(path: str) -> Counter:
    return model(("counter", path), lambda: Counter(path))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of query ``op9_token_counts``: ``n_tokens``, the best ``score`` and the characters spelt in bytes."""
    path = path or default_model()

    def run(texts: list[str | None]) -> list[list]:
        got = [counter(path).count(t or "") for t in texts]
        return [[g[i] for g in got] for i in range(3)]

    rows = per_text(docs, ["doc_id"], "n_tokens long, score double, n_unknown long", run)
    return rows.select(F.col("__keep.doc_id").alias("doc_id"), "n_tokens", "score", "n_unknown")
