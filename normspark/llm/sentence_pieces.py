"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Distinct words of a batch are grouped by length and advance together: for every end position, the hashes
of all substrings that end there probe the sorted keys of the vocabulary, and the vectorised maximum over
the starts stores the back pointer. Ids are then read off the back pointers word group by word group.

Defined results: null and empty texts have no ids and decode to the empty text; texts with U+2581 decode
it as a space (the mark's meaning), all other texts decode to themselves; repeated rows repeat; an empty
table stays empty. Very long words are segmented whole: a word of more than ``LONG`` code points has no
others of its length to advance with, so its substrings are hashed and probed for all starts of a block at
once and only what was found is walked, with the same sums in the same order. Columns of any name may come
along.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, mix64, model, per_text, slices
from .pieces import MARK, Vocabulary, default_model, vocabulary, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of remembered words per Python worker, and what one takes besides its characters and ids.
CACHE, ENTRY = 80_000_000, 180
#: Cells of the tables of one group of words: words by code points.
CELLS = 1_000_000
#: Code points from which a word goes on its own, and starts that are probed at once.
LONG, BLOCK = 400, 65_536


def _points(strings: list[str]) -> np.ndarray:
    """Code points of equally long strings, one row each."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), -1)


class Encoder:
    def __init__(self, path: str):
        self.vocabulary: Vocabulary = vocabulary(path)
        self.spelling = _spelling(self.vocabulary)
        names = list(self.vocabulary.score)
        keys = np.zeros(len(names), np.uint64)
        for i, name in enumerate(names):
            h = np.zeros(1, np.uint64)
            for c in name:
                h = mix64(h * _STEP + np.uint64(ord(c) + 1))
            keys[i] = h[0]
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array([self.vocabulary.score[n] for n in names], np.float64)[order]
        self.ids = np.array([self.vocabulary.id[n] for n in names], np.int64)[order]
        self.known = Known(CACHE)

    def _group(self, strings: list[str]) -> list[bytes]:
        """Ids of equally long words, as little-endian unsigned 32-bit integers."""
        points = _points(strings).astype(np.uint64) + np.uint64(1)
        n, size = points.shape
        longest = min(self.vocabulary.longest, size)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int32)
        piece = np.zeros((size + 1, n), np.int64)
        # starts run from left to right; each start offers its pieces and then the unknown character
        for start in range(size):
            h = np.zeros(n, np.uint64)
            single = np.zeros(n, bool)
            base = best[start]
            for end in range(start + 1, min(size, start + longest) + 1):
                h = mix64(h * _STEP + points[:, end - 1])
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found = self.keys[at] == h
                if end == start + 1:
                    single = found
                total = base + self.scores[at]
                better = found & (total > best[end])
                best[end][better], back[end][better], piece[end][better] = total[better], start, self.ids[at[better]]
            total = base + self.vocabulary.unknown
            better = ~single & (total > best[start + 1])
            best[start + 1][better], back[start + 1][better], piece[start + 1][better] = total[better], start, -1
        return [self._read(word, back[:, i], piece[:, i]) for i, word in enumerate(strings)]

    def _matches(self, points: np.ndarray, first: int) -> tuple[list, list, list]:
        """Starts (from ``first``, a block of them), ends and places in ``keys`` of all pieces in a word, by start and then by end."""
        count = min(BLOCK, len(points) - first)
        h = np.zeros(count, np.uint64)
        starts, ends, places = [], [], []
        for size in range(1, self.vocabulary.longest + 1):
            h = h[: min(count, len(points) - first - size + 1)]
            h = mix64(h * _STEP + points[first + size - 1 : first + size - 1 + len(h)])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            starts.append(hit + first)
            ends.append(hit + first + size)
            places.append(at[hit])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        return start[order].tolist(), np.concatenate(ends)[order].tolist(), np.concatenate(places)[order].tolist()

    def _long(self, word: str) -> bytes:
        """Ids of one long word, as ``_group`` gives them."""
        points = _points([word])[0].astype(np.uint64) + np.uint64(1)
        size, scores, ids, unknown = len(word), self.scores.tolist(), self.ids.tolist(), self.vocabulary.unknown
        best = array("d", [float("-inf")]) * (size + 1)
        back, piece = array("q", [0]) * (size + 1), array("q", [-1]) * (size + 1)
        best[0] = 0.0
        for first in range(0, size, BLOCK):
            starts, ends, places = self._matches(points, first)
            i, n = 0, len(starts)
            for start in range(first, min(size, first + BLOCK)):
                base, single = best[start], False
                while i < n and starts[i] == start:
                    end, at = ends[i], places[i]
                    single = single or end == start + 1
                    if base + scores[at] > best[end]:
                        best[end], back[end], piece[end] = base + scores[at], start, ids[at]
                    i += 1
                if not single and base + unknown > best[start + 1]:
                    best[start + 1], back[start + 1], piece[start + 1] = base + unknown, start, -1
        return self._read(word, back, piece)

    def _read(self, word: str, back: Sequence[int], piece: Sequence[int]) -> bytes:
        ids, end = [], len(word)
        while end:
            start, p = int(back[end]), int(piece[end])
            if p >= 0:
                ids.append(p)
            else:
                ids += [self.vocabulary.byte[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [words(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if new:
            if self.known.room(sum(map(len, new)) * 8 + ENTRY * len(new)):
                new = set().union(*split)
            by_size: dict[int, list[str]] = {}
            for w in sorted(new):
                by_size.setdefault(len(w), []).append(w)
            for size, group in by_size.items():
                if size > LONG:
                    self.known.update((w, self._long(w)) for w in group)
                    continue
                for i in range(0, len(group), step := max(1, CELLS // size)):
                    part = group[i : i + step]
                    self.known.update(zip(part, self._group(part), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; runs of byte pieces are read as UTF-8."""
        table = self.spelling
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _spelling(v: Vocabulary) -> list[bytes]:
    return [bytes([v.byte_of[i]]) if i in v.byte_of else (t or "").encode() for i, t in enumerate(v.text)]


def encoder(path: str) -> Encoder:
    return model(("encoder", path), lambda: Encoder(path))


def encoded(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``__keep`` and ``ids array<int>`` of every whole text."""
    path = path or default_model()

    def run(texts: list[str | None]) -> list[list]:
        out = []
        for s in slices([len(t or "") for t in texts], 2_000_000):
            out += [np.frombuffer(raw, "<u4").astype(np.int32) for raw in encoder(path).encode([t or "" for t in texts[s]])]
        return [out]

    return per_text(docs, keep, "ids array<int>", run)


def decoded(rows: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``__keep`` and ``text`` of rows with ``ids``."""
    path = path or default_model()

    def run(batch: list[list[int] | None]) -> list[list]:
        return [[encoder(path).decode(np.array(ids or [], "<u4").tobytes()) for ids in batch]]

    return per_text(rows, keep, "text string", run, "ids")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of query ``op4_sentence_pieces``: counts and checksums of the ids, and the decoded text's digest."""
    path = path or default_model()

    def run(texts: list[str | None]) -> list[list]:
        import hashlib

        n, crc, sha, same = [], [], [], []
        for s in slices([len(t or "") for t in texts], 2_000_000):
            part = [t or "" for t in texts[s]]
            enc = encoder(path)
            for text, raw in zip(part, enc.encode(part), strict=True):
                back = enc.decode(raw)
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == text)
        return [n, crc, sha, same]

    rows = per_text(docs, ["doc_id"], "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean", run)
    return rows.select(F.col("__keep.doc_id").alias("doc_id"), "n_pieces", "ids_crc32", "decoded_sha256", "round_trip")
