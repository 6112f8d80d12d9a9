"""The models of the URL filter over arrays, to compare the joins with."""

import numpy as np

from normspark.llm.common import mix64
from normspark.llm.url_filter import ORDER

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts and of contexts with the next byte, both (orders, positions); each position's URL; lengths.

    A context of order k that would reach before the URL's start is padded with zero bytes.
    """
    raw = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r)) or b"\0", np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    first = np.cumsum(sizes + ORDER) - sizes
    of = np.repeat(np.arange(len(raw)), sizes)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    context = np.zeros((ORDER + 1, len(at)), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(ORDER + 1):
        if k:
            h = mix64(h * _STEP + data[at - k] + np.uint64(1))
        context[k] = mix64(h + np.uint64(k + 1))
    gram = mix64(context ^ mix64(data[at] + np.uint64(1000)))
    return context, gram, of, sizes


class Markov:
    """Counts of grams, and of their contexts totals and numbers of different followers."""

    def __init__(self, context: np.ndarray, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.n = gram[order], n[order].astype(np.float64)
        self.context, i = np.unique(context, return_inverse=True)
        self.total = np.bincount(i, n, len(self.context))
        self.kinds = np.bincount(i, minlength=len(self.context)).astype(np.float64)

    @staticmethod
    def _find(keys: np.ndarray, values: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(x)) for _ in values]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[at] == x
        return [np.where(hit, v[at], 0.0) for v in values]

    def log_likelihood(self, context: np.ndarray, gram: np.ndarray) -> np.ndarray:
        p = np.full(gram.shape[1], 1 / 256)
        for k in range(len(context)):
            (n,) = self._find(self.gram, [self.n], gram[k])
            total, kinds = self._find(self.context, [self.total, self.kinds], context[k])
            known = total > 0
            p = np.where(known, (n + kinds * p) / np.where(known, total + kinds, 1), p)
        return np.log(p)
