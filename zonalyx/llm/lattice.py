"""Segmentation lattices of words over a unigram vocabulary, many words at once.

A word is a byte string that starts with a blank. Every vocabulary piece that
occurs in it is an edge of its lattice, and a path's weight is the product of its
pieces' probabilities. The forward recursion, in log space, sums over all paths;
with the backward recursion it gives each piece's expected count.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
#: Cells (words x length) computed at once.
_CELLS = 1 << 20
#: Words up to this length keep their edges between the two recursions.
_KEEP_EDGES = 1 << 16


class Pieces:
    """Vocabulary pieces and their natural-log probabilities, with a table from hashes of substrings to pieces."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.pieces = pieces
        self.log_p = np.append(log_p, -np.inf)
        self.lengths = sorted({len(p) for p in pieces})
        self.power = np.array([pow(_BASE, k, 1 << 64) for k in range(max(self.lengths, default=0) + 1)], np.uint64)
        self.bits = max(4, math.ceil(math.log2(max(1, len(pieces)))) + 2)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for k, piece in enumerate(pieces):
            h = 0
            for b in piece:
                h = (h * _BASE + b + 1) & _MASK
            at, n = self._slot(h), 1
            while self.ids[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.keys[at], self.ids[at] = h, k
            self.probes = max(self.probes, n)

    def _slot(self, h: int) -> int:
        return ((h * 0x9E3779B97F4A7C15) & _MASK) >> (64 - self.bits)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.ids[at], -1)
        todo = np.flatnonzero((out < 0) & (self.ids[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = (self.keys[at[todo]] == hashes[todo]) & (self.ids[at[todo]] >= 0)
            out[todo[hit]] = self.ids[at[todo[hit]]]
            todo = todo[~hit & (self.ids[at[todo]] >= 0)]
        return out


def groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their bytes as a matrix) of words of one length, in parts of bounded size."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        n = max(1, int(lengths[order[start]]))
        stop = int(np.searchsorted(lengths[order], lengths[order[start]], "right"))
        stop = min(stop, start + max(1, _CELLS // n))
        part = order[start:stop]
        yield part, np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(len(part), -1)
        start = stop


class Lattice:
    """The lattices of words of one length n (codes: words x n).

    Up to _KEEP_EDGES, each piece length's edges are found at once, for all starts
    and words; of longer words, edges are found end by end, and again when needed.
    """

    def __init__(self, codes: np.ndarray, pieces: Pieces) -> None:
        self.pieces, (self.m, self.n) = pieces, codes.shape
        self.hashes = np.zeros((self.n + 1, self.m), np.uint64)
        base = np.uint64(_BASE)
        for j in range(self.n):
            self.hashes[j + 1] = self.hashes[j] * base + codes[:, j] + np.uint64(1)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] | None = None
        if self.n <= _KEEP_EDGES:
            self.kept = {}
            for size in self.pieces.lengths:
                if size > self.n:
                    break
                ids = self._between(0, self.n - size + 1, size)
                if (ids >= 0).any():
                    self.kept[size] = ids, pieces.log_p[ids]

    def _between(self, start: int, stop: int, size: int) -> np.ndarray:
        """Piece numbers of the substrings of one size that start in start .. stop - 1."""
        h = self.hashes[start + size : stop + size] - self.hashes[start:stop] * self.pieces.power[size]
        return self.pieces.find(h.ravel()).reshape(h.shape)

    def _edges(self, j: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(start, piece numbers, their log probabilities) of the edges that end at j."""
        if self.kept is not None:
            return [(j - size, ids[j - size], logs[j - size]) for size, (ids, logs) in self.kept.items() if size <= j]
        out = []
        for size in self.pieces.lengths:
            if size > j:
                break
            ids = self._between(j - size, j - size + 1, size)[0]
            if (ids >= 0).any():
                out.append((j - size, ids, self.pieces.log_p[ids]))
        return out

    def forward(self) -> np.ndarray:
        alpha = np.full((self.n + 1, self.m), -np.inf)
        alpha[0] = 0.0
        for j in range(1, self.n + 1):
            terms = [alpha[i] + logs for i, _, logs in self._edges(j)]
            if terms:
                alpha[j] = _log_sum(terms)
        return alpha

    def _backward(self) -> np.ndarray:
        beta = np.full((self.n + 1, self.m), -np.inf)
        beta[self.n] = 0.0
        for i in range(self.n - 1, -1, -1):
            terms = [beta[i + size] + logs[i] for size, (_, logs) in self.kept.items() if i + size <= self.n]
            if terms:
                beta[i] = _log_sum(terms)
        return beta

    def expect(self, weights: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected piece counts, each word weighted, to counts."""
        alpha = self.forward()
        total = alpha[self.n]
        reached = np.isfinite(total)
        weights = np.where(reached, weights, 0.0)
        alpha = alpha - np.where(reached, total, 0.0)
        if self.kept is not None:
            beta = self._backward()
            for size, (ids, logs) in self.kept.items():
                share = np.exp(alpha[: self.n - size + 1] + logs + beta[size:]) * weights
                on = ids >= 0
                counts += np.bincount(ids[on], share[on], len(counts))
            return
        beta = np.full((self.n + 1, self.m), -np.inf)
        beta[self.n] = 0.0
        for j in range(self.n, 0, -1):
            for i, ids, logs in self._edges(j):
                step = logs + beta[j]
                on = (ids >= 0) & np.isfinite(step)
                counts += np.bincount(ids[on], (np.exp(alpha[i] + step) * weights)[on], len(counts))
                beta[i] = np.logaddexp(beta[i], step)


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    t = np.stack(terms)
    top = t.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(t - safe).sum(0)) + safe


def log_probabilities(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """The marginal log probability of each word over all its segmentations; of an empty word 0."""
    out = np.zeros(len(words))
    for part, codes in groups(words):
        if codes.shape[1]:
            out[part] = Lattice(codes, pieces).forward()[-1]
    return out


def expected_counts(words: list[bytes], weights: Iterable[float], pieces: Pieces) -> np.ndarray:
    counts, weights = np.zeros(len(pieces.pieces)), np.asarray(weights, float)
    for part, codes in groups(words):
        if codes.shape[1]:
            Lattice(codes, pieces).expect(weights[part], counts)
    return counts
